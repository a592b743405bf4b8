"""The pipeline's stages against plain versions of them on small tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from math import exp, floor, log

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from newsdesk.llm import quality, rules
from newsdesk.llm.textstats import text_stats
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_near_dedup_keeps_one_of_each_group(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(3, a, "x", None, 0), (1, a, "y", None, 0), (1, a, "y", None, 0), (None, a, "z", None, 0), (None, b, "u", None, 0), (None, b, "v", None, 0), (7, "", "w", None, 0), (8, None, "w", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp int")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, b), (1, a), (7, "")]
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), SF).count() == 0


def test_mixing_repeats_rows(spark):
    rows = [(i, "w " * (i % 5 + 1), "en", "s%d" % (i % 3), 0, "k") for i in range(60)] + [(None, "a b c", None, None, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    out = corpus_pipeline.source_mixing(spark, docs, SF)
    assert out.columns == docs.columns
    total = docs.select(F.sum(F.size(F.split(F.trim("text"), " ")))).collect()[0][0]
    taken = out.select(F.sum(F.size(F.split(F.trim("text"), " ")))).collect()[0][0]
    assert abs(taken - 1.5 * total) <= 6


def test_near_dedup_finds_all_copies_of_four_fifths(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(words, k=30))  # a line many texts share
    texts = []
    for k in range(60):
        base = rng.choices(words, k=rng.choice((7, 40, 90, 200)))
        texts.append(" ".join(base) + (" " + line if k % 3 else ""))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() + ("  " + line if k % 3 else ""))
    texts += ["", None, "a b c", "a b d", "A b  c"]
    grams = []
    for t in texts:
        w = (t or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if grams[i] == grams[j] or 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]) > 0:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert 60 < len(set(root)) < len(texts) - 20


def test_near_dedup_decides_by_text_where_ids_repeat(spark):
    x, y, z = "one two three four five six", "seven eight nine ten eleven", "twelve thirteen"
    docs = spark.createDataFrame([(5, x, 1), (9, x, 2), (5, y, 3), (2, y, 4), (5, z, 5), (5, z, 6), (None, x, 7)], "doc_id long, text string, `n.o` int")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(2, y), (5, x), (5, z)]


def test_entries_of_a_large_root_meet_those_of_others_only(spark, monkeypatch):
    """Pairs across roots are those of the plain condition, also where a shingle is dealt to several places; entries aren't broadcast."""
    from newsdesk.llm import nearcopies

    rng = np.random.default_rng(8)
    plain, rows = [], []
    for fp in range(240):
        n = int(rng.choice((3, 20, 30, 34, 60, 66, 150, 160)))
        grams = np.unique(rng.integers(0, 2**63, n, np.uint64) if fp % 3 == 1 else np.arange(n, dtype=np.uint64) * np.uint64(977) + np.uint64(fp % 5))
        short = nearcopies.folded(nearcopies.parity(grams)).tolist()
        root = 0 if fp < 150 else 1 if fp < 170 else fp
        for gram in {0, fp % 4 + 1}:
            at = int(rng.integers(0, 6))
            rows.append((gram, fp, len(grams), at, root, short))
            plain.append((gram, fp, len(grams), at, root, np.array(short, np.int64)))

    def near(x, y, n, m):
        while len(x) != len(y):
            x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
        return 9 * int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= n + m

    expected = {
        (a, b)
        for g, a, n, at, r, x in plain
        for h, b, m, other, q, y in plain
        if g == h and a < b and r != q and 5 * min(n, m) >= 4 * max(n, m) and 9 * min(n - at, m - other) >= 4 * (n + m) and near(x, y, n, m)
    }
    rooted = spark.createDataFrame(rows, "gram int, fp long, n int, at int, root long, short array<long>")
    rooted = rooted.select("gram", "fp", "n", "at", "root", *nearcopies._longs("short"))
    for most in (nearcopies.MEET, 5_000):
        monkeypatch.setattr(nearcopies, "MEET", most)
        out = nearcopies.across(rooted, nearcopies.mains(rooted))
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert len(expected) > 40
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def plain_rules(rows):
    """EM a document at a time."""
    patterns = [rules.votes(text_stats(t)) for _, t, _ in rows]
    good = [0.02 if "b" in p else 0.98 for p in patterns]
    for _ in range(60):
        prior, odds = min(0.99, max(0.01, (sum(good) + 1) / (len(good) + 2))), []
        for k in range(len(rules.RULES)):
            n = {(c, v): 1 + sum(w for p, w in zip(patterns, ws, strict=True) if p[k] == v) for c, ws in ((1, good), (0, [1 - g for g in good])) for v in "gb"}
            odds.append({"a": 0.0, **{v: log(n[1, v] / (n[1, "g"] + n[1, "b"])) - log(n[0, v] / (n[0, "g"] + n[0, "b"])) for v in "gb"}})
        good = [1 / (1 + exp(-(log(prior / (1 - prior)) + sum(o[v] for o, v in zip(odds, p, strict=True))))) for p in patterns]
    out = []
    for row, g in zip(rows, good, strict=True):
        w = (row[1] or "").encode().split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {x for x, n in Counter(grams).items() if n > 1}
        repeated = {j for i, x in enumerate(grams) if x in often for j in (i, i + 1, i + 2)}
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and g >= 0.5:
            out.append(row)
    return out


def plain_classifier(rows, all_rows, labels):
    known = {}
    for d, q in labels:
        if d is not None and q in (0, 1) and zlib.crc32(str(d).encode()) % 5:
            known[d] = min(q, known.get(d, q))
    learnt = sorted((d, known[d], quality.features(t)) for d, t, _ in all_rows if d in known)
    ranker = quality.fit(np.array([x for *_, x in learnt]), np.array([q for _, q, _ in learnt]))
    return [r for r in rows if ranker.scores(np.array([quality.features(r[1])]))[0] >= quality.CUT]


def plain_dedup(rows):
    rows = sorted(rows)
    grams = []
    for _, t, _ in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return [rows[k] for k in sorted(set(root))]


def plain_mix(rows):
    size = {d: len(t.encode().split()) for d, t, _ in rows}
    hashed = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) for d, *_ in rows}
    by = {}
    for d, _, s in rows:
        by.setdefault(s, []).append(d)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size[d] for d in by[s]) for s in order}
    target, full = {}, set()
    while True:
        free = [s for s in order if s not in full]
        unit = (150 * sum(total.values()) - 200 * sum(total[s] for s in full)) / (100 * sum(weight[s] for s in free)) if free else 0
        over = {s for s in free if unit * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    times = {}
    for s in order:
        target[s] = 2.0 * total[s] if s in full else unit * weight[s]
        whole = min(2, int(target[s] // total[s]))
        budget = max(0, floor(target[s] - whole * total[s]))
        times |= dict.fromkeys(by[s], whole)
        left = sorted(by[s], key=hashed.get)
        for _ in range(4):  # what fits below the first hash that doesn't, again and again
            taken, fits = 0, [d for d in left if size[d] <= budget]
            chosen = []
            for d in fits:
                if taken + size[d] > budget:
                    break
                taken += size[d]
                chosen.append(d)
            for d in chosen:
                times[d] += 1
            left = [d for d in left if d not in chosen]
            budget -= taken
    return [r for r in rows for _ in range(times[r[0]])]


def test_stages_and_run_by_brute_force(spark):
    import tiktoken

    plain = lambda df: sorted((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    first = plain(docs)
    wanted = first
    for (_, stage), version in zip(corpus_pipeline.STAGES[:-1], (plain_rules, lambda rows: plain_classifier(rows, first, labels), plain_dedup, plain_mix), strict=True):
        docs = stage(spark, docs, SF).cache()
        wanted = sorted(version(wanted))
        assert plain(docs) == wanted
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = sorted((d, np.array(e.encode_ordinary(t), "<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest()) for d, t, _ in wanted)
    assert sorted((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()) == ids


def test_filtering_stages_on_odd_rows(spark):
    rows = [(None, None, "en", None, 0, "k"), (1, "", "en", "s", 0, "k"), (1, "word " * 60, None, "s", 0, "k"), (2, " ".join(f"w{k}, and" for k in range(40_000)), "en", "s", 0, "k")] + [(k, " ".join(f"v{k}{j}." for j in range(60)), "en", "s", 0, "k") for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pattern string")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.quality_classifier, corpus_pipeline.near_dedup, corpus_pipeline.source_mixing):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() >= 0
        assert stage(spark, docs.where("false"), SF).count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert 10 in kept and None not in kept and 1 not in kept
    encoded = corpus_pipeline.byte_bpe(spark, docs, SF).collect()
    assert len(encoded) == len(rows) and {r["n_tokens"] for r in encoded if r["doc_id"] is None} == {0}
