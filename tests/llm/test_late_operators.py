"""Spelling variants, vector codes and substring dedup against brute-force versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from newsdesk.llm import codes, entries, substrings, variants
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, word string, n int, tk int, at int, size int, first int, label int"
RNG = random.Random(11)


def table(spark, rows):
    return spark.createDataFrame([(*r, "en", "w", 1, 2, 3, 4, 5, 6) for r in rows], DOCS).repartition(3)


# 11 spelling variants


def spelled(rows):
    """word, form, root, n, n_near, form_n by trying every edit."""
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted(set("".join(words)))
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in letters for d in (0, 1)}
        near[w] = {x for x in edits if x in words and x != w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def variant_rows():
    base = ["Handel", "handels", "händel", "handle", "bundle", "Bündel", "aaaaaa", "aaaaaaa", "abcdefghij", "abcdefghj", "übergang", "×÷éàçè"]
    made = [w[:i] + RNG.choice("aeé") + w[i + 1 :] for w in base for i in range(len(w))] + [w[:i] + w[i + 1 :] for w in base for i in range(len(w))]
    rows = [(k, " ".join(RNG.choices(base, k=40) + RNG.choices(made, k=60)) + ". 漢字 short " + RNG.choice(base).upper()) for k in range(120)]
    rows += [(None, "Handel " * 6), (5, rows[5][1]), (5, rows[5][1]), (1000, None), (1001, ""), (1002, "q" * 100_000), *((k, "z" * 300 + " " + "z" * 299 + " " + "z" * 298 + "y") for k in range(2000, 2007))]
    return rows + [(3000 + k, "meander " * (k < 6) + "meanders " + "meandersy " * 6) for k in range(40)]


@pytest.mark.parametrize("block", [variants.BLOCK, 60])
def test_variants_by_brute_force(spark, block):
    rows = variant_rows()
    got = variants.grouped(table(spark, rows), block=block).collect()
    want = spelled(rows)
    assert sum(r[1] is not None for r in want) > 20
    assert sum(r[2] not in (r[0], r[1]) for r in want) > 0  # forms of forms
    assert sorted(tuple(r) for r in got) == want


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        tree = variants.Wavelet(values)
        low, high, least, most = (rng.integers(0, n + 1, 300) for _ in range(4))
        q, v = tree.report(low, high, least, most)
        want = [(k, x) for k in range(300) for x in values[low[k] : max(low[k], high[k])] if least[k] <= x < most[k]]
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted((k, int(x)) for k, x in want)


def test_variants_of_nothing(spark):
    assert variants.grouped(table(spark, [])).collect() == []
    assert variants.grouped(table(spark, [(1, None), (2, "")])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# 12 vector codes


def quantised(rows, parts=4, entries_=256, rounds=4):
    """The contract in plain Python; rows: (vec_id, embedding, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cuts = [list(map(int, c)) for c in np.array_split(np.arange(len(kept[0][1])), parts)]
    cut = lambda v: [[v[k] for k in c] for c in cuts]
    books = [[cut(r[1])[p] for r in kept[:entries_]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                x = cut(v)[p]
                own[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    found = [(i, [nearest(x, books[p]) for p, x in enumerate(cut(v))], lab) for i, v, lab in kept]
    total = Counter()
    for _, near, lab in found:
        total[lab] += sum(d for d, _ in near)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), total[lab], sha) for i, near, lab in found]


def vectors(d):
    rng = np.random.default_rng(d)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, d)], [None, 1, 2, 2][i % 4]) for i in range(300)]
    rows += [(k, rows[3][1], 1) for k in (400, 401)] + [rows[7], rows[7], (None, rows[9][1], 3), (500, None, 1)]
    rows += [(501, [float("nan")] * d, 1), (502, [float("inf")] + [0.0] * (d - 1), 1), (503, [None] + [0.0] * (d - 1), 2), (504, [0.0] * (d + 1), 2), (505, [1000.0] * d, 2), (-1, [0.25] * d, 9)]
    return rows


@pytest.mark.parametrize("d", [8, 6, 3])
def test_codes_by_brute_force(spark, tmp_path, d):
    rows = vectors(d)
    RNG.shuffle(rows)
    schema = "vec_id long, embedding array<float>, label int, v int, error int, n int, codes int"
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entries.op12_vector_codes(spark, str(tmp_path)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(quantised(rows), key=order)


def test_partial_distances_find_the_nearest_and_the_lowest_of_ties():
    rng = np.random.default_rng(1)
    for d, spread in ((1, 3), (2, 2), (5, 3), (16, 200), (33, 1000)):
        x, book = rng.integers(-spread, spread, (500, d)), rng.integers(-spread, spread, (256, d))
        book[100:110] = book[7]
        at, far = codes.nearest(x, book)
        whole = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (at == whole.argmin(1)).all() and (far == whole.min(1)).all()
    assert codes.nearest(np.zeros((0, 4), np.int64), book[:, :4])[0].size == 0


def test_codes_of_few_no_and_far_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    one, books = codes.compressed(spark.createDataFrame([(4, [0.5, 0.25, -0.1, 0.0], None)], schema))
    assert one.collect()[0]["error"] == 0 and [b.tolist() for b in books] == [[[512]], [[256]], [[-103]], [[0]]]
    none, books = codes.compressed(spark.createDataFrame([(4, None, "a")], schema))
    assert none.collect() == [] and books == []
    assert none.columns == one.columns
    with pytest.raises(Exception, match="beyond"):
        codes.compressed(spark.createDataFrame([(4, [1e9] * 4, "a")], schema))[0].collect()


# 13 substring dedup


def without(rows, window=13):
    """doc_id, n_words, n_removed, kept by looking up every window."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def passages():
    word = lambda: "".join(RNG.choice("abcé漢") for _ in range(RNG.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (12, 13, 14, 19, 20, 40, 200)]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(RNG.randint(1, 4)):
            parts += text(RNG.randint(0, 30))
            if RNG.random() < 0.6:
                p = RNG.choice(shared)
                a = RNG.randint(0, 3)
                parts += p[a : len(p) - RNG.randint(0, 3)]
        rows.append((k, RNG.choice([" ", "\n", "  \t"]).join(parts)))
    copy = rows[20][1]
    rows += [(k, copy) for k in (300, 301, 302)] + [(301, copy), (301, rows[3][1]), (None, copy), (None, rows[4][1]), (304, copy + " one more"), (-5, rows[30][1])]
    rows += [(400, None), (401, ""), (402, " \n"), (403, " ".join(text(12))), (404, "a b c " * 200), (405, "x " + "a b c " * 50), (406, "w" * 1_000_000 + " " + rows[8][1]), (407, rows[8][1] + " " + "w" * 1_000_000)]
    long = " ".join(text(300_000))
    return rows + [(500, long), (501, long + " end"), (502, "start " + long), (7, rows[60][1]), (7, rows[60][1])]


def test_substrings_by_brute_force(spark):
    rows = passages()
    got = sorted((tuple(r) for r in substrings.deduplicated(table(spark, rows)).collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    want = without(rows)
    assert sum(0 < r[2] < r[1] for r in want) > 50
    assert got == want


def test_substrings_of_nothing(spark):
    assert substrings.deduplicated(table(spark, [])).collect() == []
    assert substrings.deduplicated(table(spark, [(1, None), (2, None)])).count() == 2


def test_difference_cover_aligns_any_two_places():
    assert substrings.COVER == (0, 1, 3)
    for v in range(1, 14):
        cover = substrings.difference_cover(v)
        assert all(any((i + k) % v in cover and (j + k) % v in cover for k in range(v)) for i in range(v) for j in range(v))


def test_hashes_depend_on_the_words_alone():
    words = [w.encode() for w in ("a", "b", "ab", "a" * 5000, "é", "", "漢字" * 3000)] * 3000
    h = substrings.word_hashes(list(words))
    assert len(set(h.tolist())) == 7 and (h.reshape(-1, 7) == h[:7]).all()
    assert (substrings.word_hashes(list(words[2:9])) == h[2:9]).all()


# 7 byte-level BPE: pieces of any length


def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_long_pieces_have_the_librarys_ids():
    import public_tokenizers as P
    from newsdesk.llm import bpe

    encoding, ranks = library()
    own = bpe.Coder(P.path("byte_bpe_50k.tiktoken"))
    own.open()
    pick = lambda letters, n: bytes(RNG.choice(letters) for _ in range(n))
    words = [t for t in ranks if t.isalpha() and len(t) > 2]
    pieces = [b"a" * n for n in range(60, 140)] + [pick(alphabet, RNG.randint(30, 300)) for alphabet in (b"ab", b"aeiou", b"the", b"rstlne", bytes(range(97, 123)), b"=-", b"\xc3\x83\xc2\x82", bytes(range(256))) for _ in range(25)]
    pieces += [b"".join(RNG.choices(words, k=RNG.randint(10, 100))) for _ in range(60)] + [pick(bytes(range(97, 123)), 8000)]
    got = own.encode_pieces(pieces)
    assert got == [np.array(encoding._encode_single_piece(p), "<u4").tobytes() for p in pieces]
    own.close()


def test_very_long_words_through_the_operator(spark):
    from newsdesk.llm import bpe

    encoding, _ = library()
    texts = ["a" * 3_000_000, "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "b" * 100_000 + " and " + "é" * 5000]
    rows = bpe.digests(table(spark, list(enumerate(texts)))).collect()
    assert len(rows) == 3
    for r in rows:
        text = texts[r["doc_id"]]
        ids = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_many_new_chunks_share_the_rounds_of_few_queries():
    """28,000 distinct words take few runs of the recursive query, as each run hashes the merge table in every round."""
    import public_tokenizers
    import pyarrow as pa
    from newsdesk.llm import bpe

    encoding, _ = library()
    own = bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 9))) for _ in range(28_000)})
    runs, rounds = [], own._rounds
    own._rounds = lambda ids, *rest: runs.append(len(ids)) or rounds(ids, *rest)
    own.open()
    texts = [" ".join(words), "", "été " + words[0]]
    for text, (ids, back) in zip(texts, own.round_trips(pa.array(texts)), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), back.decode()) == (encoding.encode_ordinary(text), text)
    own.close()
    assert len(runs) <= 3, runs


# 8 document fingerprints: containment of texts of very unequal lengths


def test_containment_of_unequal_texts_by_brute_force(spark):
    """The estimate's error stays within four of its standard errors, and within a half of one on average over all pairs."""
    from newsdesk.llm import sketch

    word = lambda: "".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6)))
    pairs = []
    for k in range(40):
        long = [word() for _ in range(RNG.choice((800, 3000, 6000)))]
        n = RNG.choice((60, 150, 400))
        held = RNG.randint(0, n)
        at = RNG.randrange(len(long) - n + 1)
        pairs.append((k, " ".join(long), " ".join(long[at : at + held] + [word() for _ in range(n - held)])))
    made = spark.createDataFrame(pairs, "k int, a string, b string").repartition(8).select("k", sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    rows = made.cache().select("k", sketch.compare(F.col("a"), F.col("b")).alias("c")).select("k", "c.basis", "c.near").collect()
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    errors = []
    for r in rows:
        _, a, b = pairs[r["k"]]
        exact = len(shingles(a) & shingles(b)) / len(shingles(b))
        deviation = math.sqrt(max(exact * (1 - exact), 0.01) / max(1, r["basis"]))
        errors.append((r["near"] - exact) / deviation)
        assert abs(errors[-1]) <= 4 or r["basis"] == 0
    assert abs(sum(errors) / len(errors)) < 0.5
