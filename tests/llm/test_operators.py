"""Each operator against a brute-force version, and its edge cases: nulls, blanks, long texts, ties, repeats, empty tables, extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from newsdesk.llm import bpe, html, lm, mixing, quality, rules, simhash, sketch, tokenfile, warc
from newsdesk.llm.textstats import text_stats
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, fp string, size int, part int, words string, model int"
RNG = random.Random(7)
WORDS = ["the", "of", "And", "rain.", "réu,", "zzz", "stone", "a b", "#tag", "it's", "12,5", "漢字"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "x", "yy"]) + RNG.choice(["", "", "\n"]) for _ in range(n))


TEXTS = [prose(n) for n in (3, 60, 61, 200, 5000)] + ["", None, " \n\t ", "one", "one", "  two  words \r\n", "a" * 3000, "x\x1cy  <|endoftext|>", "x <|endoftext|> y. <|endoftext|>z\n<|endoftext|>\nw", "same words here again " * 30, prose(80)]
ROWS = [(i, t, "en", ["b", "a", None, "é"][i % 4], 0, 1, "f", 2, 3, "w", 4) for i, t in enumerate(TEXTS)] + [(None, "no id at all", None, None, None, 1, "f", 2, 3, "w", 4), (3, TEXTS[3], "en", "é", 0, 1, "f", 2, 3, "w", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(rows, key="doc_id"):
    return sorted((r[key] is not None, r[key] or 0) for r in rows)


ALL_IDS = sorted((r[0] is not None, r[0] or 0) for r in ROWS)


def split(text):
    return (text or "").encode().split()


# 1 quality rules


def test_base_statistics_by_brute_force():
    for t in TEXTS:
        s, w = text_stats(t), split(t)
        assert s["n_words"] == len(w)
        assert s["word_chars"] == sum(len(x.decode()) for x in w)
        assert s["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        seen, dup = set(), 0
        for line in (t or "").encode().split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        assert s["n_dup_lines"] == dup
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        inside = {j for i, g in enumerate(grams) if g in often for j in (i, i + 1, i + 2)}
        assert s["n_repeat_words"] == len(inside)


def test_label_model_finds_the_bad_and_its_column_agrees(spark):
    good, bad = "g" * len(rules.RULES), "bb" + "g" * (len(rules.RULES) - 2)
    model = rules.fit({good: 900, bad: 40, "bbb" + good[3:]: 20, good[:6] + "bb" + good[8:]: 30, "a" * len(rules.RULES): 5})
    assert model.posterior(good) > 0.9 > 0.5 > model.posterior(bad)
    row = spark.createDataFrame([(good,), (bad,)], "p string").select(model.column(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in row] == pytest.approx([model.posterior(good), model.posterior(bad)])
    assert 0 < rules.fit({}).posterior(good) < 1


def test_label_model_by_brute_force(docs):
    """EM a document at a time, in plain Python."""
    patterns = [rules.votes(text_stats(t)) for t in TEXTS]
    good = [0.02 if "b" in p else 0.98 for p in patterns]
    for _ in range(60):
        prior = min(0.99, max(0.01, (sum(good) + 1) / (len(good) + 2)))
        odds = []
        for k in range(len(rules.RULES)):
            on = {(c, v): 1 + sum(w for p, w in zip(patterns, weights, strict=True) if p[k] == v) for c, weights in (("good", good), ("bad", [1 - g for g in good])) for v in "gb"}
            share = lambda c, v: on[c, v] / (on[c, "g"] + on[c, "b"])  # noqa: B023, E731
            odds.append({"a": 0.0, **{v: log(share("good", v)) - log(share("bad", v)) for v in "gb"}})
        good = [1 / (1 + exp(-(log(prior / (1 - prior)) + sum(o[v] for o, v in zip(odds, p, strict=True))))) for p in patterns]
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", rules.examine(F.col("text")).alias("x")).select("doc_id", "x.*")
    model = rules.fit(rules.pattern_counts(rows, "pattern"))
    got = {r["doc_id"]: r["p"] for r in rows.select("doc_id", model.column(F.col("pattern")).alias("p")).collect()}
    assert got == pytest.approx(dict(enumerate(good)), abs=1e-6)


def test_rules_over_rows(docs, empty):
    seen = docs.select("doc_id", rules.examine(F.col("text")).alias("x"))
    assert ids_of(seen.collect()) == ALL_IDS
    assert rules.pattern_counts(empty.select(rules.examine(F.col("text")).alias("x")).select("x.pattern"), "pattern") == {}


# 2 pages


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=x>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text.<p>Second &eacute;&#8212;x"
        "<div class=ad>Buy</div><script>var a='</p>';</script><ul><li>one<li>two</ul><form><input>send</form><aside>See also</aside></article>"
        "<section id=comments><p>A very long reader comment that goes on and on and on.</p></section><footer>&copy; x</footer>"
    )
    assert html.extract(page) == "Head & line\nFirst bold text.\nSecond é—x\none\ntwo"
    assert html.extract(None) == html.extract("") == html.extract("<nav>a</nav>") == ""
    assert html.extract("<article><p>AT&T and R&D &amp") == "AT&T and R&D &"
    long = "<p>" + "many words in a row " * 30 + "</p>"
    assert html.extract(f"<div><a>x</a></div>{long}{long}<div><a>y</a></div>").count("\n") == 1


def test_main_text_of_pages_without_article():
    blocks = ["h" * 20, "a" * 300, "b" * 300, "c" * 2000]
    text = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    menu = "<div><a href=x>Home</a> <a href=y>News</a></div>"
    assert html.extract(f"<body><div>{menu}</div><div>{text}<ul><li><a href=z>source</a></ul></div>{menu}") == "\n".join([*blocks, "source"])
    assert html.extract(f"<body>{menu}{text}{menu}") == "\n".join(blocks)
    # a section of its own, and a headline outside of the long text's element
    assert html.extract(f"<div><h1><a href=x>Title</a></h1><div><p>{blocks[1]}</p></div><div><p>{blocks[3]}</p></div></div>") == "\n".join(["Title", blocks[1], blocks[3]])


def test_main_text_keeps_parts_with_names_like_noise():
    for part in ("<h2 id='related-work'>x y</h2>", "<h2 id='social'>x y</h2>", "<p class='share-price'>x y</p>", "<p id='comments'>x y</p>", "<section id='modal-logic'>x y</section>"):
        assert html.extract(f"<article><p>before{part}<p>after</article>") == "before\nx y\nafter"
    for wrapper in ("class='layout has-sidebar'", "class='no-sidebar'", "class='sidebar'", "id=page-banner"):
        assert html.extract(f"<div {wrapper}><article>text</article><div class=sidebar>aside</div></div>") == "text"
        assert html.extract(f"<div {wrapper}><p>a long text</div><p>b") == "a long text\nb"
    assert html.extract("<article class='post comments-open'>text</article>") == "text"
    for noise in ("ad", "big ad", "cookie-notice", "site_footer", "related-posts", "ad-slot-2"):
        assert html.extract(f"<article>text<div class='{noise}'>noise that is longer</div></article>") == "text"
    assert html.extract("<p>short<section id=comments><article>a long remark</article></section>") == "short"


def test_ratios_choose_the_region(monkeypatch):
    text = "".join(f"<p>{'words of the text ' * 20}{k}</p>" for k in range(3))
    index = "<article>" + "".join(f"<div><a href=x><b><i>entry number {k} of a long index</i></b></a></div>" for k in range(80)) + "</article>"
    plain = lambda k: html.extract(f"<body>{index}{k}</body>")
    wanted = html.extract(f"<article>{text}</article>")
    assert plain(f"<article>{text}</article>") == wanted
    cards = "".join(f"<article><h3><a href=x>card {k}</a></h3><a href=y><b>more on it</b></a></article>" for k in range(40))
    assert html.extract(f"<body>{cards}<div>{text}</div></body>") == wanted
    monkeypatch.setattr(html, "smoothed", lambda r, sigma: np.ones(len(r)))
    monkeypatch.setattr(html, "threshold", lambda v: -1.0)
    assert "entry number 3" in plain(f"<article>{text}</article>") and wanted not in plain(f"<article>{text}</article>")


def test_text_of_made_pages():
    """Pages put together from known parts, in several layouts, against the parts."""
    r = random.Random(8)
    words = lambda n: " ".join(r.choice(("alpha", "beta", "gamma", "delta")) for _ in range(n))
    noise = (lambda t: f"<nav><ul><li><a href=x>{t}</a></ul></nav>", lambda t: f"<div class='ad'>{t}</div>", lambda t: f"<aside><p>{t}</p></aside>", lambda t: f"<form>{t}<input></form>", lambda t: f"<section id='comments'><p>{t}</p></section>", lambda t: f"<footer>{t}</footer>", lambda t: f"<script>{t}</script>")
    kinds = (lambda t: f"<p>{t}</p>", lambda t: f"<p>{t}", lambda t: f"<blockquote>{t}</blockquote>", lambda t: f"<ul><li>{t}</li></ul>", lambda t: f"<h2>{t}</h2>", lambda t: f"<div><p><b>{t}</b></p></div>")
    wrappers = (lambda b: f"<article>{b}</article>", lambda b: f"<main>{b}</main>", lambda b: f"<main><header>site</header><article>{b}</article></main>", lambda b: f"<div class='page with-sidebar'><article class='post'>{b}</article></div>", lambda b: f"<div id='content'>{b}</div>")
    for k in range(120):
        blocks = [words(r.randrange(1, 9)), *(words(r.randrange(1, 120)) for _ in range(r.randrange(1, 9)))]
        body = f"<header><h1>{blocks[0]}</h1></header>" if k % 3 == 0 and k % 5 != 4 else f"<h1>{blocks[0]}</h1>"
        for b in blocks[1:]:
            body += r.choice(kinds)(b) + (r.choice(noise)(words(4)) if r.random() < 0.3 else "")
        page = f"<html><head><title>t</title></head><body>{noise[0](words(3))}{noise[1](words(5))}{wrappers[k % 5](body)}{noise[4](words(60))}{noise[5](words(9))}"
        assert html.extract(page) == "\n".join(blocks), page


def test_layouts_without_article_keep_the_text(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        whole = html.extract(row["html"])
        bare = html.extract(row["html"].replace("<article>", "<div>").replace("</article>", "</div>"))
        assert len(bare) >= 0.95 * len(whole)


def nameless(page):
    """A page without the elements and attributes that say what a part is."""
    page = re.sub(r"<(/?)(article|main|nav|aside|header|footer|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"<(div|p|ul|li|span)\b[^>]*>", r"<\1>", page)


def test_ratios_decide_on_the_tables_pages_without_names(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r["html"]]
    wanted, found = [html.extract(x) for x in pages], [html.extract(nameless(x)) for x in pages]
    monkeypatch.setattr(html, "threshold", lambda v: -1.0)
    unclustered = [html.extract(nameless(x)) for x in pages]
    assert sum(a == b for a, b in zip(unclustered, wanted, strict=True)) == 0
    assert sum(a == b for a, b in zip(found, wanted, strict=True)) > 0.5 * len(pages)
    lines = lambda x: set(x.split("\n"))
    assert all(lines(w) <= lines(f) for w, f in zip(wanted, found, strict=True))  # nothing of the text is lost


def test_an_article_with_content_is_never_dropped():
    article, other = f"<article><p>{'word ' * 60}</p></article>", f"<div><p>{'other words here ' * 55}</p></div>"
    for page in (article + other, other + article, f"<div>{article}</div>{other * 5}"):
        assert html.extract(page) == ("word " * 60).strip()
    two = html.extract(article + article.replace("word", "term") + f"<div><p>{'other words here ' * 18}</p></div>" * 5)
    assert {("word " * 60).strip(), ("term " * 60).strip()} & set(two.split("\n"))


def test_pages_table(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<article>é x</article>")]
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out) == [(0, "é x", 3), (1, "", 0), (1, "", 0)]


# 3 token file


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.05, r.integers(0, 2**32 - 1, n), r.integers(0, 50000, n)).astype(np.uint32)
    shard = tokenfile.write_shard([4, None], [n, 0], ids, 9)
    first, rows, got = tokenfile.read_shard(shard)
    assert first == 9 and rows["null"].tolist() == [0, 1] and got.tolist() == ids.tolist()
    if n == 3000:
        assert tokenfile.read_blocks(shard, range(2, 4)).tolist() == ids[512:1024].tolist()


def test_token_file_against_the_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert t.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    out = tokenfile.read_file(tokenfile.write_file(docs)).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in out) == sorted((s, d, n, c) for d, s, n, c in want)
    assert tokenfile.read_file(tokenfile.write_file(empty)).count() == 0


# 4 near-duplicates


def brute_fingerprint(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in split(text)]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_components_against_all_pairs(docs, empty):
    prints = [(r[0], brute_fingerprint(r[1])) for r in ROWS]
    assert [simhash.fingerprint(r[1]) for r in ROWS] == [p for _, p in prints]
    label = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints):
            if (a ^ b).bit_count() <= 2:
                label = [label[i] if x == label[j] else x for x in label]
    least = {x: min((prints[k][0] for k in range(len(prints)) if label[k] == x and prints[k][0] is not None), default=None) for x in label}
    got = simhash.components(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert sorted(map(str, [(r[0], r[1], r[2]) for r in got])) == sorted(map(str, [(p[0], f"{p[1]:016x}", least[x]) for p, x in zip(prints, label, strict=True)]))
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("forest", [1_000_000, 50])
def test_links_connect_a_large_group_of_near_copies(spark, monkeypatch, forest):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "FOREST", forest)
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(300)}
    x = r.getrandbits(64)
    for _ in range(150):  # a chain, each two bits from the one before
        x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
        prints.add(x)
    todo, groups = set(prints), []
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            a = front.pop()
            group.add(a)
            near = {b for b in todo if (a ^ b).bit_count() <= 2}
            todo -= near
            front += near
        groups.append(frozenset(group))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    found = {}
    for row in simhash.connected(edges).collect():
        found.setdefault(row["root"], set()).add(row["node"])
    assert {frozenset(map(signed, g)) for g in groups if len(g) > 1} == {frozenset(g) for g in found.values()}


# 5 quality classifier


def test_ranker_orders_held_out_documents(spark):
    good = [prose(100) for _ in range(60)]
    bad = [" ".join(w + "%%%" for w in prose(100).split()) for _ in range(30)] + ["no no no no " * 40 for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i, _ in rows] + [(5, 1, 0), (None, 1, 0), (999, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    ranker = quality.train(docs, labels)
    out = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h"), quality.score(F.col("text"), ranker).alias("s")).collect()
    assert len(out) == 121 and all(0 <= r["s"] <= 1 for r in out)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    right = [(r["s"] >= quality.CUT) == (r["doc_id"] < 60) for r in out if r["doc_id"] is not None and r["h"]]
    assert sum(right) >= 0.95 * len(right)
    none = quality.train(docs, labels.where("false"))
    assert docs.select(quality.score(F.col("text"), none)).distinct().count() == 1


def test_labels_beyond_the_bound_are_sampled(spark, monkeypatch):
    rows = [(i, prose(100) if i % 2 else "no no no no " * 40) for i in range(200)]
    docs = spark.createDataFrame([*rows, (4, "another text of an id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "MAX_LABELLED", 40)
    few = quality.train(docs, labels)
    assert any(few.weights) and few == quality.train(docs.repartition(7), labels)
    monkeypatch.setattr(quality, "MAX_LABELLED", 1)
    assert quality.train(docs, labels).weights == [0.0] * len(quality.features(""))
    assert len(quality.features(None)) == len(quality.features("x" * 100)) and quality.shapes("ABc 12, é#%") .sum() > 0


# 6 mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_targets(spark, docs, empty):
    many = spark.createDataFrame([(i, prose(RNG.randrange(1, 90)), "s%d" % (i % 5) if i % 7 else None) for i in range(700)], "doc_id long, text string, source string")
    for d in (many, docs):
        rows = mixing.mix(d).collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
        want = brute_targets(dict(sizes))
        taken = Counter()
        for r in rows:
            assert 0 <= r["times"] <= 2 and r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] += r["times"] * r["size"]
        if d is many:
            assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes)
            assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(many.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0


# 7 byte-level BPE


def test_round_trip_against_the_library(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {(r["doc_id"], r["ids"], r["decoded"]) for r in bpe.round_trip(docs).collect()}
    assert out == {(r[0], np.array(e.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in ROWS}
    assert bpe.round_trip(docs).count() == len(ROWS) and bpe.digests(empty).count() == 0
    r = next(x for x in bpe.digests(docs).collect() if x["doc_id"] == 4)
    assert r["decoded_sha256"] == hashlib.sha256(TEXTS[4].encode()).hexdigest() and r["n_tokens"] == len(e.encode_ordinary(TEXTS[4]))


def test_pieces_of_any_length(monkeypatch):
    import tiktoken

    r = random.Random(1)
    kinds = ("abcdeist", "漢字語文書", ["é", "ß", "a", "🔥", "и"], "=-")
    pieces = sorted({"".join(r.choice(k) for _ in range(n)).encode() for k in kinds for n in (1, 3, 8, 20, 60, 500)} | {b"a" * 1500})
    c = bpe.Coder(P.path("byte_bpe_50k.tiktoken"))
    c.open()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    want = [np.array(library._core_bpe.encode_single_piece(p), "<u4").tobytes() for p in pieces]
    assert c.encode_pieces(pieces) == want and c.decode(want) == pieces
    for rows, run, at_once in ((50, 7, 20), (5000, 100, 1)):
        for name, value in (("ROWS", rows), ("RUN", run), ("AT_ONCE", at_once)):
            monkeypatch.setattr(bpe, name, value)
        assert c.encode_pieces(pieces[:20]) == want[:20] and c.decode([*want, b""]) == [*pieces, b""]


# 8 sketches


def test_sketches(spark, docs, empty):
    rows = sketch.compared(docs).collect()
    assert ids_of(rows) == ALL_IDS
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    edited = []
    for k, row in enumerate(order):
        t, n = row[1] or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited.append((row[0], len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    assert sorted(map(str, edited)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] == 8)["near_next"] == 1  # equal texts
    assert sketch.compared(empty).count() == 0
    made = {r["doc_id"]: (r["fingerprint"], r["near_next_basis"]) for r in rows if r["doc_id"] is not None}
    for doc_id, text, *_ in ROWS:
        if doc_id is None:
            continue
        w = [x.decode() for x in split(text)]
        h = sorted({hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:8] for i in range(max(1, len(w) - 4))})
        below = max("10000000", h[64]) if len(h) > 64 else "g"
        assert made[doc_id][0] == below + "".join(x for x in h if x < below)
    big = " ".join(f"w{i}" for i in range(4000))
    got = spark.createDataFrame([(big, big[: len(big) // 3])], "a string, b string").select(sketch.likeness(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("x")).collect()[0]["x"]
    assert got > 0.98  # a part is contained in the whole


def test_merged_sketches_are_those_of_the_union(spark):
    r = random.Random(2)
    word = lambda k: f"{k:05d}"
    rows = []
    for n, m in ((3, 5), (40, 40), (64, 1), (70, 2000), (900, 1200), (3000, 10)):
        a, b = (" ".join(word(r.randrange(5000)) for _ in range(x + 4)) for x in (n, m))
        rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", sketch.merge(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m"))
    for row in got.collect():
        h = sorted({hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:8] for w in (row["a"].split(), row["b"].split()) for i in range(len(w) - 4)})
        below = max("10000000", h[64]) if len(h) > 64 else "g"
        assert (row["m"]["below"], row["m"]["hashes"]) == (below, [x for x in h if x < below])


def test_a_shared_id_is_dealt_out(spark):
    rows = [(None if k % 3 else 7 if k % 2 else k, f"text number {k} of many") for k in range(300)]
    out = sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 8).select("doc_id", "text", "next_text").collect()
    nexts = {r["text"]: r["next_text"] for r in out}
    assert len(out) == 300 and len(set(nexts.values())) == 300
    at, seen = rows[0][1], []
    for _ in range(300):  # one circle through all rows, ids ascending but at its start
        seen.append(at)
        at = nexts[at]
    assert len(set(seen)) == 300
    ids = dict((t, d) for d, t in rows)
    order = [ids[t] if ids[t] is not None else -1 for t in seen]
    k = order.index(min(order)) if order[0] == order[-1] else next(i for i in range(300) if order[i - 1] > order[i])
    assert order[k:] + order[:k] == sorted(order)


# 9 web archive


def test_archive_gives_records_back(spark):
    big, small = "<p>é" + "x" * 1000, "<p>small"
    rows = [(1, "http://a\r\nX: y", big), (2, "u2", big), (5, None, big), (5, None, big), (None, "n", big), (6, "u6", small), (7, "u7", small), (8, "u8", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    archive = warc.write(pages)
    assert archive.payloads.count() == 3
    out = warc.read(archive).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(x[2] for x in rows if x[0] == r["page_id"]) or ""
        assert bytes(r["payload"]) == text.encode() and r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == hashlib.sha1(text.encode()).hexdigest()
        revisit = text == big and r["page_id"] != 5
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if revisit else ("response", None))
        assert bytes(r["record"]) == r["header"].encode() + (b"" if revisit else text.encode()) + b"\r\n\r\n" and r["header"].count("\r\n\r\n") == 1
    assert warc.read(warc.write(pages.where("false"))).count() == 0


# 10 language model


def test_scores(docs, empty, spark):
    counts, vocab, model = lm.fit(docs)
    rows = lm.score(docs, counts, vocab, model).collect()
    assert ids_of(rows) == ALL_IDS
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in split(t)] + [b"\n"]
    c = Counter(w for r in ROWS if not out(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((r[0] or -1, out(r[0]), len(tokens(r[1])), sum(w in c for w in tokens(r[1])), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in ROWS)
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert lm.score(empty, *lm.fit(empty)).count() == 0


def test_words_outside_the_head_score_alike(docs, monkeypatch):
    whole = lm.fit(docs)
    base = {(r["doc_id"], round(r["base_score"], 6), r["n_known"]) for r in lm.score(docs, *whole).collect()}
    monkeypatch.setattr(lm, "HEAD", 3)
    few = lm.fit(docs)
    assert len(few[1].index) <= 4
    assert {(r["doc_id"], round(r["base_score"], 6), r["n_known"]) for r in lm.score(docs, *few).collect()} == base


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(("the", "a")) + " " + rng.choice(("cat", "dog")) + " " + rng.choice(("sat", "ran.")) for _ in range(60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two, many = (lm.fit(docs.repartition(n)) for n in (2, 16))
    got = [{r["doc_id"]: r["score"] for r in lm.score(docs, *fitted).collect()} for fitted in (two, many)]
    assert got[0] == pytest.approx(got[1], abs=1e-3)
    held = [r for r in lm.score(docs, *two).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_gradient_of_the_contrastive_loss(monkeypatch):
    """A step's direction against differences of the loss itself."""
    rng = np.random.default_rng(1)
    u = rng.random(lm.CLASSES) + 0.5
    u /= u.sum()
    h1, h2, target = (rng.integers(0, lm.CLASSES, 40) for _ in range(3))
    own = lm.Trainer(lm.Model.start(u), u, 3)
    noise = np.minimum(np.searchsorted(np.cumsum(u), np.random.default_rng(3).random(lm.NOISE)), lm.CLASSES - 1)
    grads = {}
    monkeypatch.setattr(own, "_step", lambda name, grad: grads.__setitem__(name, grad * len(target) ** 0.5))
    own.batch(h1, h2, target)

    def loss(m):
        log_k = np.log(lm.NOISE * u)
        ctx = m["C"][0] * m["R"][h1] + m["C"][1] * m["R"][h2]
        s = (ctx * m["Q"][target]).sum(1) + m["b"][target] - log_k[target]
        sn = ctx @ m["Q"][noise].T + m["b"][noise] - log_k[noise]
        return -np.log1p(np.exp(-s)).sum() - np.log1p(np.exp(sn)).sum()

    params = {k: getattr(own.m, k).astype(float) for k in "RQCb"}
    for name, places in {"R": [(h1[0], 2), (h2[5], 0)], "Q": [(target[1], 3), (noise[0], 1)], "C": [(0, 4), (1, 7)], "b": [(target[2],), (noise[3],)]}.items():
        for at in places:
            up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-2, abs=2e-2)


def test_model_is_normalised():
    u = np.full(lm.CLASSES, 1 / lm.CLASSES)
    m = lm.Model.start(u)
    z = m.log_sums()
    h1, h2 = np.array([0, 5, lm.CLASSES]), np.array([lm.CLASSES, 3, 7])
    p = np.exp(m.context(h1, h2) @ m.Q.T + m.b - z[h1 * (lm.CLASSES + 1) + h2][:, None])
    assert p.sum(1) == pytest.approx(np.ones(3), abs=1e-4)
