"""Feed engine: scalar cases, deduplication, topics, editorial scores, parsing, streaming."""

import random

import pytest
from newsdesk import storage
from newsdesk.functions import keywords, text, urls
from newsdesk.operators import dedup, documents, editorial, numbering, setjoin, topics
from newsdesk.sources import catalog, feeds, models
from newsdesk.streaming import seen
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://E.com/a/?utm_source=x&id=1#top", "https://e.com/a?id=1"),
        ("https://e.com/a?b=2&a=1&a=0&REF=z&c", "https://e.com/a?a=1&a=0&b=2&c="),
        ("https://e.com/a%20b?q=%C3%A9", "https://e.com/a%20b?q=é"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, url, urls.normalize_url) == want


def test_tracker_url_keeps_order_and_case_of_host(spark):
    assert one(spark, "https://E.com/a/?z=1&from=x&b=&a=é", urls.tracker_url) == "https://E.com/a?z=1&a=%C3%A9"
    assert len(one(spark, "https://e.com", urls.article_id)) == 16


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Mon, 06 Apr 2026 08:00:00 GMT", "2026-04-06 08:00:00"),
        ("Mon, 6 Apr 2026 08:00:00 +0200", "2026-04-06 06:00:00"),
        ("2026-04-06T08:00:00Z", "2026-04-06 08:00:00"),
        ("2026-04-06T08:00:00+08:00", "2026-04-06 00:00:00"),
        ("2026-04-06 08:00", "2026-04-06 08:00:00"),
        ("2026-04-06", "2026-04-06 00:00:00"),
        ("Mon, 06 Apr 2026 08:00:00 EST", "2026-04-06 13:00:00"),
        ("soon", None),
        (None, None),
    ],
)
def test_dates(spark, raw, want):
    assert one(spark, raw, lambda c: text.parse_date(c).cast("string")) == want


def test_text_functions(spark):
    assert one(spark, "a|b\nc", text.escape_cell) == "a\\|b c"
    assert one(spark, "x" * 151, lambda c: text.truncate(c, 150)) == "x" * 150 + "..."
    assert one(spark, "ai_research", text.normalize_category) == "ai_ml" and one(spark, "other", text.normalize_category) == "other"
    assert one(spark, "## H", lambda c: text.demote_headings(c, 3)) == "##### H" and one(spark, "plain", lambda c: text.demote_headings(c, 3)) == "plain"
    assert one(spark, "so:\n```json\n{\"a\": 1}\n```", text.strip_code_fences) == '{"a": 1}'
    assert one(spark, "🔥 Hot", text.strip_leading_emoji) == "Hot"
    assert one(spark, "All looks good to me", text.no_change) is True
    assert [one(spark, m, text.error_code) for m in ("Read timed out", "getaddrinfo failed", "Broken pipe", "bad certificate", "no")] == [-2, -3, -4, -5, -1]
    assert one(spark, "https://youtu.be/abcdefghijk?t=1", text.video_id) == "abcdefghijk" and one(spark, "https://e.com", text.video_id) is None


def test_keywords_of_mixed_text(spark):
    got = one(spark, "OpenAI 发布 the GPT-5 大模型", lambda c: keywords.keywords(c, F.lit(None)))
    assert got == ["openai", "gpt", "发布", "布大", "大模", "模型"]
    assert len(one(spark, " ".join(f"w{i}" for i in range(40)), lambda c: keywords.keywords(c, c))) == 15


def brute_greedy(rows, threshold=0.85):
    kept = []
    for pos, title, url in sorted(rows):
        words = set(title.lower().split())
        same = lambda w, u: u == url or (words and w and len(words & w) / len(words | w) > threshold)
        if not url or not any(same(w, u) for _, w, u in kept if u):
            kept.append((pos, words, url))
    return sorted(p for p, _, _ in kept)


@pytest.mark.parametrize("whole", [dedup.WHOLE, 12, 1])
def test_greedy_dedup_against_the_sequential_rule(spark, whole):
    r = random.Random(5)
    base = [" ".join(f"t{r.randrange(400)}" for _ in range(14)) for _ in range(8)]
    rows = []
    for i in range(120):
        words = r.choice(base).split()
        words[r.randrange(14)] = r.choice(["x", "y", words[0]])
        rows.append((i, r.choice([" ".join(words), r.choice(base), ""]), r.choice(["", f"https://e.com/{r.randrange(60)}"])))
    rows += [(200, "a b c d e f g h i j k l m n", "https://e.com/c1"), (201, "a b c d e f g h i j k l m z", "https://e.com/c2"), (202, "a b c d e f g h i j k l y z", "https://e.com/c3")]
    got = dedup.greedy(spark.createDataFrame(rows, "pos long, title string, url string"), whole=whole).select("pos").collect()
    assert sorted(x["pos"] for x in got) == brute_greedy(rows)


@pytest.mark.parametrize("one_task", [500_000, 5])
def test_components_and_clusters(spark, monkeypatch, one_task):
    monkeypatch.setattr(setjoin, "ONE_TASK", one_task)
    nodes = spark.createDataFrame([(str(i),) for i in range(10, 30)], "gid string")
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 20)], "a string, b string")
    assert setjoin.components(nodes, edges.where("false")).where("gid <> root").isEmpty()
    assert setjoin.components(nodes, edges).groupBy("root").count().where("count > 1").collect()[0]["count"] == 11
    rows = [(i, "OpenAI launches GPT model today", "", f"u{i}", f"s{i % 2}") for i in range(4)] + [(9, "Quantum chips cooled overnight", "", "u9", "s9")]
    a = spark.createDataFrame(rows, "pos long, title string, description string, url string, source string")
    out = {r["pos"]: r for r in topics.clusters(a).collect()}
    assert out[0]["cluster_size"] == 4 and out[0]["cross_source"] and out[9]["cluster_id"] == "c_other"
    assert {r["cluster_id"]: r["theme"] for r in topics.themes(topics.clusters(a)).collect()}["c_0"] == "gpt launches model openai today"
    many = spark.range(60).select(F.col("id").alias("pos"), F.lit("same title words").alias("title"), F.lit("").alias("description"), F.col("id").cast("string").alias("url"), F.lit("s").alias("source"))
    assert topics.clusters(many, merge_guard=True).select("cluster_id").distinct().collect()[0][0] == "c_other"
    assert topics.clusters(many).select("cluster_size").distinct().collect()[0][0] == 60


def test_connected_sets_against_all_pairs(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["all"]
    sets = {tuple(sorted({"all", *r.choices(words, k=r.randrange(1, 9))})) for _ in range(150)}
    groups = setjoin.cut(setjoin.grouped(spark.createDataFrame([(list(s),) for s in sets], "w array<string>"), F.col("w")))
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if len(set(a) & set(b)) > 0.4 * len(set(a) | set(b)):
                root[find(a)] = find(b)
    want = {}
    for s in sets:
        want.setdefault(find(s), set()).add(s)
    named = {r["gid"]: tuple(r["words"]) for r in groups.collect()}
    for rare, block in ((4, 16), (1000, 2048), (1, 7)):
        got = {}
        for row in setjoin.connected(groups, 0.4, rare, block).collect():
            got.setdefault(row["root"], set()).add(named[row["gid"]])
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_plain_text_and_page_functions(spark):
    assert text.plain_text("caf&eacute; &#8212; &hellip;<p>a<br>b</p><script>x</script><style>y</style>&nbsp;c AT&T") == "café — …\na\nb\n c AT&T"
    assert text.plain_text(None) == "" and text.plain_text("a <i ") == "a" and text.plain_text("<b> a </b> <p>b", " ") == "a b"
    long = "word " * 60
    assert text.content_text(f'<div class="postal-ad">{long}</div><main>{long} main</main>').endswith("main")
    assert text.content_text(f'<div class="x entry-content">{long} one</div><main>{long}</main>').endswith("one") and text.content_text("<p>short") == ""
    assert one(spark, "A \t b!  c", text.make_anchor) == "a-b-c" and one(spark, "https://www.youtube.com/v/abcdefghijk", text.video_id) == "abcdefghijk"
    assert one(spark, "Daily Mail", topics.source_authority) == 0.4 and one(spark, "x ai.google y", topics.source_authority) == 1.0
    assert one(spark, "https://A.X.com/s", text.is_skipped_url) and not one(spark, "https://youtu.be/x", text.is_skipped_url) and not one(spark, None, text.is_skipped_url)


def test_greedy_dedup_of_a_long_chain(spark):
    """Each of 20,000 titles rules out the next one (100,000 do as well); a component is decided in one go, where rounds would be as many as its length."""
    title = F.array_join(F.transform(F.sequence(F.col("id"), F.col("id") + 13), lambda i: F.concat(F.lit("c"), i.cast("string"))), " ")
    rows = spark.range(20_000).select(F.col("id").alias("pos"), title.alias("title"), F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("url"))
    got = dedup.greedy(rows).agg(F.count("*").alias("n"), F.sum(F.col("pos") % 2).alias("odd"), F.max("pos").alias("last")).collect()[0]
    assert tuple(got) == (10_000, 0, 19_998)


@pytest.mark.parametrize("whole", [dedup.WHOLE, 150])
def test_greedy_dedup_writes_no_pairs_of_near_copies(spark, monkeypatch, whole):
    """400 near copies of each of two titles make 160,000 pairs; no table has more than a few rows for each title (F11)."""
    counts, discard = [], storage.discard
    monkeypatch.setattr(storage, "discard", lambda *tables: counts.extend(t.count() for t in tables) or discard(*tables))
    own = F.concat(F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.col("id").cast("string"))
    shared = [F.concat(F.when(F.col("id") % 2 == 0, "x").otherwise("y"), F.lit(str(k))) for k in range(30)]
    rows = spark.range(800).select(F.col("id").alias("pos"), F.concat_ws(" ", *shared, own).alias("title"), F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("url"))
    assert sorted(r["pos"] for r in dedup.greedy(rows, whole=whole).select("pos").collect()) == [0, 1]
    assert len(counts) > 5 and max(counts) <= 6 * 800


@pytest.mark.parametrize("threshold", [0.3, 0.85])
def test_near_sets_connect_all_similar_ones(spark, threshold):
    """Also where a word's sets are cut into many cells; of what is linked, nothing but what the filters can't tell apart is further off (F11)."""
    r = random.Random(17)
    sets = {frozenset(r.choices([*["the"] * 9, *map(str, range(40))], k=r.randrange(1, 14))) for _ in range(120)}
    sets |= {frozenset(r.sample([*map(str, range(40))], r.randrange(14, 24))) for _ in range(60)}
    sets |= {s - {r.choice(sorted(s))} | {x} for s in sets if len(s) > 6 for x in "xy"} | {frozenset({"the"}), frozenset({"the", "x"})}
    sets = sorted(map(sorted, sets))
    coded = spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>").select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    entries = setjoin.prefixes(coded, threshold)
    similar = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len({*a} & {*b}) > threshold * len({*a} | {*b})]
    assert len(similar) > 50
    for block in (8192, 7):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for row in setjoin.near(entries, threshold, block).collect():
            root[find(row["a"])] = find(row["b"])
        assert all(find(i) == find(j) for i, j in similar)
    others = list(range(0, len(sets), 3))
    ids = spark.createDataFrame([(i,) for i in range(len(sets)) if i % 3], "id long")
    got = {x["id"] for x in setjoin.similar_to(entries, coded, ids, spark.createDataFrame([(i,) for i in others], "id long"), threshold).collect()}
    assert got == {i for p in similar for i, j in (p, p[::-1]) if i % 3 and not j % 3}


def test_editorial_cases(spark):
    cases = [("OpenAI Blog", 3, None, 1), ("TechCrunch", 3, None, 1), ("nobody", 1, None, 1), ("nobody", 2, None, 1), ("nobody", 3, 300, 1), ("Anthropic", 1, 300, 5)]
    a = spark.createDataFrame([(s, p, h, n, n > 1, "Title", "", "") for s, p, h, n in cases], "source string, priority int, hn_points int, cluster_size int, cross_source boolean, title string, description string, url string")
    rows = editorial.scored(a).collect()
    assert [r["authority"] for r in rows] == [1.0, 0.7, 0.8, 0.6, 0.4, 1.0]
    assert [r["editorial_tier"] for r in rows] == ["noteworthy", "brief", "noteworthy", "brief", "noteworthy", "must_read"]
    assert editorial.approved(editorial.scored(a), 0.3).count() < len(cases)


RSS = """<rss><channel><item><title>A &mdash; b</title><link>http://e.com/1</link><pubDate>Mon, 06 Apr 2026 08:00:00 GMT</pubDate><description>Points: 42 # Comments: 7</description></item>
<item><title>Old</title><link>http://e.com/2</link><pubDate>Mon, 06 Apr 2020 08:00:00 GMT</pubDate></item><item><title>Undated &eacute;</title><link>http://e.com/3</link></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="http://s"/><link rel="alternate" href="http://a"/><updated>2026-04-06T08:00:00Z</updated><summary>s</summary></entry></feed>'


def test_feeds(spark):
    docs = spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("bad", "<rss"), ("none", None)], "feed string, xml string")
    items = feeds.explode_items(docs)
    got = {(r["feed"], r["title"]): r for r in items.collect()}
    assert got["rss", "A — b"]["hn_points"] == 42 and got["rss", "A — b"]["hn_comments"] == 7 and got["atom", "E"]["link"] == "http://a" and len(got) == 4
    cutoff = F.lit("2026-04-01").cast("timestamp")
    assert {r["title"] for r in feeds.recent(items, cutoff).collect()} == {"A — b", "E"}
    assert feeds.recent(items, cutoff, undated="keep", most=1).count() == 2


def test_feed_source(spark):
    document = RSS

    class Fixture(feeds.FeedSource):  # local, so that it is pickled by value
        @staticmethod
        def transport(url):
            if "down" in url:
                raise OSError("Connection refused")
            return document

    spark.dataSource.register(Fixture)
    rows = spark.read.format("newsdesk_feeds").option("urls", "http://a http://down").load().collect()
    assert {(r["feed"], r["xml"] is None, r["error"]) for r in rows} == {("http://a", False, None), ("http://down", True, "Connection refused")}
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert feeds.with_retry(flaky, pause=lambda s: None)("u") == "ok" and len(calls) == 3


def test_lists_reports_and_models(spark):
    lines = spark.createDataFrame(list(enumerate(["# x", "## Dev", "- [A](http://a)", "- ~~[B](http://b)~~", "## Sec", "- [C](http://c)"])), "line_no int, line string")
    assert [tuple(r) for r in catalog.parse_list(lines).orderBy("index").collect()] == [(0, "A", "http://a", "Dev", True), (1, "B", "http://b", "Dev", False), (2, "C", "http://c", "Sec", True)]
    h = documents.Heading("en", "2026-04-06", "05:30")
    items = spark.range(25).select(F.col("id").alias("pos"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("s").alias("source"))
    out = documents.brief_section(items, h, 0).orderBy(*documents.ORDER).collect()
    assert [r["line"] for r in out[:3]] == ["## Tech Updates", "", "- [t](u) — *s*"] and [r["line"] for r in out[-3:]] == ["- ……等 5 条", "", ""] and len(out) == 25
    text = ["# One", "", "> q", "---", "## Sub", "", "---", "", "---", "", "end", "", "*Generated at x UTC*"]
    both = documents.merged([documents.given(spark, 0, text), documents.given(spark, 0, ["# Two 🧠 x", "body"])], h).orderBy(*documents.ORDER).collect()
    assert [r["line"] for r in both] == [
        "# 📰 Daily — 2026-04-06", "", "> 📡 One · Two 🧠 x", "", "> 🕐 Generated at 05:30 UTC", "", "---", "", "## 📑 Table of Contents", "", "- [One](#one)", "- [Two 🧠 x](#two-x)", "", "---", "",
        "## One", "", "##### Sub", "", "---", "end", "", "---", "", "## Two 🧠 x", "", "body",
    ]
    asked = models.ask(spark.createDataFrame([("hi",)], "prompt string"), "prompt", lambda p, profile: '```json\n{"a": 1}\n```')
    assert asked.select(models.parsed(F.col("response"), "a int").alias("x")).collect()[0]["x"]["a"] == 1
    assert models.ask(spark.createDataFrame([("hi",)], "prompt string"), "prompt", None).collect()[0]["response"] is None


def test_tracker(spark):
    a = spark.createDataFrame([(1, "t", "https://e.com/1?utm_source=x", "s"), (2, "t", "https://e.com/1", "s"), (3, "t", "https://e.com/2", "s")], "pos long, title string, url string, source string")
    tracker = spark.createDataFrame([], "id string, title string, source string, processed_at string")
    new, rows = dedup.unseen(a, tracker, F.lit("2026-04-06T00:00:00"))
    assert sorted(r["pos"] for r in new.collect()) == [1, 3]
    assert dedup.unseen(a, rows, F.lit("x"))[0].count() == 0
    old = spark.createDataFrame([("a", "2020-01-01T00:00:00"), ("b", "2026-04-01T00:00:00"), ("c", "?"), ("d", None)], "id string, processed_at string")
    assert [r["id"] for r in dedup.unexpired(old, F.lit("2026-04-06").cast("timestamp")).collect()] == ["b"]


def test_streaming_first_seen(spark, tmp_path):
    rows = [("https://e.com/1?ref=a", "2026-04-06 00:00:00"), ("https://e.com/1", "2026-04-06 01:00:00"), ("https://e.com/2", "2026-04-06 02:00:00")]
    spark.createDataFrame(rows, "url string, t string").select("url", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = seen.first_seen(spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*), count(DISTINCT id) FROM seen").collect()[0][:2] == (2, 2)


@pytest.mark.parametrize("span", [4, 7, 1000])
def test_values_carried_over_ranges(spark, span):
    r = random.Random(span)
    rows = [(k * 2 - 20, r.choice("ab"), r.choice([None, None, None, k])) for k in range(60)]
    df = spark.createDataFrame(rows, "pos long, g string, v int").repartition(5)
    for ahead in (False, True):
        for own in (False, True):
            got = {x["pos"]: x["c"] for x in numbering.carried(df, F.col("v"), "c", ["g"], span=span, ahead=ahead, own=own).collect()}
            for pos, g, _ in rows:
                seen_ = [v for p, h, v in rows if h == g and v is not None and ((p >= pos if own else p > pos) if ahead else (p <= pos if own else p < pos))]
                assert got[pos] == (None if not seen_ else seen_[0] if ahead else seen_[-1])


def test_long_lists_and_sections_by_ranges(spark):
    from pyspark.sql.window import Window

    n = F.col("id")
    line = F.when(n % 97 == 5, F.concat(F.lit("## C"), n.cast("string"))).when(n % 3 == 0, F.concat(F.lit("- [n"), n.cast("string"), F.lit("](u)"))).otherwise("text")
    lines = spark.range(20_000).select(n.cast("int").alias("line_no"), line.alias("line")).repartition(7)
    got = catalog.parse_list(lines, span=512)
    assert "Window" in got._jdf.queryExecution().toString()
    order = Window.orderBy("line_no")
    head = F.nullif(F.regexp_extract("line", "^##\\s+(.+?)\\s*$", 1), F.lit(""))
    want = lines.withColumn("category", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("line LIKE '- %'").select((F.row_number().over(order) - 1).alias("index"), "category")
    assert sorted(tuple(r) for r in got.select("index", "category").collect()) == sorted(tuple(r) for r in want.collect())
    r = random.Random(8)
    text_ = [r.choice(["---", "", "", "a", "b", "---"]) for _ in range(300)]
    rows = [(s, k, x) for s in (0, 1) for k, x in enumerate(["# T", "", "---", *text_[s * 150 : s * 150 + 150], "z", "", "---", "*x UTC*"], 1)]
    df = spark.createDataFrame(rows, "sec int, n long, line string")
    small, whole = (sorted(tuple(x) for x in documents._body(df, span).collect()) for span in (5, 1 << 16))
    assert small == whole and 100 < len(small) < 300


def test_reports_look_at_their_articles_once(spark):
    a = spark.createDataFrame([(k, f"t{k}", f"https://e.com/{k}", "s", "cloud", ["must_read", "noteworthy", "brief"][k % 3]) for k in range(9)], "pos long, title string, url string, source string, category string, tier string")
    summaries = a.select("url", F.lit("S").alias("ai_summary"), F.lit("AI/ML").alias("category"), "tier", F.lit("r").alias("importance_reason"))
    results = documents.results_from_summaries(documents.with_summaries(a.drop("tier"), summaries))
    h = documents.Heading("en", "d", "t")
    for made, most in ((documents.tiered_sections(results, h, 0), 4), (documents.tiered_report(results, h), 4)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most, plan
        assert made.count() > 20


@pytest.mark.parametrize("threshold", [0.25, 0.4, 0.85])
def test_similar_sets_and_components_against_all_pairs(spark, threshold):
    r = random.Random(int(threshold * 100))
    vocabulary = ["the"] * 12 + ["of"] * 6 + [f"w{k}" for k in range(60)]
    rows = sorted({" ".join(sorted({r.choice(vocabulary) for _ in range(r.randint(1, 9))})) for _ in range(260)})
    near = [" ".join(sorted({*x.split()[:-1], r.choice(vocabulary)})) for x in rows if len(x.split()) > 6]
    sets = [set(x.split()) for x in sorted({*rows, *near})]
    groups = setjoin.cut(setjoin.grouped(spark.createDataFrame([(sorted(s),) for s in sets], "ws array<string>"), F.col("ws")))
    names = {frozenset(x["words"]): x["gid"] for x in groups.collect()}
    links = {tuple(sorted((names[frozenset(a)], names[frozenset(b)]))) for i, a in enumerate(sets) for b in sets[:i] if len(a & b) / len(a | b) > threshold}
    assert {tuple(x) for x in setjoin.similar(groups, threshold).collect()} == links and links
    parent = {g: g for g in names.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {g: root(g) for g in parent}
    for rare, block in ((64, 2048), (3, 4)):
        assert {x["gid"]: x["root"] for x in setjoin.connected(groups, threshold, rare, block).collect()} == want


@pytest.mark.parametrize("words", [2, 3])
def test_a_word_of_very_many_sets(spark, words):
    """200,000 titles share a word: with one more it links all of them, with two it links none."""
    k = F.col("id").cast("string")
    sets = spark.range(200_000).select(F.array(F.lit("all"), *[F.concat(F.lit(c), k) for c in "ab"[: words - 1]]).alias("ws"))
    groups = setjoin.cut(setjoin.grouped(sets, F.col("ws")))
    found = setjoin.connected(groups, 0.25).agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots")).collect()[0]
    assert tuple(found) == (200_000, 1 if words == 2 else 200_000)


def test_pairs_of_words_of_very_many_sets(spark):
    """30,000 alike sets share pairs of words, of which 10,000 others have one as well that is too common to count: cells of one label never meet (F6 to F10)."""
    k = F.col("id").cast("string")
    alike = F.array(*[F.lit(w) for w in "abcdefghi"], *[F.concat(F.lit(c), k) for c in "stuvwx"])
    apart = F.array(F.lit("a"), F.lit("b"), *[F.concat(F.lit(c), k) for c in "nopqrstuvwxyz"])
    sets = spark.range(30_000).select(alike.alias("ws")).union(spark.range(100_000, 110_000).select(apart.alias("ws")))
    groups = setjoin.cut(setjoin.grouped(sets, F.col("ws")))
    listed, star = setjoin._paired(setjoin._coded(groups), 0.25)
    assert star.isEmpty() and listed.agg(F.max("df")).collect()[0][0] == 30_000
    assert setjoin._across(listed.withColumn("label", F.lit(1).cast("long")).withColumn("codes", F.array(F.lit(1).cast("long"))), 0.25, 2048).isEmpty()
    found = setjoin.connected(groups, 0.25).groupBy("root").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {tuple(x) for x in found} == {(30_000, 1), (1, 10_000)}


def test_account_reports_number_what_they_show(spark, monkeypatch):
    """Whole texts aren't dealt out with the numbers (F14)."""
    dealt, numbered = [], numbering.by_category
    monkeypatch.setattr(numbering, "by_category", lambda rows, *a, **b: dealt.append(rows) or numbered(rows, *a, **b))
    a = spark.createDataFrame([(0, "t", "u", "s", "wechat_dev", "x|" * 5000, "y"), (1, "t", "v", "s", None, None, "y")], "pos long, title string, url string, source string, category string, description string, full_text string")
    lines = [r["line"] for r in documents.account_report(a, a.where("pos = 1").select("url", F.lit("sum").alias("summary")), documents.Heading()).orderBy(*documents.ORDER).collect()]
    assert sum("x\\|" * 75 + "..." in x for x in lines) == 1 and sum("sum" in x for x in lines) == 1
    assert "full_text" not in dealt[0].columns and dealt[0].agg(F.max(F.length("description"))).collect()[0][0] == 153
