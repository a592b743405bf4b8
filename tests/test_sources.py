"""Fetching, caches, catalogues, model calls, enrichment and documents: errors, nulls, empties."""

from datetime import datetime

from newsdesk.operators import documents, numbering
from newsdesk.sources import catalog, enrich, http, models, workspace
from pyspark.sql import functions as F


def test_fetcher():
    seen, waits = [], []

    def transport(url, headers, timeout, relaxed):
        seen.append((headers.get("If-None-Match"), relaxed))
        if url == "tls":
            if relaxed:
                return http.Reply("late", 200)
            raise OSError("SSL: CERTIFICATE_VERIFY_FAILED")
        if url == "known":
            return http.Reply(None, 304)
        if url == "flaky" and len(seen) < 3:
            raise TimeoutError("timed out")
        return http.Reply("body", 200, "e2", "m2") if url != "gone" else http.Reply(None, 404)

    fetch = http.Fetcher(transport, pause=waits.append)
    assert fetch("known", "e1") == http.Reply(None, 304, "e1") and seen == [("e1", False)]
    seen.clear()
    assert fetch("flaky").body == "body" and len(waits) == 2 and 2 <= waits[0] <= 3 and 4 <= waits[1] <= 5
    assert fetch("gone").status == 404 and fetch.once("tls").status == -5
    assert http.Fetcher(transport, unverified=True).once("tls").body == "late"
    errors = (TimeoutError("x timed out"), OSError("getaddrinfo failed"), ConnectionResetError(), BrokenPipeError(), OSError("bad certificate"), OSError("?"))
    assert [http.error_status(e) for e in errors] == [-2, -3, -4, -4, -5, -1]


def test_fetched_and_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert http.load_cache(spark, path).count() == 0
    http.save_cache(spark.createDataFrame([("https://h/1", "e", None), ("https://h/3", "old", None)], http.CACHE), path)

    def transport(url, headers, timeout, relaxed):
        if url.endswith("3"):
            raise OSError("refused")
        return http.Reply(None, 304) if headers.get("If-None-Match") == "e" else http.Reply("b", 200, "new")

    urls = spark.createDataFrame([(f"https://h/{k}", k) for k in (1, 2, 3)], "url string, k int")
    replies = http.fetched(urls, http.load_cache(spark, path), http.Fetcher(transport, attempts=1), 0.01).cache()
    assert [(r["k"], r["body"], r["status"], r["etag"]) for r in replies.orderBy("k").collect()] == [(1, None, 304, "e"), (2, "b", 200, "new"), (3, None, -1, None)]
    http.save_cache(http.renewed(http.load_cache(spark, path), replies), path)
    assert sorted(tuple(r) for r in http.load_cache(spark, path).collect()) == [("https://h/1", "e", None), ("https://h/2", "new", None), ("https://h/3", "old", None)]
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["cache"]


def test_account_list(spark, tmp_path):
    path, now = str(tmp_path / "accounts"), datetime(2026, 4, 6)
    assert catalog.account_list(spark, path, lambda: None, now).count() == 0
    text = "## Dev\n- [A](http://a)\n- ~~[B](http://b)~~"
    assert catalog.account_list(spark, path, lambda: text, now).count() == 2
    assert catalog.account_list(spark, path, lambda: "", datetime(2026, 4, 12)).count() == 2  # young enough
    assert catalog.account_list(spark, path, lambda: None, datetime(2026, 4, 20)).count() == 2  # old, but nothing newer
    assert catalog.account_list(spark, path, lambda: "", datetime(2026, 4, 20)).count() == 0
    assert [r["name"] for r in catalog.active(catalog.account_list(spark, path, lambda: text, now, True)).collect()] == ["A"]


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "tech_feeds.json").write_text('{"categories": [{"id": "c", "feeds": [{"name": "n", "url": "u"}, {"name": "m", "url": ""}]}]}')
    assert [tuple(r) for r in catalog.read_feeds(spark, catalog.catalogue_path(spark, str(tmp_path), "other")).collect()] == [("c", "n", "u", "en", 3, None)]
    for missing in ("podcast", "wechat"):
        try:
            catalog.catalogue_path(spark, str(tmp_path), missing)
        except FileNotFoundError:
            continue
        raise AssertionError
    (tmp_path / "p.json").write_text('{"podcasts": [{"name": "a", "url": "u", "category": "x"}, {"name": "b", "url": "v", "category": "y"}, {"name": "c", "url": ""}], "settings": {"count": 2}}')
    assert [r["name"] for r in catalog.read_podcasts(spark, str(tmp_path / "p.json")).collect()] == ["a", "b"]
    (tmp_path / "v.json").write_text('{"channels": [{"name": "a", "url": "u", "category": "x"}]}')
    assert [tuple(r) for r in catalog.read_channels(spark, str(tmp_path / "v.json")).collect()] == [("a", "u", "x", "en", 3)]


def test_workspace_state(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert workspace.load_metadata(spark, path).count() == 0 and workspace.load_insight(spark, path) == ""
    for k, at in ((1, "2026-01-01"), (2, "2026-01-02")):
        workspace.save_metadata(spark, path, "tech", k, 25, k, at)
    assert [r["checked"] for r in workspace.load_metadata(spark, path).collect()] == [2]
    (tmp_path / "i.json").write_text('{"trend_insight": "up"}')
    assert workspace.load_insight(spark, str(tmp_path / "i.json")) == "up"
    state = str(tmp_path / "tracker")
    workspace.append_tracker(spark.createDataFrame([("a", "t", "s", "2020"), ("b", "t", "s", "2026")], workspace.TRACKER), state)
    workspace.rewrite_tracker(workspace.load_tracker(spark, state).where("id = 'b'"), state)
    assert [r["id"] for r in workspace.load_tracker(spark, state).collect()] == ["b"]
    assert workspace.sources_of("tech") == ("tech", "wechat") and workspace.sources_of("podcast") == ("podcast",)


ARTICLE = "pos long, title string, url string, source string, category string, description string, language string, hn_points int, hn_comments int, editorial_tier string, cross_source boolean, full_text string, cluster_size int, theme string, priority int, transcript string"


def test_model_stages_without_answers(spark):
    a = spark.createDataFrame([(1, "GPT news", "u", "s", "cloud", None, "en", None, None, None, None, None, None, None, 1, None), (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)], ARTICLE)
    none = a.where("false")
    assert {r["pos"]: r["is_ai"] for r in models.classified(a, None).collect()} == {1: True, 2: False}
    assert models.classified(none, None).count() == models.batch_summaries(a, "podcast", None).count() == models.category_summaries(a, None).count() == 0
    assert models.executive_summary(models.category_summaries(a, None), None).count() == 0
    assert models.structure(a, None) is None and models.structure(a, lambda p, _: '{"highlights": []}') is None
    assert models.deep_analysis(a, None) is None and models.tldr(documents.given(spark, 0, ["x"]), None) == ""
    waits = []

    def down(prompt, profile):
        raise OSError

    asked = spark.createDataFrame([("p",), (None,)], "prompt string")
    assert [r["response"] for r in models.ask(asked, "prompt", down, pause=lambda s: None).collect()] == [None, None]
    assert models.Profile.of("classify").max_tokens == 2000 and models.Profile.of("?") == models.Profile.of("summarize")
    assert models.Endpoint.from_env({}) is None and models.Endpoint.from_env({"API_KEY": "k", "BASE_URL": "b/", "MODEL": "m"}).base_url == "b"
    assert not waits


def test_documents_of_nothing_and_of_nulls(spark):
    h = documents.Heading("en", "d", "t")
    a = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)], ARTICLE)
    for rows in (a, a.where("false")):
        summed = documents.with_summaries(rows, spark.createDataFrame([], workspace.SUMMARY))
        results = documents.results_from_summaries(summed)
        items = documents.items_of(results, summed)
        made = (
            documents.tech_report(summed, h), documents.tiered_report(results, h), documents.other_news(rows, h), documents.listing(summed, h), documents.unified(summed, rows, h, False),
            documents.platform_article(items, rows, h), documents.account_report(rows, spark.createDataFrame([], "url string, summary string"), h),
        )
        for d in made:
            assert d.columns == [*documents.ORDER, "line"] and all(r["line"] is not None for r in d.collect())
    assert documents.listing(a.where("false").withColumn("ai_summary", F.lit("")), h).count() == 0


def test_numbering_within_groups(spark):
    rows = [(k * 7, "ab"[k % 2] if k % 5 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "pos long, g string")
    got = {r["pos"]: r["number"] for r in numbering.within(df, ["g"], span=20).collect()}
    seen = {}
    for pos, g in rows:
        seen[g] = seen.get(g, 0) + 1
        assert got[pos] == seen[g]
    assert [r["n"] for r in numbering.ordered(df.repartition(5), ["pos"]).orderBy("pos").collect()] == list(range(1, 41))


def test_shows_without_pages(spark):
    u = spark.createDataFrame([("s", "t", "u"), ("s", "t", None)], "source string, title string, url string")
    assert enrich.shows_to_fetch(u, spark.createDataFrame([("s", "")], "name string, podcast_url string")).count() == 0
    assert [r["url"] for r in enrich.with_episodes(u, spark.createDataFrame([], "source string, body string")).orderBy("url").collect()] == [None, "u"]


def test_transcripts_of_a_limited_service(spark, tmp_path, monkeypatch):
    import json

    from newsdesk.functions import fixed
    from newsdesk.sources import transcripts

    assert not transcripts.configured({}) and transcripts.configured({fixed.TRANSCRIPT_KEY: "k"})
    log = str(tmp_path / "log")

    def transport(url, headers, timeout, relaxed):
        with open(log, "a") as f:
            f.write(json.dumps([url, timeout]) + "\n")
        if "missing" in url:
            return http.Reply(None, 404)
        asked = sum(url in line for line in open(log))
        return http.Reply(None, 429) if "often" in url or ("later" in url and asked < 2) else http.Reply('{"content": " said "}', 200)

    waits = []
    video = "https://www.youtube.com/watch?v="
    rows = [(1, video + "aaaaaaaaaaa"), (2, "https://youtu.be/aaaaaaaaaaa"), (3, video + "missing1234"), (4, video + "often567890"), (5, "https://e.com"), (6, None), (7, video + "later678901"), (8, video + "short")]
    a = spark.createDataFrame(rows, "pos long, url string")
    out = transcripts.with_transcripts(a, http.Fetcher(transport, pause=lambda s: None), delay=0.0, lanes=1, at_once=1)
    assert {r["pos"]: r["transcript"] for r in out.collect()} == {1: "said", 2: "said", 3: None, 4: None, 5: None, 6: None, 7: "said", 8: None}
    asked = [json.loads(x) for x in open(log)]
    count = lambda name: sum(name in u for u, _ in asked)
    assert (count("aaaaaaaaaaa"), count("missing"), count("often"), count("later")) == (1, 1, 3, 2) and {t for _, t in asked} == {60.0}
    # a limit has its own wait, and the key is taken from the environment where the request is made
    seen = []
    monkeypatch.setenv(fixed.TRANSCRIPT_KEY, "secret")
    fetch = transcripts.service(http.Fetcher(lambda u, h, t, r: seen.append(h["x-api-key"]) or http.Reply(None, 429), pause=waits.append))
    assert fetch("u").status == 429 and waits == [3.0, 3.0] and seen == ["secret"] * 3 and "secret" not in repr(fetch)


def test_a_cache_is_renewed_by_one_request_for_each_page(spark, tmp_path):
    """What the replies say is looked at twice; the pages are asked for once (F12)."""
    import uuid

    asked = tmp_path / "asked"
    asked.mkdir()

    def served(url, headers, timeout, relaxed):
        (asked / uuid.uuid4().hex).touch()
        return http.Reply("b", 200, "new " + url)

    urls = spark.createDataFrame([(f"https://h/{k}",) for k in range(20)], "url string")
    old = spark.createDataFrame([(f"https://h/{k}", "old", None) for k in range(10, 30)], http.CACHE)
    http.save_cache(old, str(tmp_path / "cache"))
    kept = http.load_cache(spark, str(tmp_path / "cache"))
    http.save_cache(http.renewed(kept, http.fetched(urls, kept, http.Fetcher(served, attempts=1))), str(tmp_path / "cache"))
    got = {r["url"]: r["etag"] for r in http.load_cache(spark, str(tmp_path / "cache")).collect()}
    assert got == {f"https://h/{k}": f"new https://h/{k}" if k < 20 else "old" for k in range(30)}
    assert len(list(asked.iterdir())) == 20
