"""The command line: collect, repeat, finalize."""

from newsdesk import __main__ as cli
from newsdesk.sources import workspace

SCHEMA = "pos long, title string, url string, source string, category string, description string, language string, published timestamp, priority int, hn_points int, full_text string"


def test_collect_and_finalize(spark, tmp_path):
    from datetime import datetime

    new, old = datetime(2026, 4, 6, 0), datetime(2026, 4, 1)
    rows = [
        (0, "Alpha release today", "https://e.com/1", "OpenAI Blog", "ai_ml", "first", "en", new, 1, None, ""),
        (1, "Alpha release today", "https://e.com/2", "Other", "ai_ml", "copy", "en", new, 3, None, ""),
        (2, "Old piece here", "https://e.com/3", "Other", "cloud", "old", "en", old, 3, None, ""),
        (3, "Undated piece", "https://e.com/4", "Other", "cloud", "kept", "en", None, 3, None, ""),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    work = str(tmp_path / "w")
    args = ["--source", "tech", "--workspace", work, "--now", "2026-04-06 05:30:00"]
    run = lambda *more: cli.main([*args, *more], lambda: spark)
    assert run() == 2
    assert run("--articles", str(tmp_path / "in")) == 0
    assert sorted(r["pos"] for r in spark.read.parquet(f"{work}/articles").collect()) == [0, 3]
    assert workspace.load_tracker(spark, f"{work}/tracker").count() == 2
    assert run("--finalize") == 0
    text = next((tmp_path / "w" / "report-tech").glob("part-*")).read_text()
    assert "[**Alpha release today**](https://e.com/1)" in text and "Undated piece" in text
    (tmp_path / "w" / "summaries").mkdir()
    (tmp_path / "w" / "summaries" / "b1.json").write_text('{"url": "https://e.com/1", "ai_summary": "S", "category": "AI/ML", "tier": "must_read"}')
    assert run("--finalize", "--language", "en") == 0
    text = next((tmp_path / "w" / "report-tech").glob("part-*")).read_text()
    assert text.startswith("# 📰 Daily — 2026-04-06\n\n> 🤖 AI Deep Analysis 1 articles · 💻 Tech Updates 1 items · Total 2\n") and "**1. [Alpha release today](https://e.com/1)**" in text
    assert run("--finalize", "--language", "en", "--format", "wechat") == 0
    assert "- Alpha release today" in next((tmp_path / "w" / "report-tech").glob("part-*")).read_text()
    said = lambda prompt, profile: None if "{" in prompt else "**deep**"
    assert cli.main([*args, "--finalize", "--language", "en"], lambda: spark, said) == 0
    text = next((tmp_path / "w" / "report-tech").glob("part-*")).read_text()
    assert "**deep**" in text and "## 📌 TL;DR" in text
    assert cli.main(["--source", "podcast", "--workspace", work, "--finalize"], lambda: spark) == 3
    assert cli.main(["--source", "tech", "--workspace", str(tmp_path / "none"), "--finalize"], lambda: spark) == 1
    assert run("--articles", str(tmp_path / "in")) == 0
    assert workspace.load_tracker(spark, f"{work}/tracker").count() == 2


RSS = "<rss><channel><item><title>{0} one</title><link>https://{0}.com/1</link><pubDate>2026-04-06 01:00:00</pubDate></item></channel></rss>"


def test_collect_from_feeds(spark, tmp_path):
    from newsdesk.sources import http

    (tmp_path / "feeds.json").write_text('{"categories": [{"id": "cloud", "feeds": [{"name": "A", "url": "https://a"}, {"name": "B", "url": "https://b", "priority": 1}]}]}')
    document = RSS

    def transport(url, headers, timeout, relaxed):
        if url == "https://b":
            raise OSError("Connection refused")
        return http.Reply(document.replace("{0}", "a"), 200, "tag")

    fetch = http.Fetcher(transport, attempts=2, pause=lambda s: None)
    work = str(tmp_path / "w")
    args = ["--feeds", str(tmp_path / "feeds.json"), "--workspace", work, "--now", "2026-04-06 05:30:00"]
    assert cli.main(args, lambda: spark, None, fetch) == 0
    kept = spark.read.parquet(f"{work}/articles").collect()
    assert [(r["title"], r["source"], r["category"], r["priority"]) for r in kept] == [("a one", "A", "cloud", 3)]
    assert [tuple(r) for r in http.load_cache(spark, f"{work}/cache").collect()] == [("https://a", "tag", None)]
