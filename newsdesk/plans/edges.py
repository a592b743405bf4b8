"""Queries of the engine's edges: parsing feeds, fetching through a given transport, what is written and read back, and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents
from ..sources import feeds, http, workspace
from ..storage import new_path
from ..streaming import seen
from .documents import EN
from .inputs import table


def src03_feed_items(spark, sf):
    """RSS and Atom documents with entities that XML lacks, parsed; every eleventh can't be read."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    rss = F.concat(F.lit("<rss><channel><title>x</title><item><title>A &mdash; "), k, F.lit("</title><link>https://r/"), k, F.lit("</link><pubDate>2026-04-06</pubDate><description>Points: "), k, F.lit(" # Comments: 7</description></item><item><title>B &eacute; &amp;</title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E &ldquo;'), k, F.lit('</title><link rel="self" href="https://s"/><link rel="alternate" href="https://a/'), k, F.lit('"/><updated>2026-04-07</updated><summary>s&nbsp;</summary></entry></feed>'))
    xml = F.when(F.col("c_custkey") % 11 == 0, "<rss>").when(F.col("c_custkey") % 2 == 0, rss).otherwise(atom)
    items = feeds.explode_items(c.select(k.alias("feed"), xml.alias("xml")))
    return items.select("feed", F.col("pos").cast("long").alias("pos"), "title", "link", "pub_date_raw", "description", F.col("hn_points").cast("long").alias("hn_points"), F.col("hn_comments").cast("long").alias("hn_comments"))


def _served(url, headers, timeout, relaxed):
    k = int(url.rsplit("/", 1)[1])
    if k % 5 == 0:
        raise OSError("Connection refused")
    if k % 7 == 0:
        return http.Reply(None, 404)
    return http.Reply(None, 304) if headers.get("If-None-Match") == f"e{k}" else http.Reply(f"b{k}", 200, f"e{k}")


def _fetched(spark, sf):
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://h"), (k % 6).cast("string"), F.lit(".com/"), k.cast("string"))
    o = table(spark, sf, "orders").select(url.alias("url"), k.alias("k")).dropDuplicates(["url"])
    cache = o.where("k % 3 = 0").select("url", F.concat(F.lit("e"), F.col("k").cast("string")).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    return http.fetched(o, cache, http.Fetcher(_served, attempts=1)), cache


def src13_conditional_fetch(spark, sf):
    """Pages fetched with what is known of them: unchanged, new, missing and unreachable ones."""
    replies, _ = _fetched(spark, sf)
    return replies.select("k", F.col("status").cast("long").alias("status"), "body", "etag")


def snk02_http_cache(spark, sf):
    """The cache after the fetch, written, replaced and read back."""
    replies, cache = _fetched(spark, sf)
    path = new_path(spark, "cache")
    http.save_cache(cache, path)
    http.save_cache(http.renewed(http.load_cache(spark, path), replies), path)
    return http.load_cache(spark, path).select("url", "etag")


def snk01_workspace(spark, sf):
    """Articles of two sources kept, one of them replaced, and what a report of the first has."""
    path = new_path(spark, "kept")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "source")
    workspace.save(d, path, "tech")
    workspace.save(d.where("pos % 2 = 0"), path, "podcast")
    workspace.save(d.where("pos % 3 = 0"), path, "wechat")
    workspace.save(d.where("pos % 5 = 0"), path, "tech")
    return workspace.load_for(spark, path, "tech").groupBy("kept_source").agg(F.count("*").alias("n"), F.sum("pos").alias("ids"))


def snk03_tracker(spark, sf):
    """The tracker appended to twice and rewritten without expired rows."""
    path = new_path(spark, "tracker")
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("s").alias("source"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("processed_at"))
    workspace.append_tracker(e.where("cast(id AS long) % 2 = 0"), path)
    workspace.append_tracker(e.where("cast(id AS long) % 2 = 1"), path)
    from ..operators import dedup

    workspace.rewrite_tracker(dedup.unexpired(workspace.load_tracker(spark, path), F.lit("2024-02-10 00:00:00").cast("timestamp")), path)
    return workspace.load_tracker(spark, path).agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


def snk04_report_file(spark, sf):
    """A report's file, read back: lines by their length."""
    path = new_path(spark, "report")
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("title"), F.lit("u").alias("url"), F.lit("s").alias("source"))
    workspace.write_report(documents.brief_section(r, EN, 0, 3), path, documents.ORDER)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def clu08_trends(spark, sf):
    """Topics with three articles or more of two sources in 48 hours, every hour."""
    e = table(spark, sf, "events").select("ts", F.col("event_type").alias("topic"), F.col("user_id").alias("source"))
    return seen.trends(e).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("begins"), "topic", "n")


QUERIES = [src03_feed_items, src13_conditional_fetch, snk01_workspace, snk02_http_cache, snk03_tracker, snk04_report_file, clu08_trends]

_PAGES = "p AS (SELECT DISTINCT o_orderkey AS k, 'https://h' || o_orderkey % 6 || '.com/' || o_orderkey AS url FROM orders)"
ORACLES = {
    "src03_feed_items": """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 11 > 0)
        SELECT k::VARCHAR AS feed, 0 AS pos, 'A — ' || k AS title, 'https://r/' || k AS link, '2026-04-06' AS pub_date_raw, 'Points: ' || k || ' # Comments: 7' AS description, k AS hn_points, 7 AS hn_comments FROM c WHERE k % 2 = 0
        UNION ALL SELECT k::VARCHAR, 1, 'B é &', '', '', '', NULL, NULL FROM c WHERE k % 2 = 0 UNION ALL SELECT k::VARCHAR, 0, 'E "' || k, 'https://a/' || k, '2026-04-07', 's', NULL, NULL FROM c WHERE k % 2 = 1""",
    "src13_conditional_fetch": f"""WITH {_PAGES} SELECT k, CASE WHEN k % 5 = 0 THEN -4 WHEN k % 7 = 0 THEN 404 WHEN k % 3 = 0 THEN 304 ELSE 200 END AS status, CASE WHEN k % 5 > 0 AND k % 7 > 0 AND k % 3 > 0 THEN 'b' || k END AS body,
        CASE WHEN k % 5 > 0 AND k % 7 > 0 THEN 'e' || k END AS etag FROM p""",
    "snk02_http_cache": f"WITH {_PAGES} SELECT url, 'e' || k AS etag FROM p WHERE k % 3 = 0 OR (k % 5 > 0 AND k % 7 > 0)",
    "snk01_workspace": "SELECT 'tech' AS kept_source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'wechat', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id % 3 = 0",
    "snk03_tracker": "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-11 00:00:00'",
    "snk04_report_file": """WITH l AS (SELECT '## Tech Updates' AS line UNION ALL SELECT '' UNION ALL SELECT * FROM (SELECT '- [' || r_name || '](u) — *s*' FROM region ORDER BY r_regionkey LIMIT 3) UNION ALL SELECT '- ……等 ' || (count(*) - 3) || ' 条' FROM region UNION ALL SELECT '' UNION ALL SELECT '')
        SELECT line, count(*) AS n FROM l GROUP BY 1""",
    "clu08_trends": """WITH w AS (SELECT event_type AS topic, user_id, date_trunc('hour', ts) - to_hours(unnest(range(48))::INTEGER) AS s FROM events), g AS (SELECT s, topic, count(*) AS n, count(DISTINCT user_id) AS sources FROM w GROUP BY 1, 2)
        SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS begins, topic, n FROM g WHERE n >= 3 AND sources >= 2""",
}
