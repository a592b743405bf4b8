"""Queries over streams made of the tables: rounds of fetching with kept state, seen ids with a time to live, lists that are refreshed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..sources import http
from ..storage import new_path
from ..streaming import lists, rounds, seen
from .inputs import table


def _feed(url, headers, timeout, relaxed):
    """Every fifth feed can't be reached, every third of the others stays as it is; the rest have a new item once they are asked again."""
    k = int(url.rsplit("/", 1)[1])
    if k % 5 == 0:
        raise OSError("Connection refused")
    known = headers.get("If-None-Match")
    if known and (k % 3 == 0 or known == "second"):
        return http.Reply(None, 304)
    items = range(3 if known else 2)
    body = "".join(f"<item><title>Item {i} of {k}</title><link>https://f/{k}/{i}</link></item>" for i in items)
    return http.Reply(f"<rss><channel>{body}</channel></rss>", 200, "second" if known else "first")


def _rounds(spark, sf, count):
    """The replies of so many rounds over the suppliers' feeds; every round is a restart of the query."""

    class Suppliers(rounds.RoundSource):
        fetch = http.Fetcher(_feed, attempts=1)

        @classmethod
        def name(cls):
            return "newsdesk_supplier_rounds"

    spark.dataSource.register(Suppliers)
    urls = [r["url"] for r in table(spark, sf, "supplier").select(F.concat(F.lit("https://f/"), F.col("s_suppkey").cast("string")).alias("url")).collect()]  # a catalogue of feeds
    state, kept, out = (new_path(spark, x) for x in ("rounds", "checkpoint", "replies"))
    for _ in range(count):
        stream = spark.readStream.format("newsdesk_supplier_rounds").option("state", state.removeprefix("file://").removeprefix("file:")).option("urls", "\n".join(urls)).option("lanes", 4).load()
        stream.writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rounds.REPLY).parquet(out)


def st01_fetch_rounds(spark, sf):
    """What every round was told of every feed, and how many items that brought."""
    replies = _rounds(spark, sf, 3)
    items = rounds.articles(replies.withColumn("url", F.concat_ws(" ", "round", "url"))).groupBy("feed").agg(F.count("*").alias("items"), F.max("title").alias("last"))
    joined = replies.join(items, F.concat_ws(" ", "round", "url") == F.col("feed"), "left")
    return joined.select("round", "url", F.col("status").cast("long").alias("status"), "etag", F.coalesce("items", F.lit(0)).alias("items"), "last")


def st02_seen_once(spark, sf):
    """The items of two rounds, each at the round that brought it first."""
    first = rounds.articles(_rounds(spark, sf, 2).withColumn("url", F.concat_ws(" ", "round", "url"))).groupBy("id").agg(F.min(F.struct(F.substring_index("feed", " ", 1).cast("long").alias("round"), "title")).alias("x"))
    return first.select("x.round", "x.title")


_TTL = timedelta(days=3)


def _sightings(spark, sf):
    """Events as sightings of articles: the user's number is the article's, the event's its position."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.col("event_type").alias("source"), F.col("event_id").alias("pos"), "ts")


def st03_seen_state(spark, sf):
    """Ids that are new and removed again as the events stream by in five parts, with a time to live of three days that sightings renew."""
    path, kept, out = (new_path(spark, x) for x in ("sightings", "checkpoint", "seen"))
    rows = _sightings(spark, sf)
    for day in range(0, 35, 7):
        low, high = (F.lit(datetime(2024, 1, 1) + timedelta(days=d)) for d in (day, day + 7))
        part = rows.where(((F.col("ts") >= low) | F.lit(day == 0)) & ((F.col("ts") < high) | F.lit(day == 28)))
        part.coalesce(1).write.mode("append").parquet(path)
    with seen.keyed_state(spark):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        events = seen.tracked(stream, _TTL)
        events.writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(seen.EVENT).parquet(out).groupBy("id", "event").agg(F.count("*").alias("n"), F.min("title").alias("title"))


def st04_list_refresh(spark, sf):
    """Events by the account of their user, as a list has it that the triggers, four days apart, refresh weekly; the second refresh fails."""
    path, kept, out, accounts = (new_path(spark, x) for x in ("events", "checkpoint", "joined", "accounts"))
    e = table(spark, sf, "events").select((F.col("user_id") % 12).cast("int").alias("account"), "event_id")
    for k in range(5):
        e.where(F.col("event_id") % 5 == k).coalesce(1).write.mode("append").parquet(path)
    asked, started = [], []

    def fetch():
        asked.append(1)
        n = len(asked)
        return None if n == 2 else "## Dev\n" + "\n".join(f"- [v{n} a{i}](http://a/{i})" for i in range(10))

    def now():
        started.append(1)
        return datetime(2024, 1, 1) + timedelta(days=4 * (len(started) - 1))

    join = lambda batch, rows: batch.join(rows.select("index", "name"), F.col("account") == F.col("index")).select("event_id", "name")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    lists.with_accounts(stream, join, accounts, fetch, out, kept, now, {"availableNow": True}).awaitTermination()
    return lists.written(spark, out, "event_id long, name string").groupBy("batch", "name").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES = [st01_fetch_rounds, st02_seen_once, st03_seen_state, st04_list_refresh]

_ITEMS = """r AS (SELECT unnest([1, 2, 3]) AS round), s AS (SELECT round, s_suppkey AS k, 'https://f/' || s_suppkey AS url FROM supplier, r),
        a AS (SELECT round, k, url, CASE WHEN k % 5 = 0 THEN -4 WHEN round = 1 OR (round = 2 AND k % 3 > 0) THEN 200 ELSE 304 END AS status, CASE WHEN k % 5 = 0 THEN NULL WHEN round = 1 OR k % 3 = 0 THEN 'first' ELSE 'second' END AS etag FROM s),
        b AS (SELECT *, CASE WHEN status = 200 THEN round + 1 ELSE 0 END AS items FROM a)"""
ORACLES = {
    "st01_fetch_rounds": f"WITH {_ITEMS} SELECT round, url, status, etag, items, CASE WHEN items > 0 THEN 'Item ' || (items - 1) || ' of ' || k END AS last FROM b",
    "st02_seen_once": f"WITH {_ITEMS} SELECT min(round) AS round, 'Item ' || i || ' of ' || k AS title FROM (SELECT round, k, unnest(range(items)) AS i FROM b WHERE round < 3) GROUP BY k, i",
    "st03_seen_state": """WITH e AS (SELECT user_id::VARCHAR AS id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 3 DAY, true) AS begun FROM events),
        r AS (SELECT *, sum(begun::INTEGER) OVER (PARTITION BY id ORDER BY ts, event_id) AS run FROM e), s AS (SELECT id, run, 't' || arg_min(event_id, (ts, event_id)) AS title, max(ts) AS last FROM r GROUP BY 1, 2),
        g AS (SELECT *, lead(run) OVER (PARTITION BY id ORDER BY run) IS NOT NULL OR last + INTERVAL 3 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS gone FROM s)
        SELECT id, 'new' AS event, count(*) AS n, min(title) AS title FROM g GROUP BY 1 UNION ALL SELECT id, 'removed', count(*), min(title) FROM g WHERE gone GROUP BY 1""",
    "st04_list_refresh": """SELECT event_id % 5 AS batch, 'v' || CASE WHEN event_id % 5 < 3 THEN 1 ELSE 3 END || ' a' || user_id % 12 AS name, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE user_id % 12 < 10 GROUP BY 1, 2""",
}
