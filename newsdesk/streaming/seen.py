"""Streaming deduplication and trends: article ids seen before, kept as state with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.urls import article_id

#: What :func:`tracked` gives: a row for each id that is new (with its first title), and one for each that was removed.
EVENT = "id string, event string, title string, source string, at timestamp"


def first_seen(articles: DataFrame, time: str = "ts", delay: str = "30 days") -> DataFrame:
    """The first article of each id; state older than the delay is dropped, as the tracker's time to live does for batches."""
    return articles.withColumn("id", article_id(F.col("url"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


_ROW = "id string, event string, title string, source string, micros long"


#: An id's first title and source, and when it was seen last (in microseconds).
_STATE = "title string, source string, micros long"


def _follow(ttl: timedelta, renews: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What a batch's rows of one id, or the end of its time to live, make of its state.

    The states come and go with the rows, many ids in one Arrow batch; calls to a state store for each id would cost a round trip each.
    """
    span = ttl // timedelta(microseconds=1)

    def each(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, out = (tuple(state.get) if state.exists else None), []
        if state.hasTimedOut:
            state.remove()
            yield _events([(key[0], "removed", *kept)])
            return
        # those of equal times in the order of their positions
        columns = ("micros", "pos", "title", "source")
        for at, _, title, source in sorted((x for r in rows for x in zip(*(r[c].tolist() for c in columns), strict=True)), key=lambda x: x[:2]):
            if kept is not None and at - kept[2] > span:
                out.append((key[0], "removed", *kept))
                kept = None
            if kept is None:
                kept = (title, source, at)
                out.append((key[0], "new", *kept))
            elif renews and at > kept[2]:
                kept = (kept[0], kept[1], at)
        end = (kept[2] + span) // 1000  # the last millisecond of its time to live
        if end < state.getCurrentWatermarkMs():
            out.append((key[0], "removed", *kept))
            if state.exists:
                state.remove()
        else:
            state.update(kept)
            state.setTimeoutTimestamp(end)
        if out:
            yield _events(out)

    return each


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "event", "title", "source", "micros"]).astype({"micros": "int64"})


def _sightings(articles: DataFrame, time: str) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    at = F.col(time).cast("timestamp")
    return articles.select("id", text("title"), text("source"), F.col("pos").cast("long").alias("pos"), at.alias("at"), F.unix_micros(at).alias("micros"))


def tracked(articles: DataFrame, ttl: timedelta = timedelta(days=30), time: str = "ts", delay: str = "1 hour", renews: bool = True) -> DataFrame:
    """Events of the ids of a stream of articles (id, title, source, pos, and their time), which the batch tracker's rules decide.

    An id is new if it wasn't seen within the time to live; its first title stays. Seeing it again renews its time (unless ``renews`` is
    off). It is removed when the stream's watermark passes its time to live, or when it is seen again after that. Rows of one id that
    come later than the delay are dropped. The state is as large as the ids within their time to live; run it in :func:`keyed_state`.
    """
    rows = _sightings(articles, time).withWatermark("at", delay)
    found = rows.groupBy("id").applyInPandasWithState(_follow(ttl, renews), _ROW, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("id", "event", "title", "source", F.timestamp_micros("micros").alias("at"))


def tracked_batch(articles: DataFrame, ttl: timedelta = timedelta(days=30), time: str = "ts", until: datetime | None = None, renews: bool = True) -> DataFrame:
    """The same events of a table with renewed times; until: the watermark at the end (none: nothing is removed for age alone)."""
    if not renews:
        raise ValueError("a fixed time to live depends on the order of arrival; use tracked()")
    rows = _sightings(articles, time)
    order = Window.partitionBy("id").orderBy("at", "pos")
    late = F.col("at") - F.lag("at").over(order) > F.lit(ttl)
    begun = F.coalesce(late, F.lit(True))
    marked = rows.withColumn("begun", begun).withColumn("run", F.sum(F.col("begun").cast("int")).over(order))
    runs = marked.groupBy("id", "run").agg(F.min(F.struct("at", "pos", "title", "source")).alias("first"), F.max("at").alias("last"))
    new = runs.select("id", F.lit("new").alias("event"), "first.title", "first.source", F.col("first.at").alias("at"))
    follows = F.lead("run").over(Window.partitionBy("id").orderBy("run")).isNotNull()
    old = F.col("last") + F.lit(ttl) < F.lit(until) if until is not None else F.lit(False)
    gone = runs.withColumn("gone", follows | old).where("gone").select("id", F.lit("removed").alias("event"), "first.title", "first.source", F.col("last").alias("at"))
    return new.unionByName(gone)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started in this context keep their state in RocksDB, as timers and several state variables need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def trends(articles: DataFrame, time: str = "ts", least: int = 3) -> DataFrame:
    """Topics with so many articles in 48 hours from two sources or more, every hour; an extension beyond the reference behaviour."""
    w = F.window(time, "48 hours", "1 hour")
    found = articles.withWatermark(time, "1 hour").groupBy(w, "topic").agg(F.count("*").alias("n"), F.approx_count_distinct("source").alias("sources"))
    return found.where((F.col("n") >= least) & (F.col("sources") >= 2))
