"""Feeds: parsing RSS and Atom, and a data source that fetches them through an injected transport."""

from __future__ import annotations

import html.entities
import random
import re
import time
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import parse_date
from ..operators import dedup, numbering

ITEM = "title string, link string, pub_date_raw string, description string, content_encoded string, hn_points int, hn_comments int"
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_XML = {"amp", "lt", "gt", "quot", "apos"}


def clean_entities(xml: str) -> str:
    """Named entities that XML lacks become their characters; the fixed ones first."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in _XML:
            return m[0]
        return fixed.ENTITIES.get(name) or html.entities.html5.get(f"{name};", m[0])

    return _ENTITY.sub(one, xml)


def _local(tag: object) -> str:
    return str(tag).rpartition("}")[2]


def _number(pattern: str, text: str) -> int | None:
    m = re.search(pattern, text)
    return int(m[1]) if m else None


def parse_items(xml: str | None) -> list[dict]:
    """Items of an RSS 2.0 channel, else entries of an Atom feed; none where the XML can't be read."""
    try:
        root = ElementTree.fromstring(clean_entities(xml or ""))
    except ElementTree.ParseError:
        return []
    text = lambda e, name: next(((c.text or "").strip() for c in e if _local(c.tag) == name), "")
    out = []
    for item in root.iter("item"):
        description = text(item, "description")
        out.append({"title": text(item, "title"), "link": text(item, "link"), "pub_date_raw": text(item, "pubDate"), "description": description, "content_encoded": text(item, "encoded"), "hn_points": _number(r"Points:\s*(\d+)", description), "hn_comments": _number(r"# Comments:\s*(\d+)", description)})
    if out:
        return out
    for entry in (e for e in root.iter() if _local(e.tag) == "entry"):
        links = [c for c in entry if _local(c.tag) == "link"]
        link = next((c for c in links if c.get("rel", "alternate") == "alternate"), links[0] if links else None)
        out.append({"title": text(entry, "title"), "link": (link.get("href") or "") if link is not None else "", "pub_date_raw": text(entry, "published") or text(entry, "updated"), "description": text(entry, "summary"), "content_encoded": text(entry, "content"), "hn_points": None, "hn_comments": None})
    return out


def explode_items(feeds: DataFrame) -> DataFrame:
    """feed, pos and the items of every feed document. feeds: feed, xml."""
    schema = pa.schema([("feed", pa.string()), ("pos", pa.int32()), ("title", pa.string()), ("link", pa.string()), ("pub_date_raw", pa.string()), ("description", pa.string()), ("content_encoded", pa.string()), ("hn_points", pa.int32()), ("hn_comments", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"feed": f, "pos": k, **x} for f, xml in zip(b.column("feed").to_pylist(), b.column("xml").to_pylist(), strict=True) for k, x in enumerate(parse_items(xml))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return feeds.select("feed", "xml").mapInArrow(each, f"feed string, pos int, {ITEM}")


def recent(items: DataFrame, cutoff: Column, undated: str = "drop", inclusive: bool = False, most: int = 30, priority: Column | None = None) -> DataFrame:
    """Items with a title and a link after the cutoff, at most so many accepted ones a feed in document order (fewer by priority, if given)."""
    ts = parse_date(F.col("pub_date_raw"))
    late = (ts >= cutoff) if inclusive else (ts > cutoff)
    keep = F.coalesce(late, F.lit(undated == "keep"))
    cap = F.lit(most)
    if priority is not None:
        cap = F.when(priority == 2, max(1, most * 7 // 10)).when(priority == 3, max(1, most // 2)).otherwise(most)
    w = Window.partitionBy("feed").orderBy("pos")
    items = items.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))
    return items.withColumn("published_ts", ts).where(keep).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cap).drop("__rn")


def scanned(fetched: DataFrame, cutoff: Column, most: int = 30, **options) -> tuple[DataFrame, DataFrame]:
    """Articles of fetched feeds (feed, xml, error), deduplicated across feeds in the order of feeds and items, and the scan's counts.

    articles: feed, pos, title, url, source, published_ts, description, full_text, hn_points, hn_comments. options: see :func:`recent`.
    """
    kept = recent(explode_items(fetched.where("xml IS NOT NULL")), cutoff, most=most, **options)
    rows = numbering.ordered(kept, ["feed", "pos"], "__n").withColumnRenamed("pos", "__pos").withColumn("pos", F.col("__n")).withColumnRenamed("link", "url")
    found = dedup.greedy(rows).withColumn("pos", F.col("__pos"))
    articles = found.select("feed", "pos", "title", "url", F.col("feed").alias("source"), "published_ts", "description", F.col("content_encoded").alias("full_text"), "hn_points", "hn_comments")
    return articles, counts(fetched, found)


def counts(fetched: DataFrame, articles: DataFrame) -> DataFrame:
    """checked, success, error, not_modified, updates of a scan. fetched: xml, error, and status if known."""
    status = F.col("status") if "status" in fetched.columns else F.lit(None)
    unchanged = F.coalesce(status == 304, F.lit(False))
    done = fetched.agg(F.count("*").alias("checked"), F.count_if(F.col("xml").isNotNull()).alias("success"), F.count_if(F.col("xml").isNull() & ~unchanged).alias("error"), F.count_if(unchanged).alias("not_modified"))
    return done.withColumn("__one", F.lit(1)).join(articles.agg(F.count("*").alias("updates")).withColumn("__one", F.lit(1)), "__one").drop("__one")


def with_retry(fetch: Callable[[str], str], attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """fetch, tried again after min(2 ** k * 2, 30) seconds and up to one more."""

    def run(url: str) -> str:
        for k in range(attempts):
            try:
                return fetch(url)
            except OSError:
                if k == attempts - 1:
                    raise
                pause(min(2**k * 2, 30) + random.random())
        raise AssertionError

    return run


class FeedSource(DataSource):
    """spark.read.format("newsdesk_feeds").option("urls", lines): feed and xml, one partition a feed.

    Subclass and set ``transport`` to a picklable function from a url to its document; the library itself opens no connection.
    """

    transport: Callable[[str], str] | None = None

    @classmethod
    def name(cls) -> str:
        return "newsdesk_feeds"

    def schema(self) -> str:
        return "feed string, xml string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options.get("urls", "").split(), type(self).transport)


class _FeedReader(DataSourceReader):
    def __init__(self, urls: list[str], transport: Callable[[str], str] | None) -> None:
        if transport is None:
            raise ValueError("FeedSource needs a transport")
        self.urls, self.transport = urls, transport

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            yield (partition.value, self.transport(partition.value), None)
        except OSError as e:  # a feed that fails is a row of its own, as the fetch statistics count it
            yield (partition.value, None, str(e))
