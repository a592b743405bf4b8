"""Feed catalogues: nested JSON and Markdown lists."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import numbering
from .snapshots import Store

FEEDS = "categories array<struct<id string, name string, feeds array<struct<name string, url string, language string, priority int, max_articles int>>>>"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """category, name, url, language, priority, max_articles of a nested catalogue, with its defaults; rows without a url go."""
    c = spark.read.option("multiLine", True).schema(FEEDS).json(path)
    return flat_feeds(c)


PODCASTS = "podcasts array<struct<name string, url string, category string, rank int, xiaoyuzhou_url string>>, settings struct<count int, filter_tech_only boolean, tech_categories array<string>>"
CHANNELS = "channels array<struct<name string, url string, category string, language string, priority int>>"
TTL_DAYS = 7


def catalogue_path(spark: SparkSession, folder: str, kind: str) -> str:
    """Where a kind's catalogue is; kinds without one of their own share the first. A missing file is an error."""
    path = f"{folder.rstrip('/')}/{fixed.CATALOGUES.get(kind, fixed.CATALOGUES['tech'])}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    return path


def flat_feeds(catalogues: DataFrame) -> DataFrame:
    """The feeds of nested catalogues (see ``FEEDS``), with their defaults; rows without a url go."""
    f = catalogues.select(F.explode("categories").alias("c")).select(F.coalesce("c.id", "c.name").alias("category"), F.explode("c.feeds").alias("f"))
    return f.select("category", "f.name", "f.url", F.coalesce("f.language", F.lit("en")).alias("language"), F.coalesce("f.priority", F.lit(3)).alias("priority"), "f.max_articles").where("url <> ''")


def flat_podcasts(catalogues: DataFrame, limit: int | None = None) -> DataFrame:
    """name, url, category, rank, podcast_url of a catalogue (see ``PODCASTS``): the first ``count`` (1000 by default), of the wanted categories
    if it says so, the first ``limit`` of these; those without a url go last."""
    p = catalogues.select("settings", F.posexplode("podcasts").alias("k", "p"))
    s = F.col("settings")
    wanted = ~(F.coalesce(s["filter_tech_only"], F.lit(False)) & (F.size(F.coalesce(s["tech_categories"], F.array().cast("array<string>"))) > 0)) | F.array_contains(s["tech_categories"], F.coalesce("p.category", F.lit("")))
    rows = p.where((F.col("k") < F.coalesce(s["count"], F.lit(1000))) & wanted)
    rows = rows.orderBy("k").limit(limit) if limit else rows
    return rows.where("p.url <> ''").select(F.col("k").alias("pos"), "p.name", "p.url", F.lit("podcast").alias("category"), F.coalesce("p.rank", F.lit(0)).alias("rank"), F.coalesce("p.xiaoyuzhou_url", F.lit("")).alias("podcast_url"))


def read_podcasts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return flat_podcasts(spark.read.option("multiLine", True).schema(PODCASTS).json(path), limit)


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """name, url, category, language, priority of a catalogue of video channels, with its defaults."""
    c = spark.read.option("multiLine", True).schema(CHANNELS).json(path).select(F.inline("channels"))
    return c.select("name", "url", "category", F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("priority", F.lit(3)).alias("priority")).where("url <> ''")


def active(accounts: DataFrame, limit: int | None = None) -> DataFrame:
    """Accounts that are not struck out, the first of them if a number is given."""
    kept = accounts.where("active").withColumn("category", F.coalesce("category", F.lit(fixed.OTHER_CATEGORY)))
    return kept.orderBy("index").limit(limit) if limit else kept


def list_counts(accounts: DataFrame) -> DataFrame:
    """category (null: all), total, active, discontinued."""
    return accounts.rollup("category").agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("discontinued"), F.grouping("category").cast("boolean").alias("all"))


ACCOUNTS = "index int, name string, url string, category string, active boolean"


def account_list(spark: SparkSession, path: str, fetch: Callable[[], str | None], now: datetime, force: bool = False) -> DataFrame:
    """index, name, url, category, active: as kept below ``path`` if that is younger than a week, else fetched (Markdown) and kept.

    Where nothing can be fetched an older list serves; without one the list is empty. The time is a fact of the list's version, so that
    both change together.
    """
    store = Store(spark, path)
    kept = store.newest()
    if "accounts" in kept.tables and not force and young(kept.facts.get("refreshed"), now):
        return store.read("accounts", ACCOUNTS, kept)
    markdown = fetch()
    if markdown is None:
        return store.read("accounts", ACCOUNTS, kept)
    lines = spark.createDataFrame(list(enumerate(markdown.split("\n"))), "line_no int, line string")
    rows = parse_list(lines).select(F.col("index").cast("int").alias("index"), "name", "url", "category", "active")
    made = store.update(lambda _: ({"accounts": rows}, {}, {"refreshed": now.isoformat()}))
    store.expire()
    return store.read("accounts", ACCOUNTS, made)


def young(refreshed: str | None, now: datetime) -> bool:
    """Whether a list of that time serves; an unreadable time counts as none."""
    try:
        return (now - datetime.fromisoformat(refreshed)).days < TTL_DAYS
    except (ValueError, TypeError):
        return False


def parse_list(lines: DataFrame, span: int = numbering.SPAN) -> DataFrame:
    """index, name, url, category, active of a Markdown list. lines: line_no (a unique whole number), line.

    A '## ' heading names the category of what follows; an entry is a link; '~~' around it means inactive. Ranges of ``span`` lines are
    looked at by themselves, however long the list is.
    """
    heading = F.nullif(F.regexp_extract("line", "^##\\s+(.+?)\\s*$", 1), F.lit(""))
    marked = numbering.carried(lines.withColumn("__all", F.lit(0)), heading, "category", ["__all"], "line_no", span)
    link = "\\[([^\\]]+)\\]\\(([^)]+)\\)"
    rows = numbering.within(marked.where(F.regexp_like("line", F.lit(link)) & ~F.col("line").startswith("## ")), ["__all"], "line_no", span=span)
    return rows.select(
        (F.col("number") - 1).alias("index"), F.regexp_extract("line", link, 1).alias("name"), F.regexp_extract("line", link, 2).alias("url"), "category", (~F.col("line").contains("~~")).alias("active")
    )
