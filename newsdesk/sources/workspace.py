"""What is kept between runs: a source's articles, the tracker, reports. All paths are the cluster's shared ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Store

TRACKER = "id string, title string, source string, processed_at string"


def save(articles: DataFrame, path: str, source: str) -> None:
    """Replace what is kept of this source; other sources stay."""
    articles.withColumn("kept_source", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kept_source").parquet(path)


def load(spark: SparkSession, path: str, source: str) -> DataFrame:
    """What is kept of this source ('all': of every one)."""
    kept = spark.read.parquet(path)
    return (kept if source == "all" else kept.where(F.col("kept_source") == source)).drop("kept_source")


METADATA = "source string, checked int, hours int, updates long, saved_at string"


def sources_of(source: str) -> tuple[str, ...]:
    """The sources whose articles a report of this one has: tech reports have the accounts' as well."""
    return {"all": ("tech", "podcast", "wechat"), "tech": ("tech", "wechat")}.get(source, (source,))


def load_for(spark: SparkSession, path: str, source: str) -> DataFrame:
    """What is kept of the sources that a report of this one has."""
    return spark.read.parquet(path).where(F.col("kept_source").isin(*sources_of(source)))


def united(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def save_metadata(spark: SparkSession, path: str, source: str, checked: int, hours: int, updates: int, saved_at: str) -> None:
    """Append what a run of a source counted."""
    spark.createDataFrame([(source, checked, hours, updates, saved_at)], METADATA).write.mode("append").parquet(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Each source's last run; none where there is nothing yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], METADATA)
    rows = spark.read.schema(METADATA).parquet(path)
    names = [c for c in rows.columns if c != "source"]
    return rows.groupBy("source").agg(F.max_by(F.struct(*names), "saved_at").alias("m")).select("source", "m.*")


def load_insight(spark: SparkSession, path: str) -> str:
    """The text of an optional JSON file ('trend_insight'); '' without one."""
    if not _exists(spark, path):
        return ""
    rows = spark.read.option("multiLine", True).schema("trend_insight string").json(path).take(1)
    return (rows[0][0] or "") if rows else ""


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def rewrite_tracker(rows: DataFrame, path: str) -> None:
    """Replace the tracker as a whole."""
    prune_tracker(rows.sparkSession, path, lambda _: rows)


def prune_tracker(spark: SparkSession, path: str, kept: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the tracker by what is to be kept of it, for instance its unexpired rows; rows that another run adds meanwhile stay."""
    store = Store(spark, path)
    store.update(lambda base: ({"tracker": kept(store.read("tracker", TRACKER, base)).select("id", "title", "source", "processed_at")}, {}, {}))
    store.expire()


def append_tracker(rows: DataFrame, path: str) -> None:
    store = Store(rows.sparkSession, path)
    store.update(lambda _: ({}, {"tracker": rows.select("id", "title", "source", "processed_at")}, {}))


def load_tracker(spark: SparkSession, path: str) -> DataFrame:
    """The tracker's rows; none where there is no tracker yet."""
    return Store(spark, path).read("tracker", TRACKER)


def write_report(lines: DataFrame, path: str, order: list[str]) -> None:
    """A report as one text file: its lines are a report's, not the corpus's."""
    lines.orderBy(*order).select(F.coalesce("line", F.lit("")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


SUMMARY = "url string, ai_summary string, category string, tier string, importance_reason string"


def last_summaries(spark: SparkSession, pattern: str, schema: str = SUMMARY) -> DataFrame:
    """Summaries of all batch files of JSON lines; of one url's, those of the last file by name, and in it the last text by its order."""
    read = spark.read.schema(schema).json(pattern).withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.monotonically_increasing_id())
    return last_by_url(read, ["__file", "__at"])


def last_by_url(batches: DataFrame, order: list[str]) -> DataFrame:
    """Of each url's rows the last by the order's columns, which are left out."""
    names = [c for c in batches.columns if c not in order]
    last = batches.where("url IS NOT NULL").groupBy("url").agg(F.max_by(F.struct(*names), F.struct(*order)).alias("s"))
    return last.select("s.*")
