"""A stream joined with reference data that is refreshed by its triggers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import catalog


def with_accounts(
    articles: DataFrame,
    join: Callable[[DataFrame, DataFrame], DataFrame],
    lists: str,
    fetch: Callable[[], str | None],
    out: str,
    checkpoint: str,
    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream that writes ``join(batch, accounts)`` below ``out``, a folder ``batch=<number>`` for each of its batches.

    Every trigger looks at the account list kept below ``lists``: one that is older than a week is fetched again first, and where that
    fails the old one serves (see :func:`catalog.account_list`). A batch reads one version of the list, whatever other runs do meanwhile;
    one that is run again replaces its folder, so that each article is there once.
    """
    spark: SparkSession = articles.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        accounts = catalog.account_list(spark, lists, fetch, now())
        join(batch, accounts).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = articles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def written(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What the batches wrote, with their number as batch."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", out).parquet(out).withColumn("batch", F.col("batch").cast("long"))
