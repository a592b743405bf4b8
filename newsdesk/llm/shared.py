"""What the operators share: stored tables, joins on hot keys, filters of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, new_path, shared_dir, stored  # noqa: F401

#: ASCII white space that separates words; ``bytes.split()`` splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"

#: A memory bound, nothing is left out by it.
BATCH_BYTES = 4 << 20
#: A key with more than one in so many rows is joined by broadcast; there are fewer such keys than this.
HOT = 1_000
#: Bits of a filter of hashed keys. It lets pass too much where there are more keys than this, never too little.
FILTER_BITS = 1 << 25


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join on ``key``, each value of which ``lookup`` has once, with the number ``n`` of the rows that have it.

    Values that more than one in ``HOT`` rows have are broadcast, fewer than ``HOT`` of them; no task gets all rows of one. Both tables
    are read twice, so they should be stored ones.
    """
    total = lookup.agg(F.sum(n)).collect()[0][0] or 0
    hot = lookup.where(F.col(n) * HOT > total)
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("__nd_key"), F.lit(True).alias("__nd_hot"))), F.col(key) == F.col("__nd_key"), "left").drop("__nd_key")
    common = rows.join(F.broadcast(hot), key)
    return marked.where("__nd_hot IS NULL").drop("__nd_hot").join(lookup.where(F.col(n) * HOT <= total), key).unionByName(common)


def key_filter(keys: DataFrame, key: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function of an array that is true for all of the keys (longs), and for others whose hash falls on one of theirs."""
    spark = keys.sparkSession
    place = F.pmod(F.col(key), F.lit(FILTER_BITS)) + 1  # Spark counts bits and buckets from 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    made = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        made[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(made)

    def holds(values: np.ndarray) -> np.ndarray:
        k = np.mod(values, FILTER_BITS)
        bits = shared.value
        return (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1

    return holds


def filter_column(holds: Callable[[np.ndarray], np.ndarray], key: Column) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in batches:
            yield pd.Series(holds(k.to_numpy(np.int64)))

    return F.pandas_udf(each, "boolean")(key)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands whole texts to Python workers in batches of about ``BATCH_BYTES`` (one row at least).

    Spark's own bound is 64 MB, held once in the executor's direct memory and two or three times in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """As :func:`bound_batches`, for what runs inside of the context alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
