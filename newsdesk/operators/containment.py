"""The first listed title that equals, holds or is held by a wanted one, through an inverted index of short substrings.

A title that is held by another has all of its substrings there, so it is looked up by the rarest of its own substrings of ``GRAM``
characters among those of the titles that may hold it, and only what shares that one is compared. Lists are rows, not arrays: one list is
spread over tasks by its substrings, and the first in list order is a minimum, which tasks find for their own rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .setjoin import cut

GRAM = 3


def _grams(title: Column, lengths: Column) -> Column:
    """The distinct substrings of these lengths."""
    starts = lambda n: F.when(F.length(title) >= n, F.sequence(F.lit(1), F.length(title) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(starts(n), lambda i: F.substring(title, i, n)))))


def _held(short: DataFrame, long: DataFrame) -> DataFrame:
    """grp, short and long titles of which the long one holds the short one. Both: grp, t, each once."""
    size = F.least(F.length("t"), F.lit(GRAM))
    needed = short.groupBy("grp").agg(F.collect_set(size).alias("lengths"))  # GRAM + 1 at most
    there = cut(long.join(needed, "grp").select("grp", F.col("t").alias("long"), F.explode(_grams(F.col("t"), F.col("lengths"))).alias("gram")))
    often = there.groupBy("grp", "gram").agg(F.count("*").alias("n"))
    own = short.select("grp", F.col("t").alias("short"), F.explode(_grams(F.col("t"), F.array(size))).alias("gram"))
    rarest = own.join(often, ["grp", "gram"], "left").groupBy("grp", "short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    keys = rarest.where("x.n > 0").select("grp", "short", F.col("x.gram").alias("gram"))
    return there.join(keys, ["grp", "gram"]).where(F.col("long").contains(F.col("short"))).select("grp", "short", "long")


def first_match(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """grp, t and value: of each wanted title (grp, t) the first listed one (grp, k, t, value) that equals it, else that holds it or is held.

    Titles without any are left out, as null ones are; an empty title is held by every other.
    """
    asked = cut(wanted.where("t IS NOT NULL AND grp IS NOT NULL").select("grp", "t").distinct())
    shown = listed.where("t IS NOT NULL AND grp IS NOT NULL").groupBy("grp", "t").agg(F.min(F.struct("k", "value")).alias("first"))
    shown = cut(shown.join(asked.select("grp").distinct(), "grp", "left_semi"))
    titles = shown.select("grp", "t")
    pairs = _held(titles, asked).select("grp", F.col("long").alias("t"), F.col("short").alias("other"))
    pairs = pairs.union(_held(asked, titles).select("grp", F.col("short").alias("t"), F.col("long").alias("other")))
    found = pairs.join(shown.withColumnRenamed("t", "other"), ["grp", "other"])
    best = found.groupBy("grp", "t").agg(F.min(F.struct((F.col("t") != F.col("other")).alias("part"), F.col("first.k").alias("k"), F.col("first.value").alias("value"))).alias("x"))
    return best.select("grp", "t", F.col("x.value").alias("value"))
