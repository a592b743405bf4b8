"""Numbers that run on over ordered groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .setjoin import cut

SPAN = 1 << 16


def continuous(rows: DataFrame, rank: Column, pos: str = "pos", span: int = SPAN) -> DataFrame:
    """rows with number: 1-based by rank, then pos (a unique whole number); null positions come first in their group.

    Rows are numbered inside ranges of ``span`` positions; only the ranges' sizes are summed in one window.
    """
    ranged = rows.withColumn("__rank", rank).withColumn("__range", F.coalesce(F.floor(F.col(pos) / span), F.lit(-(2**62))))
    sizes = ranged.groupBy(F.col("__rank").alias("__r"), F.col("__range").alias("__g")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__r", "__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__r", "__g", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__rank", "__range").orderBy(pos))
    joined = ranged.withColumn("__own", own).join(starts, (F.col("__rank") == F.col("__r")) & (F.col("__range") == F.col("__g")))
    return joined.withColumn("number", F.col("__before") + F.col("__own")).drop("__rank", "__range", "__r", "__g", "__before", "__own")


def within(rows: DataFrame, keys: list[str], pos: str = "pos", name: str = "number", span: int = SPAN) -> DataFrame:
    """rows with a 1-based number by pos (a whole number, unique in its group) in each group of keys; null keys are a group.

    Only the sizes of ranges of ``span`` positions are looked at in one window a group.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(pos) / span))
    sizes = ranged.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__g")).agg(F.count("*").alias("__n"))
    names = [f"__k{i}" for i in range(len(keys))]
    earlier = Window.partitionBy(*names).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*names, "__g", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__g")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(pos)))
    return own.join(starts, same).withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__g", "__before", *names)


def carried(rows: DataFrame, value: Column, name: str, keys: list[str], pos: str = "pos", span: int = SPAN, ahead: bool = False, own: bool = True) -> DataFrame:
    """rows with the last value that isn't null up to each row by pos (a whole number, unique in its group of keys, which aren't null).

    ahead: the first from each row on instead. own: the row's own value counts. A window looks at one range of ``span`` positions; what
    comes into a range from those before it is found in one window over the ranges, a row each, and fills what the range itself leaves open.
    """
    sign = -1 if ahead else 1
    placed = rows.withColumn("__value", value).withColumn("__range", F.floor(F.col(pos) / span))
    near = Window.partitionBy(*keys, "__range").orderBy(F.col(pos) * sign).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    found = placed.withColumn("__near", F.last("__value", ignorenulls=True).over(near))
    names = [f"__k{i}" for i in range(len(keys))]
    there = F.struct((F.col(pos) * sign).alias("at"), F.col("__value").alias("v"))
    ends = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__range").alias("__g")).agg(F.max(F.when(F.col("__value").isNotNull(), there)).alias("__last"))
    far = Window.partitionBy(*names).orderBy(F.col("__g") * sign).rowsBetween(Window.unboundedPreceding, -1)
    into = ends.withColumn("__into", F.last("__last", ignorenulls=True).over(far)["v"]).drop("__last")
    same = F.col("__range") == F.col("__g")
    for k, n in zip(keys, names, strict=True):
        same = same & (F.col(k) == F.col(n))
    return found.join(into, same).withColumn(name, F.coalesce("__near", "__into")).drop("__value", "__range", "__near", "__g", "__into", *names)


def ordered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """rows with a 1-based number by the order's columns (together unique), over ranges that are each sorted by themselves."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    starts = sizes.select("__p", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(starts), F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__p", "__first", "__before")


def by_category(rows: DataFrame, first: list[str], category: str = "category", pos: str = "pos") -> DataFrame:
    """rows numbered through their categories: those named first in that order, then the others as they are first met."""
    fixed_order = F.array_position(F.array(*map(F.lit, first)), F.col(category)).cast("long")
    met = rows.groupBy(F.col(category).alias("__c")).agg(F.min(pos).alias("__met"))
    placed = rows.join(met, F.col(category).eqNullSafe(F.col("__c")))
    known = F.coalesce(fixed_order, F.lit(0)) > 0
    rank = F.struct((~known).alias("late"), F.when(known, fixed_order).otherwise(F.col("__met")).alias("at"))
    return continuous(placed, rank, pos).drop("__c", "__met")
