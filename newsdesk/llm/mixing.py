"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target; it is met by taking all its documents a whole number of times (0, 1 or 2) and some of them once more.
Which ones is decided by a hash of the document: those below the source's threshold. The threshold comes from sums of sizes by source and
hash bucket: the bucket where the running sum passes the budget is the only one that is split further, so nothing is ever sorted.
What the first threshold leaves of the budget is smaller than the first document that no longer fits; nested budgets then repeat the
search among the documents that fit into the rest.

Defined results: null texts have size 0 and are taken 0 words; a null source is a source of its own, last in order; repeated rows have
one hash and are taken together or not at all; a null id is hashed by its text; a very long text's words are counted whole; an empty
table gives an empty result; extra columns don't matter. Only one row a source reaches the driver, and at most ``MAX_SOURCES`` of them: beyond that an error is raised.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MOST_TIMES = 150, 2
PASSES = 4
HASH_BITS, STEP_BITS = 60, 12
MAX_SOURCES = 200_000


def size(text: Column) -> Column:
    """Words of a whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id (of the text where the id is null)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    target: float

    @property
    def times(self) -> int:
        """Whole times that all its documents are taken."""
        return min(MOST_TIMES, int(self.target // self.size)) if self.size else 0

    @property
    def budget(self) -> int:
        """Words still to be taken after that."""
        return max(0, math.floor(self.target - self.times * self.size))


def targets(sizes: list[tuple[str | None, int]]) -> list[Share]:
    """Sources by code point (null last) weigh 3, 1, 2, repeating; what a source can't take is shared again by weight."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(ordered))]
    total = sum(n for _, n in ordered)
    full: set[int] = set()
    while True:
        rest = SHARE_PERCENT * total - 100 * sum(MOST_TIMES * ordered[k][1] for k in full)
        weights = sum(w for k, w in enumerate(weight) if k not in full)
        unit = rest / (100 * weights) if weights else 0.0
        over = {k for k, (_, n) in enumerate(ordered) if k not in full and unit * weight[k] > MOST_TIMES * n}
        if not over:
            break
        full |= over
    return [Share(s, n, float(MOST_TIMES * n) if k in full else unit * weight[k]) for k, (s, n) in enumerate(ordered)]


def _table(spark, rows: list[tuple], names: dict[str, T.DataType]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([T.StructField(k, t) for k, t in names.items()]))


def _threshold(left: DataFrame, budgets: dict[str | None, int]) -> dict[str | None, tuple[int, int]]:
    """By source: the largest hash such that all documents up to it fit into the budget (-1: none), and what they sum to.

    left: source, size, h.
    """
    spark = left.sparkSession
    found: dict[str | None, tuple[int, int]] = {}
    state = {s: (0, b, 0) for s, b in budgets.items() if b > 0}  # prefix so far, rest of the budget, taken below the prefix
    used = 0
    while state:
        used = min(HASH_BITS, used + STEP_BITS)
        above, here = HASH_BITS - used + min(STEP_BITS, used), HASH_BITS - used
        asked = _table(spark, [(s, p, b) for s, (p, b, _) in state.items()], {"s": T.StringType(), "prefix": T.LongType(), "rest": T.LongType()})
        inside = left.join(F.broadcast(asked), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", above) == F.col("prefix")))
        sums = inside.groupBy("s", "rest", F.shiftright("h", here).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        first = running.where("upto > rest").groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"), "low", "high")).alias("x"))
        total = running.groupBy("s").agg(F.max("upto").alias("all"))
        rows = {r["s"]: r for r in first.collect()}
        sums_all = {r["s"]: r["all"] for r in total.collect()} if len(rows) < len(state) else {}
        for s, (p, b, taken) in list(state.items()):
            r = rows.get(s)
            if r is None:  # everything under the prefix fits
                found[s] = (((p + 1) << above) - 1, taken + sums_all.get(s, 0))
                del state[s]
            else:
                x = r["x"]
                if x["low"] == x["high"] or not here:  # one hash that no longer fits
                    found[s] = (x["low"] - 1, taken + x["below"])
                    del state[s]
                else:
                    state[s] = (x["bucket"], b - x["below"], taken + x["below"])
    return found


def planned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes (doc_id, source, size, h), and the plan: one row a source.

    The plan has __nd_source, source_size, target, __nd_whole (times that all documents are taken) and __nd_cuts ([budget, hash] of
    each pass).
    """
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", size(F.col("text")).alias("size"), hashed(F.col("doc_id"), F.col("text")).alias("h")), "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = targets([(r["source"], r["n"] or 0) for r in rows])
    left, budgets = sized.where("size > 0").select("source", "size", "h"), {s.source: s.budget for s in shares}
    cuts: list[dict] = []
    for _ in range(PASSES):
        if not any(b > 0 for b in budgets.values()):
            break
        cut = _threshold(left, budgets)
        cuts.append({s: (budgets[s], cut.get(s, (-1, 0))[0]) for s in budgets})
        rest = _table(spark, [(s, b, h) for s, (b, h) in cuts[-1].items()], {"s": T.StringType(), "b": T.LongType(), "cut": T.LongType()})
        budgets = {s: b - cut.get(s, (-1, 0))[1] for s, b in budgets.items()}
        fits = _table(spark, list(budgets.items()), {"s": T.StringType(), "fit": T.LongType()})
        taken = (F.col("size") <= F.col("b")) & (F.col("h") <= F.col("cut"))
        left = left.join(F.broadcast(rest), F.col("source").eqNullSafe(F.col("s"))).where(~taken).select("source", "size", "h")
        left = left.join(F.broadcast(fits), F.col("source").eqNullSafe(F.col("s"))).where("size <= fit").select("source", "size", "h")
        left = stored(left, "left")  # read for every level of the next pass
    schema = {"__nd_source": T.StringType(), "source_size": T.LongType(), "target": T.DoubleType(), "__nd_whole": T.LongType(), "__nd_cuts": T.ArrayType(T.ArrayType(T.LongType()))}
    return sized, _table(spark, [(s.source, s.size, s.target, s.times, [list(c[s.source]) for c in cuts]) for s in shares], schema)


def times(n: Column, h: Column) -> Column:
    """How many times a document of this size and hash is taken, beside the columns of its source's plan."""
    extra = F.exists("__nd_cuts", lambda c: (n <= c[0]) & (h <= c[1])) & (n > 0)
    return F.col("__nd_whole") + extra.cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, times (copies of the document that the mix takes) of every row."""
    sized, plan = planned(docs)
    joined = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__nd_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", times(F.col("size"), F.col("h")).alias("times"))


def _oracle() -> str:
    """The same mix in SQL, where running sums over all hashes stand for the thresholds."""
    passes = []
    for k in range(PASSES):
        passes.append(f"""
r{k} AS (SELECT *, sum(CASE WHEN size > 0 AND NOT got AND size <= fit THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM p{k}),
g{k} AS (SELECT * EXCLUDE (got, upto), got OR (size > 0 AND size <= fit AND upto <= fit) AS got, size > 0 AND NOT got AND size <= fit AND upto <= fit AS new FROM r{k}),
p{k + 1} AS (SELECT * EXCLUDE (fit, new), fit - sum(CASE WHEN new THEN size ELSE 0 END) OVER (PARTITION BY source) AS fit FROM g{k})""")
    return (
        r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substring(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source
), o AS (
    SELECT *, row_number() OVER (ORDER BY n::DOUBLE / w, source) AS k, sum(n) OVER () AS total,
        coalesce(sum(2 * n) OVER (ORDER BY n::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER (ORDER BY n::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s
), u AS (
    SELECT *, (150 * total - 100 * capped)::DOUBLE / (100 * weights) AS unit FROM o
), f AS (
    SELECT min(k) AS k, arg_min(unit, k) AS unit FROM u WHERE unit * w <= 2 * n
), t AS (
    SELECT o.source, o.n AS source_size, CASE WHEN o.k < f.k THEN 2.0::DOUBLE * o.n ELSE f.unit * o.w END AS target FROM o, f
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM t
), p0 AS (
    SELECT d.*, source_size, target, whole, false AS got, greatest(0, floor(target - whole * source_size))::BIGINT AS fit FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
),"""
        + ",".join(passes)
        + f"""
SELECT doc_id, size, source_size, target, (whole + got::BIGINT) * size AS taken FROM p{PASSES}
"""
    )


ORACLE = _oracle()
