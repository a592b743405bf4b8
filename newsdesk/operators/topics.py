"""Topic clusters of articles by shared keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.keywords import keywords
from ..functions.text import contains_any, round3
from . import setjoin

GUARD = 50


def has_signal(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return contains_any(text, fixed.HIGH_SIGNAL)


def source_authority(source: Column) -> Column:
    """Weight of the first known domain that the source names; 0.4 otherwise."""
    low = F.lower(source)
    out = None
    for domain, weight in fixed.AUTHORITY:
        out = F.when(low.contains(domain), weight) if out is None else out.when(low.contains(domain), weight)
    return out.otherwise(0.4)


def clusters(articles: DataFrame, threshold: float = 0.25, merge_guard: bool = False, pool_singletons: bool = True) -> DataFrame:
    """pos, url, source, cluster_id, cluster_size, cross_source, score of every article.

    merge_guard: with more than ``GUARD`` articles nothing merges, as the reference behaviour has it; off, clusters are the
    components of the similarity graph at any size. pool_singletons: articles alone in their component share the cluster c_other.
    """
    # stored, so that texts are read once and keywords made once
    a = setjoin.cut(articles.select("pos", "url", "source", F.array_sort(keywords(F.col("title"), F.col("description"))).alias("kw"), has_signal(F.col("title"), F.col("description")).alias("signal")))
    a = a.withColumn("gid", F.when(F.size("kw") > 0, F.sha2(F.to_json("kw"), 256)).otherwise(F.concat(F.lit("none-"), F.col("pos"))))
    if merge_guard and len(articles.select(F.lit(1)).take(GUARD + 1)) > GUARD:
        rooted = a.withColumn("root", F.col("pos").cast("string"))
    else:
        groups = setjoin.cut(setjoin.grouped(a, F.col("kw")))
        rooted = a.join(setjoin.connected(groups, threshold), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    named = rooted.join(sizes, "root").withColumn("cluster_id", F.when((F.col("n") == 1) & F.lit(pool_singletons), F.lit("c_other")).otherwise(F.concat(F.lit("c_"), F.col("first"))))
    info = named.groupBy("cluster_id").agg(
        F.count("*").alias("cluster_size"),
        (F.countDistinct("source") > 1).alias("cross_source"),
        F.avg(source_authority(F.col("source"))).alias("authority"),
        F.avg(F.col("signal").cast("double")).alias("signal"),
    )
    score = F.least(F.col("cluster_size") / 5, F.lit(1.0)) * 0.25 + F.when(F.col("cross_source"), 0.25).otherwise(0.05) + F.col("authority") * 0.25 + F.col("signal") * 0.25
    info = info.withColumn("score", F.least(round3(score), F.lit(1.0))).drop("authority", "signal")
    return named.select("pos", "url", "source", "kw", "cluster_id").join(info, "cluster_id")


def themes(members: DataFrame) -> DataFrame:
    """cluster_id and theme: words that all members share (five at most, sorted), else the three most common."""
    counts = members.select("cluster_id", "cluster_size", F.explode("kw").alias("w")).groupBy("cluster_id", "cluster_size", "w").agg(F.count("*").alias("n"))
    # shared words come first; the ranks' bounds keep one cluster's vocabulary out of one task
    common = F.col("n") == F.col("cluster_size")
    order = Window.partitionBy("cluster_id").orderBy(F.desc(common), F.when(common, 0).otherwise(-F.col("n")), "w")
    top = counts.withColumn("shared", common).withColumn("rank", F.row_number().over(order)).where("rank <= 5").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "shared"))).alias("x"))
    shared = F.filter("x", lambda e: e["shared"])
    chosen = F.when(F.size(shared) > 0, shared).otherwise(F.slice("x", 1, 3))
    words = F.transform(chosen, lambda e: e["w"])
    named = top.select("cluster_id", F.array_join(words, " ").alias("theme"))
    return members.select("cluster_id").distinct().join(named, "cluster_id", "left").na.fill("", ["theme"])


def ranked(members: DataFrame) -> DataFrame:
    """One row a cluster (cluster_id, theme, size, cross_source, score, first), best first, then by its first member."""
    rows = members.groupBy("cluster_id").agg(F.first("cluster_size").alias("size"), F.first("cross_source").alias("cross_source"), F.first("score").alias("score"), F.min("pos").alias("first"))
    return rows.join(themes(members), "cluster_id").orderBy(F.desc("score"), "first")
