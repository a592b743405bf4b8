"""News value, tiers, depth and reasons."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import is_skipped_url, round3
from .topics import has_signal

TIERS = ("brief", "noteworthy", "must_read")
DEPTHS = ("headline_only", "summary_only", "deep_analysis")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the editorial steps. enabled: off, articles pass as they are, without scores."""

    must_read: float = 0.70
    noteworthy: float = 0.40
    least: float = 0.15
    promote_points: int = 200
    enabled: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """As EDITORIAL_ENABLED, EDITORIAL_THRESHOLD, TIER_MUST_READ, TIER_NOTEWORTHY and HN_PROMOTE_THRESHOLD say."""
        return cls(
            float(env.get("TIER_MUST_READ", cls.must_read)), float(env.get("TIER_NOTEWORTHY", cls.noteworthy)), float(env.get("EDITORIAL_THRESHOLD", cls.least)),
            int(env.get("HN_PROMOTE_THRESHOLD", cls.promote_points)), env.get("EDITORIAL_ENABLED", "true").lower() != "false",
        )


def authority(source: Column, url: Column, priority: Column) -> Column:
    """Weight of the first known domain in source or url (or, from four characters, its brand in the source); else by priority."""
    low = F.lower(F.coalesce(source, F.lit("")))
    text = F.concat_ws(" ", low, F.lower(F.coalesce(url, F.lit(""))))
    out = None
    for domain, weight in fixed.AUTHORITY:
        brand = domain.split(".")[0]
        fits = text.contains(domain)
        if "." in domain and len(brand) >= 4:
            fits = fits | low.contains(brand)
        out = F.when(fits, weight) if out is None else out.when(fits, weight)
    return out.when(priority == 1, 0.8).when(priority == 2, 0.6).otherwise(0.4)


def scored(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """articles with authority, novelty, news_value_score, editorial_tier, depth and editorial_factors.

    Needs title, description, source, url, priority, hn_points, cluster_size (null: not clustered) and cross_source.
    """
    n = F.coalesce("cluster_size", F.lit(1))
    priority = F.coalesce("priority", F.lit(3))

    def factors(x: Column) -> Column:
        novelty = F.when(n <= 1, 0.5).otherwise(F.least(1 / F.sqrt(n.cast("double")) + x["authority"] * 0.3, F.lit(1.0)))
        return F.struct(
            x["authority"].alias("authority"), F.when(F.coalesce("cross_source", F.lit(False)), 0.25).otherwise(0.05).alias("cross_source"), (F.least(n / 5, F.lit(1.0)) * 0.20).alias("cluster_heat"),
            F.when(x["signal"], 0.15).otherwise(0.0).alias("signal"), novelty.alias("novelty"),
        )

    def valued(f: Column) -> Column:
        value = f["authority"] * 0.25 + f["cross_source"] + f["cluster_heat"] + f["signal"] + f["novelty"] * 0.15
        return F.struct(f.alias("f"), F.least(round3(value), F.lit(1.0)).alias("value"))

    def graded(v: Column) -> Column:
        level = F.when(v["value"] >= settings.must_read, 2).when(v["value"] >= settings.noteworthy, 1).otherwise(0)
        level = F.least(level + F.when(F.coalesce("hn_points", F.lit(0)) >= settings.promote_points, 1).otherwise(0) + F.when(priority == 1, 1).otherwise(0), F.lit(2))
        pick = lambda names: F.element_at(F.array(*map(F.lit, names)), level + 1)
        f = v["f"]
        parts = F.struct(*[f[k].alias(k) for k in ("authority", "cross_source", "cluster_heat", "signal", "novelty")], v["value"].alias("composite"))
        return F.struct(f["authority"].alias("authority"), f["novelty"].alias("novelty"), v["value"].alias("news_value_score"), pick(TIERS).alias("editorial_tier"), pick(DEPTHS).alias("depth"), parts.alias("editorial_factors"))

    first = F.struct(authority(F.col("source"), F.col("url"), priority).alias("authority"), has_signal(F.col("title"), F.col("description")).alias("signal"))
    made = F.transform(F.transform(F.transform(F.array(first), factors), valued), graded)
    # a generator is a bound for pushdown: what stands before it is made once, whatever uses it
    return articles.select("*", F.inline(made))


def approved(articles: DataFrame, least: float = Settings.least) -> DataFrame:
    return articles.where(F.col("news_value_score") >= least)


def edited(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Scored articles that reach the least value; all as they are where the steps are off."""
    return approved(scored(articles, settings), settings.least) if settings.enabled else articles


def statistics(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """total, approved, filtered, and approved ones by tier, of scored articles."""
    kept = F.col("news_value_score") >= settings.least
    return articles.agg(F.count("*").alias("total"), F.count_if(kept).alias("approved"), F.count_if(~kept).alias("filtered"), *[F.count_if(kept & (F.col("editorial_tier") == t)).alias(t) for t in reversed(TIERS)])


def reason(articles: DataFrame) -> Column:
    """Why an article matters: up to four clauses, else by score, else the start of its description."""
    n = F.coalesce("cluster_size", F.lit(1))
    clauses = F.concat_ws(
        "，",
        F.when(n >= 3, F.concat(n.cast("string"), F.lit(fixed.REASONS[0]))),
        F.when(F.coalesce("cross_source", F.lit(False)), fixed.REASONS[1]),
        F.when(F.coalesce("priority", F.lit(3)) == 1, fixed.REASONS[2]),
        F.when(F.coalesce("hn_points", F.lit(0)) >= 100, F.concat(F.lit(fixed.POINTS_REASON[0]), F.col("hn_points").cast("string"), F.lit(fixed.POINTS_REASON[1]))),
    )
    start = F.nullif(F.substring(F.coalesce("description", F.lit("")), 1, 80), F.lit(""))
    return F.when(clauses != "", clauses).when(F.col("news_value_score") >= 0.6, fixed.REASONS[3]).otherwise(F.coalesce(start, F.lit(fixed.REASONS[4])))


def enrichment_candidates(articles: DataFrame, most: int = 50) -> DataFrame:
    """Articles whose text is short and that are worth fetching, best first (a top-k report)."""
    fetched = ~is_skipped_url(F.col("url"))
    worth = (F.col("depth") == "deep_analysis") | (F.col("editorial_tier").isNull() & ((F.coalesce("score", F.lit(0.0)) >= 0.4) | ((F.coalesce("cluster_size", F.lit(1)) >= 2) & F.coalesce("cross_source", F.lit(False)))))
    rank = F.coalesce(F.nullif(F.col("news_value_score"), F.lit(0.0)), F.col("score"), F.lit(0.0))
    return articles.where((F.length(F.coalesce("full_text", F.lit(""))) < 500) & fetched & F.coalesce(worth, F.lit(False))).withColumn("rank_score", rank).orderBy(F.desc("rank_score"), "pos").limit(most)
