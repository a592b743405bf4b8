"""Longer texts for articles, from pages that were fetched: main text, account articles, episodes, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.extract import account_body, episode_url, episodes
from ..functions.text import main_content, needs_episode, normalize_title
from ..operators.containment import first_match

MOST = 8000


def _longer(articles: DataFrame, pages: DataFrame, content: Column, origin: str, most: int | None) -> DataFrame:
    p = pages.where("body IS NOT NULL").select(F.col("url").alias("__url"), "body").dropDuplicates(["__url"])
    joined = articles.join(p, F.col("url") == F.col("__url"), "left").withColumn("__text", F.when(F.col("body").isNotNull(), content)).drop("__url", "body")
    better = F.coalesce(F.length("__text") > F.length(F.coalesce("full_text", F.lit(""))), F.lit(False))
    text = F.substring("__text", 1, most) if most else F.col("__text")
    found = joined.withColumn("__better", better)
    out = found.withColumn("full_text", F.when(F.col("__better"), text).otherwise(F.col("full_text"))).withColumn("content_source", F.when(F.col("__better"), F.lit(origin)).otherwise(F.col("content_source")))
    return out.drop("__text", "__better")


def with_page_text(articles: DataFrame, pages: DataFrame, most: int = MOST, unfinished: bool = True) -> DataFrame:
    """articles whose page (url, body) has a longer main text get its first characters as full_text, and content_source."""
    return _longer(articles, pages, main_content(F.col("body"), unfinished), "enriched", most)


def with_account_text(articles: DataFrame, pages: DataFrame) -> DataFrame:
    return _longer(articles, pages, account_body(F.col("body")), fixed.ACCOUNT_HOST, None)


def account_candidates(articles: DataFrame, least: int = 500, most: int | None = None) -> DataFrame:
    """Account articles with a text shorter than so many characters, the first of them by pos if a number is given."""
    short = articles.where((F.length(F.coalesce("full_text", F.lit(""))) < least) & F.coalesce(F.col("url").contains(fixed.ACCOUNT_HOST), F.lit(False)))
    return short.orderBy("pos").limit(most) if most else short


def statistics(candidates: DataFrame, enriched: DataFrame, origin: str = "enriched") -> DataFrame:
    """enriched, skipped, failed of all articles: candidates with and without a new text, and those that were none."""
    tried = candidates.select(F.col("pos").alias("__pos"), F.lit(True).alias("__tried"))
    done = enriched.join(tried, F.col("pos") == F.col("__pos"), "left")
    hit = F.coalesce(F.col("content_source") == origin, F.lit(False))
    return done.agg(F.count_if(F.coalesce("__tried", F.lit(False)) & hit).alias("enriched"), F.count_if(F.col("__tried").isNull()).alias("skipped"), F.count_if(F.coalesce("__tried", F.lit(False)) & ~hit).alias("failed"))


def shows_to_fetch(updates: DataFrame, podcasts: DataFrame) -> DataFrame:
    """source, url of its page and n updates, of the shows whose updates don't link to episodes' pages. podcasts: name, podcast_url."""
    open_ = updates.where(needs_episode(F.col("url"))).groupBy("source").agg(F.count("*").alias("n"))
    return open_.join(podcasts.select(F.col("name").alias("__name"), F.col("podcast_url").alias("url")), F.col("source") == F.col("__name")).where("url <> ''").select("source", "url", "n")


def with_episodes(updates: DataFrame, pages: DataFrame) -> DataFrame:
    """updates with the episode's page as url where the show's page (source, body) lists it; eid is null elsewhere."""
    listed = pages.select(F.col("source").alias("grp"), F.posexplode(episodes(F.col("body"))).alias("k", "e"))
    listed = listed.select("grp", "k", normalize_title(F.col("e.title")).alias("t"), F.col("e.eid").alias("value"))
    asked = updates.withColumn("__t", F.when(needs_episode(F.col("url")), normalize_title(F.col("title"))))
    found = first_match(asked.select(F.col("source").alias("grp"), F.col("__t").alias("t")), listed)
    found = found.select(F.col("grp").alias("__grp"), F.col("t").alias("__found"), F.col("value").alias("eid"))
    joined = asked.join(found, (F.col("source") == F.col("__grp")) & (F.col("__t") == F.col("__found")), "left").drop("__t", "__grp", "__found")
    return joined.withColumn("url", episode_url(F.col("eid"), F.col("url")))


def transcript(status: Column, body: Column, most: int = 3000) -> Column:
    """The text of a transcript service's answer: its content, else its segments joined; null without one. Cut with a mark after so many characters."""
    answer = F.from_json(body, "content string, transcript array<struct<text string>>")
    parts = F.array_join(F.filter(F.transform(answer["transcript"], lambda s: s["text"]), lambda t: t != ""), " ")
    text = F.coalesce(F.nullif(answer["content"], F.lit("")), F.nullif(parts, F.lit("")))
    text = F.trim(text, F.lit(" \t\r\n"))
    return F.when(status == 200, F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(fixed.TRANSCRIPT_CUT))).otherwise(F.nullif(text, F.lit(""))))
