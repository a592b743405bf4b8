"""Command line: deduplicate and score collected articles, keep the new ones; or report what is kept.

python -m newsdesk --source tech --articles collected.parquet --workspace /shared/work
python -m newsdesk --source tech --feeds feeds.json --workspace /shared/work
python -m newsdesk --source tech --workspace /shared/work --finalize --language en --format wechat

Environment: API_KEY, BASE_URL and MODEL (a model writes what the reports otherwise list), RSS_TIMEOUT, EDITORIAL_ENABLED, EDITORIAL_THRESHOLD,
TIER_MUST_READ, TIER_NOTEWORTHY, HN_PROMOTE_THRESHOLD, ENRICH_FULL_TEXT, SUPADATA_API_KEY (transcripts of videos), SKIP_CRITIQUE, REPORT_LANGUAGE, REPORT_BRAND, LOG_LEVEL.

Exit codes: 0 done, 1 an error of Spark or the files, 2 wrong arguments, 3 nothing to report, 130 interrupted.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.extract import is_ai_category
from .functions.text import is_account_article
from .operators import dedup, documents, editorial, numbering, report, topics
from .operators.documents import Heading
from .sources import catalog, enrich, feeds, http, models, transcripts, workspace
from .storage import stored

SOURCES = ("tech", "podcast", "wechat", "all")
log = logging.getLogger("newsdesk")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="newsdesk", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--source", choices=SOURCES, default="tech")
    p.add_argument("--hours", type=int, default=25, help="look back so many hours")
    p.add_argument("--limit", type=int, help="only the first sources by position")
    p.add_argument("--language", choices=("zh", "en"), default=os.environ.get("REPORT_LANGUAGE", "zh"))
    p.add_argument("--format", choices=("markdown", "wechat"), default="markdown", help="a report, or an article for the platform")
    p.add_argument("--finalize", action="store_true", help="report what is kept")
    p.add_argument("--articles", help="Parquet of collected articles: pos, title, url, source, category, description, language, published, priority, hn_points, hn_comments, full_text")
    p.add_argument("--feeds", help="a catalogue of feeds (JSON) to fetch instead")
    p.add_argument("--workspace", required=True, help="folder that all executors share")
    p.add_argument("--now", help="the time to look back from; the current time if not given")
    return p


def collect(articles: DataFrame, tracker: DataFrame, now: str | None, hours: int, settings: editorial.Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """New articles of the last hours (undated ones stay), scored, and the tracker's new rows."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    recent = articles.where(F.col("published").isNull() | (F.col("published") >= at - F.make_dt_interval(hours=F.lit(hours))))
    new, rows = dedup.unseen(dedup.greedy(recent), tracker, at.cast("string"))
    info = topics.clusters(new).select(F.col("pos").alias("__pos"), "cluster_size", "cross_source", "score")
    found = editorial.edited(new.join(info, F.col("pos") == F.col("__pos"), "left").drop("__pos"), settings or editorial.Settings.from_env())
    return found.drop("id"), rows


def scan(spark: SparkSession, args: argparse.Namespace, fetch: http.Fetcher) -> DataFrame:
    """Articles of a catalogue's feeds, as they came out in the last hours; the cache of what servers said is renewed."""
    # a catalogue is one file, read in its order; the replies are stored, so that a lost executor repeats no request
    listed = stored(catalog.read_feeds(spark, args.feeds).withColumn("__feed_no", F.monotonically_increasing_id()), "feeds")
    if args.limit:
        listed = listed.orderBy("__feed_no").limit(args.limit)
    cache = http.load_cache(spark, f"{args.workspace}/cache")
    replies = stored(http.fetched(listed, cache, fetch).withColumnRenamed("body", "xml"), "replies")
    at = F.lit(args.now).cast("timestamp") if args.now else F.current_timestamp()
    found, counted = feeds.scanned(replies.select(F.col("url").alias("feed"), "xml", "status"), at - F.make_dt_interval(hours=F.lit(args.hours)))
    log.info("%s", counted.collect()[0].asDict())
    http.renew_cache(replies.withColumnRenamed("xml", "body"), f"{args.workspace}/cache")
    meta = listed.select(F.col("url").alias("__feed"), "name", "category", "language", "priority", "__feed_no")
    rows = numbering.ordered(found.withColumnRenamed("pos", "__item").drop("source").join(meta, F.col("feed") == F.col("__feed")), ["__feed_no", "__item"], "pos")
    return rows.select((F.col("pos") - 1).alias("pos"), "title", "url", F.col("name").alias("source"), "category", "description", "language", F.col("published_ts").alias("published"), "priority", "hn_points", "hn_comments", "full_text")


def reported(spark: SparkSession, articles: DataFrame, source: str, heading: Heading, form: str, summaries: DataFrame, call: models.Call | None, insight: str = "") -> DataFrame | None:
    """The document of a source's kept articles: in two parts where the source has subjects, else its own kind. None without articles."""
    if articles.isEmpty():
        return None
    plain = articles.withColumn("ai_summary", F.lit(None).cast("string"))
    if source == "podcast":
        keyed = models.batch_summaries(articles, "podcast", call) if call else summaries.select(F.col("url").alias("key"), F.col("ai_summary").alias("summary"))
        known = articles.columns
        rows = articles.withColumn("rank", F.col("rank") if "rank" in known else F.lit(0)).withColumn("podcast_url", F.col("podcast_url") if "podcast_url" in known else F.lit(""))
        return documents.podcast_report(rows, keyed, heading)
    if source == "wechat":
        keyed = models.batch_summaries(articles, "account", call).withColumnRenamed("key", "url") if call else summaries.select("url", F.col("ai_summary").alias("summary"))
        return documents.account_report(articles, keyed, heading)
    summed = documents.with_summaries(articles, summaries)
    if call:
        split = models.classified(plain, call, heading.language)
    else:
        split = summed.withColumn("is_ai", is_ai_category(F.col("ai_category"), F.col("category")))
    split = split.persist()
    ai, other = split.where("is_ai").drop("is_ai"), split.where("NOT is_ai").drop("is_ai")
    if form == "wechat":
        results = None if call or summaries.isEmpty() else documents.results_from_summaries(ai)
        made = models.structure(ai, call) if call else None
        return documents.platform_article(documents.items_of(results, ai), other, heading, made)
    if not call and not summaries.where("tier IS NOT NULL").isEmpty():
        return documents.unified(documents.results_from_summaries(ai), other, heading, True)
    if not call and summaries.isEmpty() and source == "tech":
        return documents.tech_report(summed, heading, insight)
    themed = ai.withColumn("theme", F.lit("")) if "theme" not in ai.columns else ai
    return documents.unified(ai, other, heading, False, models.deep_analysis(themed, call, heading.language))


def finalize(spark: SparkSession, args: argparse.Namespace, call: models.Call | None) -> int:
    kept, path = f"{args.workspace}/articles", f"{args.workspace}/report-{args.source}"
    now = datetime.fromisoformat(args.now) if args.now else datetime.now(timezone.utc)
    counted = {r["source"]: r for r in workspace.load_metadata(spark, f"{args.workspace}/runs").collect()}  # one row a source
    mine = counted.get(args.source)
    heading = Heading(args.language, f"{now:%Y-%m-%d}", f"{now:%H:%M}", mine["checked"] if mine else 0, mine["hours"] if mine else args.hours, os.environ.get("REPORT_BRAND", "Daily"))
    try:
        summaries = workspace.last_summaries(spark, f"{args.workspace}/summaries/*.json")
    except PySparkException:
        summaries = spark.createDataFrame([], workspace.SUMMARY)
    document = reported(spark, workspace.load_for(spark, kept, args.source), args.source, heading, args.format, summaries, call, workspace.load_insight(spark, f"{args.workspace}/trend_insight.json"))
    if document is None:
        print("nothing to report", file=sys.stderr)
        return 3
    lines = documents.placed(document, 0).select(F.lit("r").alias("doc"), (F.col("pos") - 1).alias("line_no"), "line")
    bullets = models.tldr(document, call, args.source, args.language) if args.format == "markdown" else ""
    if bullets:
        lines = report.with_tldr(lines, spark.createDataFrame([("r", bullets)], "doc string, bullets string"))
        workspace.write_report(lines, path, ["line_no", "part", "sub"])
    else:
        workspace.write_report(lines, path, ["line_no"])
    return 0


def main(argv: list[str] | None = None, session: Callable[[], SparkSession] | None = None, call: models.Call | None = None, fetch: http.Fetcher | None = None) -> int:
    logging.basicConfig(level=os.environ.get("LOG_LEVEL", "INFO").upper(), format="%(levelname)s %(message)s")
    args = parser().parse_args(argv)
    call = call or models.Endpoint.from_env()
    try:
        spark = session() if session else SparkSession.builder.appName("newsdesk").getOrCreate()
        if args.finalize:
            return finalize(spark, args, call)
        if not args.articles and not args.feeds:
            print("--articles or --feeds is needed to collect", file=sys.stderr)
            return 2
        fetch = fetch or http.Fetcher.from_env()
        articles = scan(spark, args, fetch) if args.feeds else spark.read.parquet(args.articles)
        if args.limit and not args.feeds:
            first = articles.groupBy("source").agg(F.min("pos").alias("first")).orderBy("first").limit(args.limit)
            articles = articles.join(first.select("source"), "source", "left_semi")
        return keep(spark, articles, args, fetch)
    except KeyboardInterrupt:
        return 130
    except (PySparkException, OSError) as e:
        log.error("%s", str(e).splitlines()[0] if str(e) else type(e).__name__)
        return 1


def keep(spark: SparkSession, articles: DataFrame, args: argparse.Namespace, fetch: http.Fetcher) -> int:
    """Collect and keep articles; account articles of a tech run are kept as the accounts'."""
    tracker = f"{args.workspace}/tracker"
    for c in ("hn_points", "hn_comments"):
        if c not in articles.columns:
            articles = articles.withColumn(c, F.lit(None).cast("int"))
    known = workspace.load_tracker(spark, tracker)
    at = F.lit(args.now).cast("timestamp") if args.now else F.current_timestamp()
    found, rows = collect(articles, dedup.unexpired(known, at), args.now, args.hours)
    found = stored(found, "found")
    if os.environ.get("ENRICH_FULL_TEXT"):
        wanted = editorial.enrichment_candidates(found)
        pages = http.fetched(wanted.select("url").where("url <> ''").distinct(), None, fetch, 0.5)
        with_source = found if "content_source" in found.columns else found.withColumn("content_source", F.lit(None).cast("string"))
        found = stored(enrich.with_page_text(with_source, pages), "enriched")
    if transcripts.configured():
        found = stored(transcripts.with_transcripts(found, fetch), "transcripts")
    # the articles first: a run that ends between the two writes collects the same ones again
    account = is_account_article(F.col("category"), F.col("url"))
    if args.source == "tech":
        workspace.save(found.where(~account), f"{args.workspace}/articles", "tech")
        if not found.where(account).isEmpty():
            workspace.save(found.where(account), f"{args.workspace}/articles", "wechat")
    else:
        workspace.save(found, f"{args.workspace}/articles", args.source)
    workspace.append_tracker(rows, tracker)
    now = args.now or datetime.now(timezone.utc).isoformat()
    workspace.save_metadata(spark, f"{args.workspace}/runs", args.source, articles.select("source").distinct().count(), args.hours, found.count(), now)
    if not dedup.expired(workspace.load_tracker(spark, tracker), at).where("removed > 0").isEmpty():
        workspace.prune_tracker(spark, tracker, lambda kept: dedup.unexpired(kept, at))
    return 0


if __name__ == "__main__":
    sys.exit(main())
