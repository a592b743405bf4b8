"""Filters, joins, groups, windows and scores over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.keywords import keywords
from ..functions.urls import article_id
from ..operators import dedup, editorial, numbering, topics
from ..sources import feeds, workspace
from .inputs import TEXT_ARTICLES, table, text_articles, url_variants
from .scalars import ORACLES as SCALAR_SQL


HOSTS = ("https://doc.example.com/", "https://doc.example.com/", "https://X.com/", "https://a.tiktok.com/", "https://youtu.be/", "https://login.example.com/", "https://Reddit.com/r/")


KNOWN = ("OpenAI.com blog", "x arxiv.org", "TechCrunch.com", "https://github.com/a", "机器之心", "nobody", "Blog.Google and wired.com")
CJK_DIGITS = "人工智能大模型数据集"


def _scored(spark, sf):
    """Text articles with same-title groups as clusters, priority by id and points from events, scored."""
    a = text_articles(spark, sf)
    groups = a.groupBy("title").agg(F.count("*").alias("cluster_size"), (F.countDistinct("source") > 1).alias("cross_source"))
    points = table(spark, sf, "events").groupBy(F.col("user_id").alias("uid")).agg(F.max(F.floor("value")).cast("int").alias("hn_points"))
    # some urls name sites that are not fetched
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("pos") % len(HOSTS) + 1).cast("int"))
    a = a.withColumn("url", F.concat(host, F.col("pos").cast("string")))
    a = a.withColumn("priority", (F.col("pos") % 4 + 1).cast("int")).join(groups, "title").join(points, F.col("pos") == F.col("uid"), "left")
    return editorial.scored(a)


def m0_tier_histogram(spark, sf):
    return _scored(spark, sf).groupBy("source", "editorial_tier").agg(F.count("*").alias("n"), text.round3(F.sum("news_value_score")).alias("value"))


def edt_scores(spark, sf):
    a = editorial.approved(_scored(spark, sf))
    return a.select("pos", "authority", text.round3(F.col("novelty")).alias("novelty"), "news_value_score", "editorial_tier", "depth", editorial.reason(a).alias("reason"))


def win05_first_per_url(spark, sf):
    return dedup.first_per_url(url_variants(spark, sf)).select("pos", "norm_url")


def ded06_unseen(spark, sf):
    """The plain urls are in the tracker; of the variants only those whose id differs are new."""
    v = url_variants(spark, sf).withColumn("title", F.col("url")).withColumn("source", F.lit("s"))
    tracker = v.where(F.col("pos") % 2 == 0).where(F.col("pos") < 1_000_000_000_000).select(article_id(F.col("url")).alias("id"))
    new, _ = dedup.unseen(v, tracker, F.lit("2024-01-31T00:00:00"))
    return new.select("pos", "id")


def ded07_unexpired(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("processed_at"))
    return dedup.unexpired(e, F.lit("2024-02-14 00:00:00").cast("timestamp")).agg(F.count("*").alias("kept"), F.sum("event_id").alias("ids"))


def clu02_keywords(spark, sf):
    return text_articles(spark, sf).select("pos", F.array_join(keywords(F.col("title"), F.col("description")), " ").alias("words"))


def flt04_ai_split(spark, sf):
    a = text_articles(spark, sf).withColumn("is_ai", text.has_ai_keyword(F.col("title"), F.col("description")))
    return a.groupBy("language", "is_ai").agg(F.count("*").alias("n"))


def _feed_items(spark, sf):
    """Events as items of their users' feeds, of which some lose their date."""
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return e.select(F.col("user_id").alias("feed"), F.col("event_id").alias("pos"), raw.alias("pub_date_raw"), F.lit("t").alias("title"), F.lit("l").alias("link"), "event_type", (F.col("user_id") % 4 + 1).cast("int").alias("priority"))


def flt01_time_window(spark, sf):
    """Both policies for undated items."""
    items, cutoff = _feed_items(spark, sf), F.lit("2024-01-15 00:00:00").cast("timestamp")
    dated = feeds.recent(items, cutoff, most=1 << 30).groupBy("event_type").agg(F.count("*").alias("dated"))
    kept = feeds.recent(items, cutoff, undated="keep", inclusive=True, most=1 << 30).groupBy("event_type").agg(F.count("*").alias("kept"))
    return dated.join(kept, "event_type")


def join01_summaries(spark, sf):
    """Articles with their summary's tier, noteworthy where there is none; tiers pivoted by source."""
    s = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = text_articles(spark, sf).select("pos", "source").join(s, F.col("pos") == F.col("doc_id"), "left")
    tier = F.coalesce(F.when(F.col("toxic") == 1, "brief").when(F.col("quality") == 1, "must_read"), F.lit("noteworthy"))
    return j.withColumn("tier", tier).groupBy("source").pivot("tier", list(editorial.TIERS)).count().na.fill(0)


def agg10_source_stats(spark, sf):
    d = table(spark, sf, "documents").withColumn("active", F.col("n_chars") > 500)
    return d.rollup("source", "lang").agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"))


def win03_ranks(spark, sf):
    """Rank within a category by score, and one number running over all categories (two levels: sizes of the categories before)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    numbered = numbering.ordered(d.withColumn("less", -F.col("n_chars")), ["lang", "less", "doc_id"], "number")
    first = d.groupBy(F.col("lang").alias("__l")).agg(F.count("*").alias("n"))
    return numbering.within(numbered, ["lang"], "number", "rank").join(first, F.col("lang").eqNullSafe(F.col("__l"))).select("doc_id", "rank", "number")


def win02_feed_caps(spark, sf):
    """Per-feed caps by priority: 1 all of 10, 2 seven, 3 five, others ten; undated items stay."""
    items = _feed_items(spark, sf)
    kept = feeds.recent(items, F.lit("2024-01-10 00:00:00").cast("timestamp"), undated="keep", inclusive=True, most=10, priority=F.col("priority"))
    return kept.select(F.col("feed").alias("user_id"), F.col("pos").alias("event_id"))


def src01_feed_scan(spark, sf):
    """Feeds scanned, dated, capped and deduplicated across sources, and what the scan counted."""
    e = table(spark, sf, "customer").where("c_custkey % 5 <> 4").select(F.concat(F.lit("f"), (F.col("c_custkey") % 40).cast("string")).alias("feed"), "c_custkey")
    day = F.date_format(F.timestamp_add("DAY", (F.col("c_custkey") % 20).cast("int"), F.lit("2024-01-01").cast("timestamp")), "yyyy-MM-dd")
    item = F.concat(F.lit("<item><title>t"), (F.col("c_custkey") % 600).cast("string"), F.lit("</title><link>https://e.com/"), (F.col("c_custkey") % 700).cast("string"), F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>"))
    docs = e.groupBy("feed").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("x")))), lambda s: s["x"]), ""), F.lit("</channel></rss>")).alias("xml"))
    scanned, _ = feeds.scanned(docs.withColumn("error", F.lit(None).cast("string")), F.lit("2024-01-08").cast("timestamp"), most=20)
    return scanned.select("feed", F.col("pos").cast("long").alias("pos"), "title", "url")


def top04_enrichment(spark, sf):
    a = _scored(spark, sf).withColumn("score", F.col("news_value_score"))
    return editorial.enrichment_candidates(a).select("pos", "rank_score")


def src10_markdown_list(spark, sf):
    """A list of nations under headings of their regions, in Markdown, and back."""
    from ..sources.catalog import parse_list

    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    heads = r.select((F.col("r_regionkey") * 1000).alias("line_no"), F.concat(F.lit("## "), F.col("r_name")).alias("line"))
    mark = F.when(F.col("n_nationkey") % 5 == 0, "~~").otherwise("")
    rows = n.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("line_no"), F.concat(F.lit("- "), mark, F.lit("["), F.col("n_name"), F.lit("](https://n.example.com/"), F.col("n_nationkey").cast("string"), F.lit(")"), mark).alias("line"))
    return parse_list(heads.union(rows)).select(F.col("index").cast("long").alias("index"), "name", "url", "category", "active")


def src19_last_summary(spark, sf):
    """The last of several writes for each key."""
    e = table(spark, sf, "events")
    batches = e.select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("ai_summary"), F.get_json_object("props", "$.k").alias("category"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("file"), F.col("event_id").alias("at"))
    return workspace.last_by_url(batches, ["file", "at"]).select(F.col("url").cast("long").alias("user_id"), F.col("ai_summary").alias("event_type"), F.col("category").alias("k"))


def join08_refs(spark, sf):
    """1-based references of themes to articles; those out of range go."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("theme"), F.array((F.col("o_orderkey") % 1500).cast("long"), (F.col("o_custkey") * 7).cast("long")).alias("refs"))
    refs = t.select("theme", F.posexplode("refs").alias("k", "ref")).join(table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("ref"), "source"), "ref")
    return refs.groupBy("theme").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))


def ded02_greedy_dedup(spark, sf):
    return dedup.greedy(text_articles(spark, sf)).select("pos", "url")


def clu04_topic_clusters(spark, sf):
    return topics.clusters(text_articles(spark, sf)).select("pos", "cluster_id", "cluster_size", "cross_source", "score")


def clu01_mixed_keywords(spark, sf):
    """Keywords of texts whose numbers are written with CJK characters, among Latin words."""
    cjk = F.translate(F.col("doc_id").cast("string"), "0123456789", CJK_DIGITS)
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("The "), F.col("source"), F.lit(" "), cjk).alias("title"), F.concat(F.col("lang"), F.lit(" GPT "), cjk).alias("description"))
    return d.select("doc_id", F.array_join(keywords(F.col("title"), F.col("description")), " ").alias("words"))


def clu06_known_sources(spark, sf):
    """Clusters of articles from sources of every weight."""
    a = text_articles(spark, sf).withColumn("source", F.element_at(F.array(*map(F.lit, KNOWN)), (F.col("pos") % len(KNOWN) + 1).cast("int")))
    return topics.clusters(a).select("pos", "cluster_id", "cross_source", "score")


def top01_ranked_clusters(spark, sf):
    """Clusters, best first."""
    best = topics.ranked(topics.clusters(text_articles(spark, sf))).withColumn("less", -F.col("score"))
    return numbering.ordered(best, ["less", "first"]).select("n", "cluster_id", "size", "score")


def join02_cluster_scores(spark, sf):
    """Articles scored by what their topic clusters say."""
    a = text_articles(spark, sf)
    info = topics.clusters(a).select(F.col("pos").alias("__pos"), "cluster_size", "cross_source")
    rows = a.join(info, F.col("pos") == F.col("__pos"), "left").withColumn("priority", F.lit(None).cast("int")).withColumn("hn_points", F.lit(None).cast("int"))
    return editorial.scored(rows).select("pos", "cluster_size", "cross_source", "news_value_score", "editorial_tier")


def edt03_factors(spark, sf):
    f = F.col("editorial_factors")
    return _scored(spark, sf).select("pos", *[f[k].alias(k) for k in ("authority", "cross_source", "novelty", "composite")])


def edt06_statistics(spark, sf):
    """Tiers and counts under other thresholds."""
    settings = editorial.Settings(must_read=0.6, noteworthy=0.45, least=0.42, promote_points=100)
    a = _scored(spark, sf).drop("authority", "novelty", "news_value_score", "editorial_tier", "depth", "editorial_factors")
    return editorial.statistics(editorial.scored(a, settings), settings)


def clu06_themes(spark, sf):
    return topics.themes(topics.clusters(text_articles(spark, sf)))


QUERIES = [
    m0_tier_histogram, edt_scores, win05_first_per_url, ded06_unseen, ded07_unexpired, clu02_keywords, flt04_ai_split, flt01_time_window, join01_summaries, agg10_source_stats, win03_ranks, win02_feed_caps,
    top04_enrichment, src10_markdown_list, src19_last_summary, join08_refs, ded02_greedy_dedup, clu01_mixed_keywords, clu04_topic_clusters, clu06_known_sources, clu06_themes,
    src01_feed_scan, join02_cluster_scores, top01_ranked_clusters, edt03_factors, edt06_statistics,
]


def _authority(text_: str, low: str) -> str:
    out = "CASE"
    for domain, weight in fixed.AUTHORITY:
        brand = domain.split(".")[0]
        out += f" WHEN contains({text_}, '{domain}')" + (f" OR contains({low}, '{brand}')" if "." in domain and len(brand) >= 4 else "") + f" THEN {weight}::DOUBLE"
    return out + " WHEN priority = 1 THEN 0.8::DOUBLE WHEN priority = 2 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END"


_SIGNAL = "(" + " OR ".join(f"contains(lower(title || ' ' || description), '{w}')" for w in fixed.HIGH_SIGNAL) + ")"
_SCORED = f"""WITH {TEXT_ARTICLES}, g AS (SELECT title, count(*) AS cluster_size, count(DISTINCT source) > 1 AS cross_source FROM text_articles GROUP BY title),
p AS (SELECT user_id, max(floor(value))::INTEGER AS hn_points FROM events GROUP BY user_id),
a AS (SELECT pos, title, {list(HOSTS)}[pos % {len(HOSTS)} + 1] || pos AS url, source, language, description, pos % 4 + 1 AS priority, cluster_size, cross_source, hn_points FROM text_articles JOIN g USING (title) LEFT JOIN p ON p.user_id = pos),
b AS (SELECT *, {_authority("(lower(source) || ' ' || lower(url))", "lower(source)")} AS authority FROM a),
c AS (SELECT *, CASE WHEN cluster_size <= 1 THEN 0.5::DOUBLE ELSE least(1 / sqrt(cluster_size::DOUBLE) + authority * 0.3::DOUBLE, 1) END AS novelty FROM b),
d AS (SELECT *, least(floor((authority * 0.25::DOUBLE + CASE WHEN cross_source THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END + least(cluster_size / 5.0::DOUBLE, 1) * 0.20::DOUBLE + CASE WHEN {_SIGNAL} THEN 0.15::DOUBLE ELSE 0::DOUBLE END + novelty * 0.15::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000, 1) AS news_value_score FROM c),
s AS (SELECT *, least(CASE WHEN news_value_score >= 0.7::DOUBLE THEN 2 WHEN news_value_score >= 0.4::DOUBLE THEN 1 ELSE 0 END + CASE WHEN coalesce(hn_points, 0) >= 200 THEN 1 ELSE 0 END + CASE WHEN priority = 1 THEN 1 ELSE 0 END, 2) AS level FROM d)"""
_KEYWORDS = f"""t AS (SELECT pos, regexp_extract_all(lower(title || ' ' || description), '[a-z0-9]+') AS ws FROM text_articles),
u AS (SELECT pos, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
f AS (SELECT pos, w, min(i) AS i FROM u WHERE length(w) >= 2 AND w NOT IN {tuple(fixed.STOP_WORDS_EN)} GROUP BY pos, w),
k AS (SELECT pos, w, i, row_number() OVER (PARTITION BY pos ORDER BY i) AS rn FROM f)"""
#: Articles that share a keyword set of more than a quarter's similarity, and so on: labels fall to the smallest article's.
_CLUSTERS = f"""WITH RECURSIVE {TEXT_ARTICLES}, {_KEYWORDS}, z AS (SELECT pos, w FROM k WHERE rn <= 15), size AS (SELECT pos, count(*) AS n FROM z GROUP BY pos),
    e AS (SELECT x, y FROM (SELECT a.pos AS x, b.pos AS y, count(*) AS shared FROM z a JOIN z b ON a.w = b.w AND a.pos <> b.pos GROUP BY 1, 2) JOIN size p ON p.pos = x JOIN size q ON q.pos = y WHERE shared::DOUBLE / (p.n + q.n - shared) > 0.25),
    label AS (SELECT pos, pos AS root FROM text_articles UNION SELECT y, root FROM label JOIN e ON e.x = label.pos WHERE root < y),
    rooted AS (SELECT pos, min(root) AS root FROM label GROUP BY pos), sizes AS (SELECT root, count(*) AS n FROM rooted GROUP BY root),
    named AS (SELECT t.*, CASE WHEN n = 1 THEN 'c_other' ELSE 'c_' || root END AS cluster_id FROM text_articles t JOIN rooted USING (pos) JOIN sizes USING (root)),
    info AS (SELECT cluster_id, count(*) AS cluster_size, count(DISTINCT source) > 1 AS cross_source,
        least(floor((least(count(*) / 5.0::DOUBLE, 1) * 0.25::DOUBLE + CASE WHEN count(DISTINCT source) > 1 THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END + avg(0.4::DOUBLE) * 0.25::DOUBLE + avg({_SIGNAL}::INTEGER::DOUBLE) * 0.25::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000, 1) AS score FROM named GROUP BY cluster_id)"""
_LADDER = "CASE" + "".join(f" WHEN contains(lower(source), '{domain}') THEN {weight}::DOUBLE" for domain, weight in fixed.AUTHORITY) + " ELSE 0.4::DOUBLE END"
_KNOWN_CLUSTERS = _CLUSTERS.replace("doc_id AS url, source,", f"doc_id AS url, {list(KNOWN)}[doc_id % {len(KNOWN)} + 1] AS source,").replace("avg(0.4::DOUBLE)", f"avg({_LADDER})")
ORACLES = {
    "clu01_mixed_keywords": f"""WITH d AS (SELECT doc_id, lower(source) AS s, lower(lang) AS l, translate(doc_id::VARCHAR, '0123456789', '{CJK_DIGITS}') AS c FROM documents),
        w AS (SELECT doc_id, list_concat(regexp_extract_all(s || ' ' || l || ' gpt', '[a-z0-9]+'), list_transform(generate_series(1, 2 * length(c) - 1), lambda i: substring(c || c, i, 2))) AS ws FROM d),
        u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), f AS (SELECT doc_id, w, min(i) AS i FROM u WHERE length(w) > 1 AND w NOT IN {tuple(fixed.STOP_WORDS_EN + fixed.STOP_WORDS_ZH)} GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM k WHERE rn <= 15 GROUP BY 1""",
    "clu06_known_sources": _KNOWN_CLUSTERS + " SELECT pos, cluster_id, cross_source, score FROM named JOIN info USING (cluster_id)",
    "m0_tier_histogram": _SCORED + " SELECT source, ['brief', 'noteworthy', 'must_read'][level + 1] AS editorial_tier, count(*) AS n, floor(sum(news_value_score) * 1000 + 0.5::DOUBLE) / 1000 AS value FROM s GROUP BY ALL",
    "edt_scores": _SCORED
    + """ SELECT pos, authority, floor(novelty * 1000 + 0.5::DOUBLE) / 1000 AS novelty, news_value_score, ['brief', 'noteworthy', 'must_read'][level + 1] AS editorial_tier, ['headline_only', 'summary_only', 'deep_analysis'][level + 1] AS depth,
        CASE WHEN cluster_size >= 3 OR cross_source OR priority = 1 OR hn_points >= 100 THEN concat_ws('，', CASE WHEN cluster_size >= 3 THEN cluster_size || '篇相关报道' END, CASE WHEN cross_source THEN '多源验证' END, CASE WHEN priority = 1 THEN '权威来源' END, CASE WHEN hn_points >= 100 THEN 'HN ' || hn_points || '赞' END)
        WHEN news_value_score >= 0.6::DOUBLE THEN '高新闻价值' WHEN description <> '' THEN substring(description, 1, 80) ELSE '值得关注' END AS reason FROM s WHERE news_value_score >= 0.15::DOUBLE""",
    "win05_first_per_url": f"WITH n AS ({SCALAR_SQL['ded01_normalize_url']}) SELECT min(pos) AS pos, norm_url FROM n GROUP BY norm_url",
    "ded06_unseen": f"WITH n AS ({SCALAR_SQL['ded04_tracker_id']}) SELECT min(pos) AS pos, article_id AS id FROM n WHERE article_id NOT IN (SELECT article_id FROM n WHERE pos % 2 = 0 AND pos < 1000000000000) GROUP BY article_id",
    "ded07_unexpired": "SELECT count(*) AS kept, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 10 <> 0 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-15 00:00:00'",
    "clu02_keywords": f"WITH {TEXT_ARTICLES}, {_KEYWORDS} SELECT pos, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (rn <= 15), '') AS words FROM text_articles LEFT JOIN k USING (pos) GROUP BY pos",
    "flt04_ai_split": "SELECT lang AS language, (" + " OR ".join(f"contains(lower(text), '{k}')" for k in sorted({x.lower() for x in fixed.AI_KEYWORDS_EN + fixed.AI_KEYWORDS_ZH})) + ") AS is_ai, count(*) AS n FROM documents GROUP BY ALL",
    "flt01_time_window": "SELECT event_type, count(*) FILTER (event_id % 7 <> 0 AND date_trunc('second', ts) > TIMESTAMP '2024-01-15') AS dated, count(*) FILTER (event_id % 7 = 0 OR date_trunc('second', ts) >= TIMESTAMP '2024-01-15') AS kept FROM events GROUP BY 1",
    "join01_summaries": """WITH s AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), t AS (SELECT d.source, CASE WHEN toxic = 1 THEN 'brief' WHEN quality = 1 THEN 'must_read' ELSE 'noteworthy' END AS tier FROM documents d LEFT JOIN s USING (doc_id))
        SELECT source, count(*) FILTER (tier = 'brief') AS brief, count(*) FILTER (tier = 'noteworthy') AS noteworthy, count(*) FILTER (tier = 'must_read') AS must_read FROM t GROUP BY 1""",
    "agg10_source_stats": "SELECT source, lang, count(*) AS total, count(*) FILTER (n_chars > 500) AS active, count(*) FILTER (NOT n_chars > 500) AS inactive FROM documents GROUP BY ROLLUP (source, lang)",
    "win03_ranks": "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) AS number FROM documents",
    "win02_feed_caps": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_id % 7 = 0 OR date_trunc('second', ts) >= TIMESTAMP '2024-01-10') WHERE rn <= CASE user_id % 4 + 1 WHEN 1 THEN 10 WHEN 2 THEN 7 WHEN 3 THEN 5 ELSE 10 END",
    "src01_feed_scan": """WITH c AS (SELECT 'f' || c_custkey % 40 AS feed, c_custkey, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_custkey % 5 <> 4),
        k AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) AS rn FROM c WHERE c_custkey % 20 > 7), r AS (SELECT *, row_number() OVER (ORDER BY feed, pos) AS i FROM k WHERE rn <= 20),
        e AS (SELECT a.i, list(b.i) AS before FROM r a JOIN r b ON b.i < a.i AND (a.c_custkey % 700 = b.c_custkey % 700 OR a.c_custkey % 600 = b.c_custkey % 600) GROUP BY a.i),
        o AS (SELECT r.i, coalesce(before, []) AS before FROM r LEFT JOIN e USING (i)),
        g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, o.i) END FROM g JOIN o ON o.i = g.i + 1)
        SELECT feed, pos, 't' || c_custkey % 600 AS title, 'https://e.com/' || c_custkey % 700 AS url FROM r WHERE list_contains((SELECT arg_max(kept, i) FROM g), r.i)""".replace("WITH c", "WITH RECURSIVE c"),
    "top04_enrichment": _SCORED + " SELECT pos, news_value_score AS rank_score FROM s WHERE level = 2 AND pos % 7 NOT IN (2, 5, 6) ORDER BY news_value_score DESC, pos LIMIT 50",
    "ded02_greedy_dedup": f"""WITH RECURSIVE {TEXT_ARTICLES}, w AS (SELECT pos, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(trim(title)), '[\\s\\-_:,;|/\\\\]+'), lambda x: x <> ''))) AS ws FROM text_articles),
        s AS (SELECT row_number() OVER () AS s, ws FROM (SELECT DISTINCT ws FROM w WHERE len(ws) > 0)), t AS (SELECT s, unnest(ws) AS t FROM s), df AS (SELECT t, count(*) AS df FROM t GROUP BY 1),
        r AS (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY df, t) AS k, count(*) OVER (PARTITION BY s) AS n FROM t JOIN df USING (t)), p AS (SELECT s, t, n FROM r WHERE k <= n - ceil(n * 0.85) + 1),
        c AS (SELECT DISTINCT a.s AS x, b.s AS y FROM p a JOIN p b ON a.t = b.t AND a.s < b.s AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n),
        l AS (SELECT x, y FROM (SELECT x, y, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) AS n, len(b.ws) AS m FROM c JOIN s a ON a.s = x JOIN s b ON b.s = y) WHERE i::DOUBLE / (n + m - i) > 0.85),
        q AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l UNION ALL SELECT s, s FROM s), ps AS (SELECT pos, s FROM w JOIN s USING (ws)),
        e AS (SELECT a.pos AS x, list(b.pos) AS before FROM ps a JOIN q ON q.x = a.s JOIN ps b ON b.s = q.y AND b.pos < a.pos GROUP BY a.pos),
        o AS (SELECT row_number() OVER (ORDER BY pos) AS i, pos, coalesce(before, []) AS before FROM (SELECT x AS pos FROM e UNION SELECT unnest(before) FROM e) LEFT JOIN e ON x = pos),
        g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, pos) END FROM g JOIN o ON o.i = g.i + 1),
        kept AS (SELECT unnest(kept) AS pos FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)) SELECT pos, url FROM text_articles WHERE pos NOT IN (SELECT pos FROM o) OR pos IN (SELECT pos FROM kept)""",
    "clu04_topic_clusters": _CLUSTERS + " SELECT pos, cluster_id, cluster_size, cross_source, score FROM named JOIN info USING (cluster_id)",
    "clu06_themes": _CLUSTERS + """, counts AS (SELECT cluster_id, w, count(*) AS n, any_value(cluster_size) AS size FROM k JOIN named USING (pos) JOIN info USING (cluster_id) WHERE rn <= 15 GROUP BY cluster_id, w),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n < size, CASE WHEN n = size THEN 0 ELSE -n END, w) AS r, bool_or(n = size) OVER (PARTITION BY cluster_id) AS any_shared FROM counts),
        theme_t AS (SELECT cluster_id, string_agg(w, ' ' ORDER BY r) AS theme FROM ranks WHERE CASE WHEN any_shared THEN n = size AND r <= 5 ELSE r <= 3 END GROUP BY cluster_id)
        SELECT cluster_id, coalesce(theme, '') AS theme FROM info LEFT JOIN theme_t USING (cluster_id)""",
    "top01_ranked_clusters": _CLUSTERS + " SELECT row_number() OVER (ORDER BY score DESC, min(pos)) AS n, cluster_id, any_value(cluster_size) AS size, score FROM named JOIN info USING (cluster_id) GROUP BY cluster_id, score",
    "join02_cluster_scores": _CLUSTERS + f""", a AS (SELECT pos, title, description, cluster_size, cross_source, {_authority("(lower(source) || ' ' || lower(url))", "lower(source)")} AS authority FROM (SELECT named.*, 3 AS priority, cluster_size, cross_source FROM named JOIN info USING (cluster_id))),
        v AS (SELECT *, least(floor((authority * 0.25::DOUBLE + CASE WHEN cross_source THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END + least(cluster_size / 5.0::DOUBLE, 1) * 0.20::DOUBLE + CASE WHEN {_SIGNAL} THEN 0.15::DOUBLE ELSE 0::DOUBLE END
            + CASE WHEN cluster_size <= 1 THEN 0.5::DOUBLE ELSE least(1 / sqrt(cluster_size::DOUBLE) + authority * 0.3::DOUBLE, 1) END * 0.15::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000, 1) AS news_value_score FROM a)
        SELECT pos, cluster_size, cross_source, news_value_score, CASE WHEN news_value_score >= 0.7::DOUBLE THEN 'must_read' WHEN news_value_score >= 0.4::DOUBLE THEN 'noteworthy' ELSE 'brief' END AS editorial_tier FROM v""",
    "edt03_factors": _SCORED + """ SELECT pos, authority, CASE WHEN cross_source THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END AS cross_source, novelty, news_value_score AS composite FROM s""",
    "edt06_statistics": _SCORED + """ SELECT count(*) AS total, count(*) FILTER (v >= 0.42) AS approved, count(*) FILTER (v < 0.42) AS filtered, count(*) FILTER (v >= 0.42 AND l = 2) AS must_read, count(*) FILTER (v >= 0.42 AND l = 1) AS noteworthy, count(*) FILTER (v >= 0.42 AND l = 0) AS brief
        FROM (SELECT news_value_score AS v, least(CASE WHEN news_value_score >= 0.6::DOUBLE THEN 2 WHEN news_value_score >= 0.45::DOUBLE THEN 1 ELSE 0 END + CASE WHEN coalesce(hn_points, 0) >= 100 THEN 1 ELSE 0 END + CASE WHEN priority = 1 THEN 1 ELSE 0 END, 2) AS l FROM s)""",
    "src10_markdown_list": "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS index, n_name AS name, 'https://n.example.com/' || n_nationkey AS url, r_name AS category, n_nationkey % 5 <> 0 AS active FROM nation JOIN region ON n_regionkey = r_regionkey",
    "src19_last_summary": "SELECT user_id, event_type, json_extract_string(props, '$.k') AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "join08_refs": "WITH r AS (SELECT o_orderkey AS theme, unnest([o_orderkey % 1500, o_custkey * 7]) AS ref FROM orders) SELECT theme, count(*) AS n, min(source) AS first_source FROM r JOIN documents ON ref = doc_id + 1 GROUP BY 1",
}
