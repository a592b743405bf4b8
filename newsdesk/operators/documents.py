"""Whole reports as line tables.

A document is a DataFrame of lines with the columns of ``ORDER`` (section, group, tier, position, line of a block) and ``line``; sorted by
these it is the text. What reaches the driver while one is made is one row of counts. Texts are escaped where they stand in tables.

Articles have pos (unique), title, url, source, category, description; further columns where named. Null texts count as empty; an empty
table gives a document without the parts that need articles.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.extract import summary_text
from ..functions.text import category_display, category_order, demote_headings, escape_cell, make_anchor, normalize_category, strip_leading_emoji, strip_tags, truncate
from . import numbering
from .editorial import reason
from .setjoin import cut

ORDER = ["sec", "grp", "tier", "pos", "sub"]
LINES = "sec int, grp long, tier int, pos long, sub int, line string"
_KNOWN = [k for k, _, _ in fixed.CATEGORIES]
_TIER = {"must_read": 1, "noteworthy": 2, "brief": 3}


@dataclass(frozen=True)
class Heading:
    """What a report says of itself: language, date, time, sources checked, hours looked back, name of the publication."""

    language: str = "zh"
    date: str = ""
    time: str = ""
    checked: int = 0
    hours: int = 24
    brand: str = "Daily"

    @property
    def words(self) -> dict[str, str]:
        return fixed.LABELS[self.language]


def given(spark: SparkSession, sec: int, lines: Iterable[str], grp: int = 0, tier: int = 0, pos: int = 0) -> DataFrame:
    """Lines that don't depend on articles."""
    return spark.createDataFrame([(sec, grp, tier, pos, k, x) for k, x in enumerate(lines)], LINES)


def block(rows: DataFrame, sec: int, grp: Column | int, tier: Column | int, pos: Column | int, *lines: Column) -> DataFrame:
    """The lines (null ones left out) of each row."""
    place = lambda x, t: (F.lit(x) if isinstance(x, int) else x).cast(t)
    return rows.select(F.lit(sec).alias("sec"), place(grp, "long").alias("grp"), place(tier, "int").alias("tier"), place(pos, "long").alias("pos"), F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("sub", "line"))


def _numbered(lines: list[Column]) -> Column:
    """sub and line of the lines that aren't null."""
    return F.transform(F.filter(F.array(*lines), lambda x: x.isNotNull()), lambda x, i: F.struct(i.alias("sub"), x.alias("line")))


def frames(rows: DataFrame, sec: int, grp: Column, *parts: tuple[Column | None, int, int, list[Column]]) -> DataFrame:
    """The lines around the articles of each row's group, from one look at it. parts: a condition or none, tier, position, lines."""
    place = lambda tier, pos: lambda x: F.struct(F.lit(tier).alias("tier"), F.lit(pos).cast("long").alias("pos"), x["sub"].cast("int").alias("sub"), x["line"].alias("line"))
    made = []
    for when, tier, pos, lines in parts:
        part = F.transform(_numbered(lines), place(tier, pos))
        made.append(part if when is None else F.when(when, part).otherwise(F.array().cast("array<struct<tier:int,pos:bigint,sub:int,line:string>>")))
    return rows.select(F.lit(sec).alias("sec"), grp.cast("long").alias("grp"), F.inline(F.flatten(F.array(*made))))


def choices(rows: DataFrame, sec: int, grp: Column, tier: Column, pos: Column, lines: dict[int, list[Column]]) -> DataFrame:
    """The lines of each row as its tier has them, from one look at the rows."""
    made = None
    for t, of_tier in lines.items():
        made = F.when(tier == t, _numbered(of_tier)) if made is None else made.when(tier == t, _numbered(of_tier))
    return rows.select(F.lit(sec).alias("sec"), grp.cast("long").alias("grp"), tier.cast("int").alias("tier"), pos.cast("long").alias("pos"), F.inline(made))


def joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def once(results: DataFrame) -> DataFrame:
    """results as a stored table, so that what made them runs once however many parts of a report read them; stored ones as they are."""
    if hasattr(results, "newsdesk_path"):
        return results
    return cut(results)


def placed(document: DataFrame, sec: int) -> DataFrame:
    """A document as one section of another; its own sections become groups' order through a numbering of its lines."""
    return numbering.ordered(document, ORDER).select(F.lit(sec).alias("sec"), F.lit(0).cast("long").alias("grp"), F.lit(0).alias("tier"), F.col("n").alias("pos"), F.lit(0).alias("sub"), "line")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _piped(c: Column) -> Column:
    """Pipes escaped, line ends kept."""
    return F.replace(_filled(c), F.lit("|"), F.lit("\\|"))


def _cell(c: Column) -> Column:
    return escape_cell(_filled(c))


def _title(title: Column, url: Column) -> Column:
    return F.concat(F.lit("[**"), _cell(title), F.lit("**]("), _cell(url), F.lit(")"))


def _row(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells]), F.lit(" |"))


def table_row(number: Column, title: Column, url: Column, source: Column, summary: Column) -> Column:
    """A row of an article table; a summary adds a cell."""
    first = (number, _title(title, url), F.concat(F.lit("*"), _cell(source), F.lit("*")))
    return F.when(_filled(summary) != "", _row(*first, _cell(summary))).otherwise(_row(*first))


def short_text(description: Column, mark: str = "...") -> Column:
    """The start of a description without tags, 150 characters and an ellipsis if it is longer."""
    plain = strip_tags(F.trim(_filled(description), F.lit(" \t\r\n")))
    return truncate(plain, 150) if mark else F.substring(plain, 1, 150)


def _counted(df: DataFrame, *aggregates: Column) -> Row:
    return df.agg(F.count("*").alias("n"), *aggregates).collect()[0]


def points_section(items: DataFrame, h: Heading, sec: int) -> DataFrame:
    """Items with points and comments as a table, with summaries if any has one (ai_summary). Needs hn_points, hn_comments."""
    w, spark = h.words, items.sparkSession
    info = _counted(items, F.bool_or(_filled(F.col("ai_summary")) != "").alias("summaries"))
    if not info["n"]:
        return spark.createDataFrame([], LINES)
    stats = F.concat_ws(" · ", F.concat(F.lit("🔥 "), F.col("hn_points").cast("string")), F.concat(F.lit("💬 "), F.col("hn_comments").cast("string")))
    cells = ["number", _title(F.col("title"), F.col("url")), _cell(stats), *([_cell(F.col("ai_summary"))] if info["summaries"] else [])]
    head = [f"## {w['points_table']} ({info['n']} {w['count']})", "", f"| # | {w['article']} | {w['stats']} |" + (f" {w['summary']} |" if info["summaries"] else ""), "|---:|------|------|------|" if info["summaries"] else "|---:|------|------|"]
    rows = block(numbering.within(items.withColumn("__all", F.lit(0)), ["__all"]), sec, 0, 1, F.col("pos"), _row(F.col("number"), *cells[1:]))
    return joined([given(spark, sec, head), rows, given(spark, sec, [""], tier=2)])


def category_tables(items: DataFrame, h: Heading, sec: int) -> DataFrame:
    """A table for each category in the fixed order, unknown ones together at the end. Needs cat (normalised), text (a summary or '')."""
    w = h.words
    known = F.col("cat").isin(_KNOWN)
    named = cut(items.select("pos", "title", "url", "source", "cat", "text")).withColumn("__cat", F.when(known, F.col("cat")).otherwise(fixed.OTHER_CATEGORY)).withColumn("__grp", F.when(known, category_order(F.col("cat"))).otherwise(99).cast("long"))
    heads = named.groupBy("__cat", "__grp").agg(F.count("*").alias("n"), F.bool_or(F.col("text") != "").alias("texts"))
    title = F.concat(F.lit("## "), category_display(F.col("__cat")), F.lit(" ("), F.col("n").cast("string"), F.lit(f" {w['count']})"))
    header = F.concat(F.lit(f"| # | {w['article']} | {w['source']} |"), F.when(F.col("texts"), f" {w['summary']} |").otherwise(""))
    rule = F.when(F.col("texts"), "|---:|------|------|------|").otherwise("|---:|------|------|")
    rows = numbering.within(named, ["__grp"])
    return joined([
        frames(heads, sec, F.col("__grp"), (None, 0, 0, [title, F.lit(""), header, rule]), (None, 2, 0, [F.lit("")])),
        block(rows, sec, F.col("__grp"), 1, F.col("pos"), table_row(F.col("number"), F.col("title"), F.col("url"), F.col("source"), F.col("text"))),
    ])


def with_summaries(articles: DataFrame, summaries: DataFrame) -> DataFrame:
    """articles with ai_summary, ai_category, ai_tier and ai_reason of their url's summary. summaries: url (unique), ai_summary, category, tier, importance_reason."""
    s = summaries.select(F.col("url").alias("__url"), "ai_summary", F.col("category").alias("ai_category"), F.col("tier").alias("ai_tier"), F.col("importance_reason").alias("ai_reason"))
    return articles.join(s, F.col("url") == F.col("__url"), "left").drop("__url")


def tech_report(articles: DataFrame, h: Heading, insight: str = "") -> DataFrame:
    """Articles (see :func:`with_summaries`) by category, then those with points; a summary's category wins over the article's."""
    w, spark = h.words, articles.sparkSession
    own = normalize_category(F.col("category"))
    marked = cut(articles.withColumn("__own", own))
    n = marked.count()
    head = [f"# {w['daily']} — {h.date}", "", "> " + w["checked"].format(checked=h.checked, hours=h.hours, n=n), "", "---", ""]
    if insight:
        head += [f"## {w['insight']}", "", insight, "", "---", ""]
    pointed = marked.where("__own = 'hacker_news'")
    others = marked.where("__own IS NULL OR __own <> 'hacker_news'")
    cat = F.when(_filled(F.col("ai_category")) != "", normalize_category(F.col("ai_category"))).otherwise(F.col("__own"))
    text = F.when(_filled(F.col("ai_summary")) != "", F.col("ai_summary")).otherwise(short_text(F.col("description")))
    tables = category_tables(others.withColumn("cat", cat).withColumn("text", text), h, 1)
    return joined([given(spark, 0, head), tables, points_section(pointed, h, 2), given(spark, 3, [f"*{w['footer']}: {h.date} {h.time} UTC*"])])


def results_from_summaries(articles: DataFrame) -> DataFrame:
    """pos, title, url, source, cat, name, grp, key, tier, text of articles with summaries; categories in the order they are first met."""
    ai = F.col("ai_category")
    cat = F.when(_filled(ai) != "", normalize_category(ai)).otherwise(normalize_category(F.col("category")))
    tier = F.when(F.col("ai_tier") == "must_read", 1).when(F.col("ai_tier") == "brief", 3).otherwise(2)
    text = F.coalesce(F.nullif(F.col("ai_reason"), F.lit("")), F.col("ai_summary"), F.lit(""))
    return _placed_by_category(articles.select("pos", "title", "url", "source", cat.alias("cat"), F.col("pos").cast("long").alias("key"), tier.alias("tier"), F.when(tier < 3, text).otherwise("").alias("text")))


def results_from_scores(articles: DataFrame) -> DataFrame:
    """The same of scored articles, in each category best first, then by pos; the text says why they matter."""
    key = (1000 - F.round(F.coalesce("news_value_score", F.lit(0.0)) * 1000)).cast("long") * (1 << 42) + F.col("pos")
    tier = F.when(F.col("editorial_tier") == "must_read", 1).when(F.col("editorial_tier") == "brief", 3).otherwise(2)
    text = F.when(tier < 3, reason(articles)).otherwise("")
    return _placed_by_category(articles.select("pos", "title", "url", "source", normalize_category(F.col("category")).alias("cat"), key.alias("key"), tier.alias("tier"), text.alias("text")))


def _placed_by_category(rows: DataFrame) -> DataFrame:
    first = rows.groupBy(F.col("cat").alias("__c")).agg(F.min("pos").cast("long").alias("grp"))
    return rows.join(first, F.col("cat").eqNullSafe(F.col("__c"))).drop("__c").withColumn("name", category_display(F.col("cat")))


def tiered_sections(results: DataFrame, h: Heading, sec: int, rules: bool = False, summaries: DataFrame | None = None) -> DataFrame:
    """Each category: its must-reads one by one, a table of noteworthy articles, a folded table of brief ones.

    rules: a rule after each category. summaries: cat, category_summary (quoted under the heading).
    """
    w = h.words
    results = once(results)
    counts = results.groupBy("grp", "cat", "name").agg(F.count("*").alias("n"), *[F.count_if(F.col("tier") == t).alias(f"n{t}") for t in (1, 2, 3)])
    if summaries is not None:
        counts = counts.join(summaries.select(F.col("cat").alias("__c"), "category_summary"), F.col("cat").eqNullSafe(F.col("__c")), "left")
    else:
        counts = counts.withColumn("category_summary", F.lit(None).cast("string"))
    quoted = F.nullif(F.col("category_summary"), F.lit(""))
    title = F.concat(F.lit("## "), F.col("name"), F.lit(" ("), F.col("n").cast("string"), F.lit(f" {w['articles']})"))
    grp = F.col("grp")
    folded = F.concat(F.lit(f"<summary>📋 {w['brief']} ("), F.col("n3").cast("string"), F.lit(f" {w['articles']})</summary>"))
    rows = numbering.within(results, ["grp", "tier"], "key")
    linked = F.concat(F.lit("**"), F.col("number").cast("string"), F.lit(". ["), _cell(F.col("title")), F.lit("]("), _piped(F.col("url")), F.lit(")**"))
    said = F.concat(F.lit(f"> **{w['source']}**: *"), _piped(F.col("source")), F.lit("*"), F.when(F.col("text") != "", F.concat(F.lit(f" | **{w['why']}**: "), F.col("text"))).otherwise(""))
    noted = _row(F.col("number"), _title(F.col("title"), F.col("url")), F.concat(F.lit("*"), _cell(F.col("source")), F.lit("*")), _cell(F.col("text")))
    bare = table_row(F.col("number"), F.col("title"), F.col("url"), F.col("source"), F.lit(""))
    lit = F.lit
    around = [
        (None, 0, 0, [title, lit(""), F.concat(lit("> "), quoted), F.when(quoted.isNotNull(), "")]),
        (F.col("n1") > 0, 1, -1, [lit(f"### {w['must']}"), lit("")]),
        (F.col("n2") > 0, 2, -1, [lit(f"### {w['note']}"), lit(""), lit(f"| # | {w['article']} | {w['source']} | {w['point']} |"), lit("|---|---------|--------|-----------|")]),
        (F.col("n2") > 0, 3, -2, [lit("")]),
        (F.col("n3") > 0, 3, -1, [lit("<details>"), folded, lit(""), lit(f"| # | {w['article']} | {w['source']} |"), lit("|---|---------|--------|")]),
        (F.col("n3") > 0, 4, 0, [lit(""), lit("</details>"), lit("")]),
        *([(None, 5, 0, [lit("---"), lit("")])] if rules else []),
    ]
    return joined([frames(counts, sec, grp, *around), choices(rows, sec, grp, F.col("tier"), F.col("key"), {1: [linked, lit(""), said, lit("")], 2: [noted], 3: [bare]})])


def todays_highlights(results: DataFrame, h: Heading, sec: int, most: int = 5) -> DataFrame:
    """The first must-reads across categories (a top list)."""
    w, spark = h.words, results.sparkSession
    top = results.where("tier = 1").orderBy("grp", "key").limit(most)
    if top.isEmpty():
        return spark.createDataFrame([], LINES)
    linked = F.concat(F.lit("### ⭐ ["), _cell(F.col("title")), F.lit("]("), _piped(F.col("url")), F.lit(")"))
    said = F.concat(F.lit(f"> **{w['source']}**: *"), _piped(F.col("source")), F.lit(f"* | **{w['why']}**: "), F.col("text"))
    rows = block(top, sec, F.col("grp"), 1, F.col("key"), linked, F.lit(""), said, F.lit(""))
    return joined([given(spark, sec, [f"## {w['highlights']}", ""], grp=-1), rows, given(spark, sec, ["---", ""], grp=1 << 62)])


def tiered_report(results: DataFrame, h: Heading, executive: str = "", summaries: DataFrame | None = None) -> DataFrame:
    """The tech report in tiers: heading, summary, highlights, categories, footer."""
    w, spark = h.words, results.sparkSession
    results = once(results)
    info = _counted(results, F.countDistinct("grp").alias("groups"))
    made = f"> 📰 {info['n']} {w['ai_made'].format(n=info['groups'])}"
    head = [f"# {w['daily']} — {h.date}", "", made, "", "---", "", *([f"## {w['executive']}", "", executive, "", "---", ""] if executive else [])]
    foot = [f"*{w['tiered_footer']}: {h.date} {h.time} UTC*"]
    return joined([given(spark, 0, head), todays_highlights(results, h, 1), tiered_sections(results, h, 2, True, summaries), given(spark, 3, foot)])


def other_news(articles: DataFrame, h: Heading, sec: int = 0) -> DataFrame:
    """Part two: must-reads first, then tables of the other articles; subject categories stay out. Needs editorial_tier, hn_points, hn_comments and cross_source."""
    w, spark = h.words, articles.sparkSession
    a = cut(articles.withColumn("cat", normalize_category(F.col("category"))))
    info = _counted(a)
    if not info["n"]:
        return spark.createDataFrame([], LINES)
    pointed = F.coalesce(F.col("cat") == "hacker_news", F.lit(False))
    must = F.coalesce(F.col("editorial_tier") == "must_read", F.lit(False))
    top = a.where(must & ~pointed)
    desc = F.nullif(short_text(F.col("description"), ""), F.lit(""))
    said = F.when(F.coalesce("cross_source", F.lit(False)), w["verified"]).otherwise("")
    line = F.concat(F.lit("- **"), F.concat(F.lit("["), _cell(F.col("title")), F.lit("]("), _cell(F.col("url")), F.lit(")")), F.lit("** — "), _filled(F.col("source")), said)
    listed = block(top, sec + 1, 0, 1, F.col("pos"), line, F.concat(F.lit("  > "), desc), F.lit(""))
    rest = a.where(~pointed & ~must & ~F.coalesce(F.col("cat").isin(*fixed.DIRECT_CATEGORIES), F.lit(False))).withColumn("text", short_text(F.col("description")))
    parts = [given(spark, sec, [w["part2"].format(n=info["n"]), ""]), listed, category_tables(rest, h, sec + 2), points_section(a.where(pointed).withColumn("ai_summary", F.lit("")), h, sec + 3)]
    return joined([*parts, *([given(spark, sec + 1, [w["top_news"], ""])] if not top.isEmpty() else [])])


def listing(articles: DataFrame, h: Heading, sec: int = 0) -> DataFrame:
    """Part one without a model: one table of all articles with their summaries."""
    w, spark = h.words, articles.sparkSession
    info = _counted(articles)
    if not info["n"]:
        return spark.createDataFrame([], LINES)
    head = [w["part1"].format(n=info["n"]), "", w["listing"], "", f"| # | {w['article']} | {w['source']} | {w['category']} | {w['summary']} |", "|---:|------|------|------|------|"]
    rows = numbering.within(articles.withColumn("__all", F.lit(0)), ["__all"])
    title = F.concat(F.lit("[**"), _cell(F.col("title")), F.lit("**]("), _piped(F.col("url")), F.lit(")"))
    line = _row(F.col("number"), title, F.concat(F.lit("*"), _piped(F.col("source")), F.lit("*")), _piped(F.col("category")), _cell(F.col("ai_summary")))
    return joined([given(spark, sec, head), block(rows, sec, 0, 1, F.col("pos"), line), given(spark, sec, [""], tier=2)])


def written(spark: SparkSession, n: int, text: str, h: Heading, sec: int = 0) -> DataFrame:
    """Part one as a model wrote it."""
    return given(spark, sec, [h.words["part1"].format(n=n), "", *text.strip().split("\n")])


def unified(ai: DataFrame, other: DataFrame, h: Heading, tiered: bool, deep_text: str | None = None) -> DataFrame:
    """The report in two parts. ai: see :func:`listing`, or with tiered what a results function gave; other: see :func:`other_news`."""
    w, spark = h.words, ai.sparkSession
    n, m = ai.count(), other.count()
    if not n + m:
        return spark.createDataFrame([], LINES)
    head = [f"# 📰 {h.brand} — {h.date}", "", w["unified"].format(ai=n, other=m, n=n + m), "", w["unified_time"].format(time=h.time), "", "---", ""]
    if tiered:
        first = joined([given(spark, 0, [w["part1"].format(n=n), ""]), tiered_report(ai, h).withColumn("sec", F.col("sec") + 1)])
    else:
        first = written(spark, n, deep_text, h) if deep_text else listing(ai, h)
    parts = [given(spark, 0, head), placed(first, 1)] if n or tiered else [given(spark, 0, head)]
    if m:
        parts += [*([given(spark, 2, ["", "---", ""])] if len(parts) > 1 else []), placed(other_news(other, h), 3)]
    return joined(parts)


def _body(lines: DataFrame, span: int = numbering.SPAN) -> DataFrame:
    """sec, n, line between a section's first rule (else its title, blank and quoted lines) and its footer."""
    t = F.trim("line", F.lit(" \t\r\n"))
    head = F.col("line").startswith("# ") | (t == "") | F.col("line").startswith(">")
    foot = (t == "") | (t == "---") | F.col("line").contains(fixed.FOOTER_WORDS[0]) | F.col("line").contains(fixed.FOOTER_WORDS[1]) | (t.startswith("*") & F.col("line").contains("UTC"))
    rule = lines.groupBy("sec").agg(F.min(F.when(t == "---", F.col("n"))).alias("rule"), F.min(F.when(~head, F.col("n"))).alias("text"))
    after = lines.join(rule, "sec").where(F.when(F.col("rule").isNotNull(), F.col("n") > F.col("rule")).otherwise(F.col("n") >= F.col("text")))
    ends = after.groupBy("sec").agg(F.min(F.when((t != "") & (t != "---"), F.col("n"))).alias("first"), F.max(F.when(~foot, F.col("n"))).alias("last"))
    kept = after.drop("rule", "text").join(ends, "sec").where("n BETWEEN first AND last").drop("first", "last")
    # of rules with only blank lines between them the first stays, and no blank line after it
    blank, is_rule, kept = t == "", t == "---", cut(kept)
    marked = numbering.carried(kept, F.when(~blank, F.struct(is_rule.alias("rule"), F.col("n").alias("n"))), "before", ["sec"], "n", span, own=False)
    marked = numbering.carried(marked, F.when(~blank, is_rule), "after", ["sec"], "n", span, ahead=True, own=False)
    marked = cut(marked.withColumn("again", is_rule & F.coalesce(F.col("before.rule"), F.lit(False))))
    marked = numbering.carried(marked, F.when(~blank, F.col("again") | (is_rule & F.coalesce("after", F.lit(False)))), "many", ["sec"], "n", span)
    return marked.where(~F.col("again") & ~(blank & F.coalesce("many", F.lit(False)))).select("sec", "n", "line")


def merged(documents: list[DataFrame], h: Heading) -> DataFrame:
    """Documents one after the other under their first headings, with contents; headings three levels down, heads and footers cut."""
    w, spark = h.words, documents[0].sparkSession
    lines = cut(joined([numbering.ordered(d, ORDER).select(F.lit(k).alias("sec"), "n", "line") for k, d in enumerate(documents)]))
    t = F.trim("line", F.lit(" \t\r\n"))
    named = lines.where(t.startswith("#")).groupBy("sec").agg(F.min_by(t, "n").alias("line"))
    names = named.select("sec", F.trim(F.regexp_replace("line", "^#+", ""), F.lit(" \t\r\n")).alias("name"))
    body = cut(_body(lines))
    shown = names.join(body.select("sec").distinct(), "sec").withColumn("anchor", make_anchor(F.col("name")))
    found = names.select("sec", "name").orderBy("sec").collect()  # one row a document
    head = [f"# 📰 {h.brand} — {h.date}", "", "> 📡 " + " · ".join(r["name"] for r in found), "", w["time"].format(time=h.time), "", "---", "", w["contents"], ""]
    last = shown.agg(F.max("sec")).collect()[0][0]
    entry = F.concat(F.lit("- ["), F.col("name"), F.lit("](#"), F.col("anchor"), F.lit(")"))
    demoted = body.withColumn("line", demote_headings(F.col("line"), 3))
    return joined([
        given(spark, 0, head), block(shown, 1, 0, 0, F.col("sec"), entry), given(spark, 2, ["", "---", ""]),
        block(shown, 3, F.col("sec"), 0, 0, F.concat(F.lit("## "), F.col("name")), F.lit("")),
        block(demoted, 3, F.col("sec"), 1, F.col("n"), F.col("line")),
        block(shown.where(F.col("sec") < F.lit(last)), 3, F.col("sec"), 2, 0, F.lit(""), F.lit("---"), F.lit("")),
    ])


def items_of(results: DataFrame | None, articles: DataFrame) -> DataFrame:
    """n, title, url, source, cat, name, tier, text for the platform article: of results, else of articles with summaries, else of bare ones.

    Of one url the first stays. articles: see :func:`with_summaries`; without summaries the description is the text.
    """
    if results is not None and not results.isEmpty():
        rows = results.select("grp", "key", "title", "url", "source", "cat", "name", "tier", "text")
        first = rows.groupBy(F.col("url").alias("__u")).agg(F.min(F.struct("grp", "key")).alias("__m"))
        rows = rows.join(first, F.col("url").eqNullSafe(F.col("__u")) & (F.struct("grp", "key") == F.col("__m"))).drop("__u", "__m")
        return numbering.ordered(rows, ["grp", "key"]).drop("grp", "key")
    cat = normalize_category(F.col("category"))
    if "ai_summary" in articles.columns:
        first = articles.groupBy(F.col("url").alias("__u")).agg(F.min("pos").alias("__m"))
        articles = articles.join(first, F.col("url").eqNullSafe(F.col("__u")) & (F.col("pos") == F.col("__m")))
        tier = F.when(F.col("ai_tier") == "must_read", 1).when(F.col("ai_tier") == "brief", 3).otherwise(2)
        text = F.coalesce(F.nullif(F.col("ai_reason"), F.lit("")), F.col("ai_summary"), F.lit(""))
    else:
        tier, text = F.lit(2), _filled(F.col("description"))
    rows = articles.select("pos", "title", "url", "source", cat.alias("cat"), category_display(cat).alias("name"), tier.alias("tier"), text.alias("text"))
    return numbering.ordered(rows, ["pos"]).drop("pos")


def themes_of(items: DataFrame, most: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Themes (theme, title), their summaries (theme, k, text) and articles (theme, k, title, url, source), in order.

    A theme is a category: those with must-reads first, as they are first met; with more than ``most`` themes those of one article
    and without a summary become one at the end. Summaries lose their labels and repeat no text.
    """
    cats = items.groupBy("cat").agg(F.min(F.when(F.col("tier") == 1, F.col("n"))).alias("must"), F.min("n").alias("first"), F.first("name").alias("name"), F.count("*").alias("refs"), F.max(summary_text(_filled(F.col("text"))) != "").alias("texts"))
    order = Window.orderBy(F.col("must").isNull(), F.coalesce("must", "first"))  # one row a category
    cats = cats.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy()))
    small = (F.col("total") > most) & (F.col("refs") < 2) & ~F.col("texts")
    kept = cats.where(~small)
    named = kept.withColumn("theme", F.row_number().over(Window.orderBy("rank"))).select(F.col("cat").alias("__c"), "theme", strip_leading_emoji(F.coalesce(F.nullif("name", F.lit("")), "cat")).alias("title"))
    spare = cats.where(small).select(F.col("cat").alias("__c"), F.lit(kept.count() + 1).alias("theme"), F.lit(fixed.OTHER_THEME).alias("title"))
    both = named.union(spare)
    rows = items.join(both.select("__c", "theme", F.col("title").alias("theme_title")), F.col("cat").eqNullSafe(F.col("__c")))
    own = (F.col("tier") != 1).cast("long") * (1 << 60) + F.col("n")
    part = summary_text(_filled(F.col("text")))
    texts = rows.select("theme", own.alias("k"), part.alias("text")).where("text <> ''").groupBy("theme", "text").agg(F.min("k").alias("k")).select("theme", "k", "text")
    return both.select("theme", "title").distinct(), texts, rows.select("theme", own.alias("k"), "title", "url", "source")


def key_points(spark: SparkSession, points: DataFrame, h: Heading, sec: int) -> DataFrame:
    """points: n, line. None, no section."""
    if points.isEmpty():
        return spark.createDataFrame([], LINES)
    return joined([given(spark, sec, [f"## {h.words['key_points']}", ""]), block(points, sec, 0, 1, F.col("n"), F.concat(F.lit("- "), F.col("line"))), given(spark, sec, ["", "---", "", ""], tier=2)])


def theme_sections(themes: DataFrame, texts: DataFrame, refs: DataFrame, h: Heading, sec: int) -> DataFrame:
    """Numbered themes, each with its summary and its articles. texts: theme, k, text; refs: theme, k, title, url, source."""
    spark = themes.sparkSession
    last = themes.agg(F.max("theme")).collect()[0][0]
    if last is None:
        return spark.createDataFrame([], LINES)
    grp = F.col("theme")
    title = F.concat(F.lit("### "), grp.cast("string"), F.lit(". "), F.col("title"))
    with_refs = refs.select("theme").distinct()
    return joined([
        given(spark, sec, [f"## {h.words['in_depth']}", ""], grp=-1),
        block(themes, sec, grp, 0, 0, title, F.lit("")),
        block(texts, sec, grp, 1, F.col("k"), F.col("text"), F.lit("")),
        block(with_refs, sec, grp, 2, -1, F.lit(f"**{h.words['refs']}：**"), F.lit("")),
        block(refs, sec, grp, 2, F.col("k"), linked_line()),
        block(with_refs, sec, grp, 3, 0, F.lit("")),
        block(themes.where(F.col("theme") < F.lit(last)), sec, grp, 4, 0, F.lit("---"), F.lit("")),
        given(spark, sec, [""], grp=1 << 62),
    ])


def linked_line() -> Column:
    """- [title](url), and the source where there is one."""
    source = F.when(_filled(F.col("source")) != "", F.concat(F.lit(" — *"), F.col("source"), F.lit("*"))).otherwise("")
    return F.concat(F.lit("- ["), _filled(F.col("title")), F.lit("]("), _filled(F.col("url")), F.lit(")"), source)


def brief_section(articles: DataFrame, h: Heading, sec: int, most: int = 20) -> DataFrame:
    """The first articles and the number of the others (a top list)."""
    spark = articles.sparkSession
    n = articles.count()
    if not n:
        return spark.createDataFrame([], LINES)
    rows = block(articles.orderBy("pos").limit(most), sec, 0, 1, F.col("pos"), linked_line())
    tail = [*([h.words["more"].format(n=n - most)] if n > most else []), "", ""]
    return joined([given(spark, sec, [f"## {h.words['tech']}", ""]), rows, given(spark, sec, tail, tier=2)])


def platform_article(items: DataFrame, other: DataFrame, h: Heading, structure: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Heading, key points, themes, brief news, closing. structure: points, themes, texts and refs as a model gave them; else from items."""
    spark = items.sparkSession
    total = items.count() + other.count()
    title = f"{h.brand} {h.words['title']}"
    head = [f"# {title}", "", h.words["title_line"].format(date=h.date, n=total), "", "---", ""]
    if structure:
        points, themes, texts, refs = structure
    else:
        points = items.where("tier = 1").select("n", F.col("title").alias("line"))
        themes, texts, refs = themes_of(items)
    foot = ["---", "", h.words["closing"].format(title=title), ""]
    return joined([given(spark, 0, head), key_points(spark, points, h, 1), theme_sections(themes, texts, refs, h, 2), brief_section(other, h, 3), given(spark, 4, foot)])


def podcast_report(updates: DataFrame, summaries: DataFrame, h: Heading) -> DataFrame:
    """updates: also rank, podcast_url, full_text. summaries: key (a url or a title, unique), summary."""
    spark, words = updates.sparkSession, fixed.PODCAST_LABELS
    by_url, by_title = (summaries.select(F.col("key").alias(f"__{k}"), F.col("summary").alias(f"__by_{k}")) for k in ("url", "title"))
    rows = updates.join(by_url, F.col("url") == F.col("__url"), "left").join(by_title, F.col("title") == F.col("__title"), "left")
    rows = numbering.within(rows.withColumn("__all", F.lit(0)), ["__all"])
    notes = F.coalesce(F.nullif(F.col("full_text"), F.lit("")), F.nullif(F.col("description"), F.lit("")), F.lit(words[3]))
    text = F.coalesce(F.nullif(F.col("__by_url"), F.lit("")), F.nullif(F.col("__by_title"), F.lit("")), truncate(F.substring(notes, 1, 500), 150))
    url = F.substring_index(_filled(F.col("url")), "?utm_source=", 1)
    home = F.substring_index(F.coalesce(F.nullif(F.col("podcast_url"), F.lit("")), url), "?utm_source=", 1)
    title = _piped(F.concat(F.lit("[**"), _filled(F.col("title")), F.lit("**]("), url, F.lit(")")))
    show = _piped(F.concat(F.lit("["), _filled(F.col("source")), F.lit("]("), home, F.lit(")")))
    rank = F.when(F.coalesce("rank", F.lit(0)) > 0, F.concat(F.lit("#"), F.col("rank").cast("string"))).otherwise("-")
    head = [f"# {words[0]} — {h.date} {h.time}", "", words[1].format(checked=h.checked, hours=h.hours, n=updates.count()), "", "---", "", words[2], "|---:|------|------|------|------|"]
    return joined([given(spark, 0, head), block(rows, 1, 0, 0, F.col("pos"), _row(F.col("number"), title, show, rank, _cell(text))), given(spark, 2, [""])])


def account_report(updates: DataFrame, summaries: DataFrame, h: Heading) -> DataFrame:
    """Accounts' articles by category (the known ones first), numbered through. summaries: url (unique), summary."""
    spark, words = updates.sparkSession, fixed.ACCOUNT_LABELS
    # only what a line shows is numbered and joined, not the whole texts
    shown = updates.select("pos", "title", "url", "source", "category", truncate(_filled(F.col("description")), 150).alias("description"))
    rows = numbering.by_category(shown, list(fixed.ACCOUNT_CATEGORIES)).join(summaries.select(F.col("url").alias("__url"), "summary"), F.col("url") == F.col("__url"), "left")
    place = F.array_position(F.array(*map(F.lit, fixed.ACCOUNT_CATEGORIES)), F.col("category")).cast("long")
    heads = updates.groupBy("category").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("met"))
    grp = lambda d: F.when(F.coalesce(place, F.lit(0)) > 0, place - (1 << 62)).otherwise(d["met"])
    rows = rows.join(heads.select(F.col("category").alias("__c"), "met"), F.col("category").eqNullSafe(F.col("__c")))
    title = _piped(F.concat(F.lit("[**"), _filled(F.col("title")), F.lit("**]("), _filled(F.col("url")), F.lit(")")))
    text = F.when(_filled(F.col("summary")) != "", F.col("summary")).otherwise(F.col("description"))
    line = _row(F.col("number"), title, _piped(F.concat(F.lit("*"), _filled(F.col("source")), F.lit("*"))), _cell(text))
    name = F.concat(F.lit("## "), category_display(F.col("category")), F.lit(" ("), F.col("n").cast("string"), F.lit(f" {fixed.BRIEF_UNIT})"))
    head = [f"# {words[0]} — {h.date} {h.time}", "", words[1].format(checked=h.checked, hours=h.hours, n=updates.count()), "", "---", ""]
    return joined([
        given(spark, 0, head), block(heads, 1, grp(heads), 0, 0, name, F.lit(""), F.lit(words[2]), F.lit("|---:|------|--------|------|")),
        block(rows, 1, grp(rows), 1, F.col("pos"), line), block(heads, 1, grp(heads), 2, 0, F.lit("")), given(spark, 2, [words[3].format(time=f"{h.date} {h.time}")]),
    ])
