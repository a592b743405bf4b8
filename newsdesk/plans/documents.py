"""Queries of whole reports over whole tables, and their oracles as blocks of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import documents, numbering
from ..operators.documents import ORDER, Heading
from .inputs import TEXT_ARTICLES, text_articles

CYCLE = ("ai_ml", "cloud", "AI/ML", "hacker_news", "unlisted", "安全")
GIVEN = ("", "cloud", "AI/ML", "Robotics")
ZH, EN = Heading("zh", "2026-04-06", "05:30", 12, 25, "Desk"), Heading("en", "2026-04-06", "05:30", 12, 25, "Desk")


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def news(spark, sf):
    """Documents as scored articles of several categories, some with points."""
    p = F.col("pos")
    return text_articles(spark, sf).select(
        "pos", "title", "url", "source", "description", _pick(CYCLE, p).alias("category"), F.when(p % 3 == 0, (p % 500).cast("int")).alias("hn_points"), F.when(p % 2 == 0, (p % 70).cast("int")).alias("hn_comments"),
        F.when(p % 25 == 0, "must_read").when(p % 5 == 1, "brief").when(p % 5 == 2, "noteworthy").alias("editorial_tier"), ((p % 97) / 100).alias("news_value_score"), (p % 7 == 0).alias("cross_source"),
        (p % 9 + 1).cast("int").alias("cluster_size"), (p % 4 + 1).cast("int").alias("priority"),
    )


def summaries(articles):
    """Summaries of every fourth article."""
    p = F.col("pos")
    s = articles.where(p % 4 == 0)
    return s.select("url", F.when(p % 8 == 0, F.concat(F.lit("Sum | "), p.cast("string"))).otherwise("").alias("ai_summary"), _pick(GIVEN, F.floor(p / 4)).alias("category"), _pick(("must_read", "brief", "noteworthy"), p).alias("tier"), F.when(p % 12 == 0, F.concat(F.lit("Why "), p.cast("string"))).alias("importance_reason"))


def _summed(spark, sf):
    a = news(spark, sf)
    return documents.with_summaries(a, summaries(a))


def rpt02_points_section(spark, sf):
    return documents.points_section(_summed(spark, sf), EN, 0)


def rpt05_tech_report(spark, sf):
    return documents.tech_report(_summed(spark, sf), EN, "An insight")


def rpt04_tiered_sections(spark, sf):
    return documents.tiered_sections(documents.results_from_summaries(_summed(spark, sf)), ZH, 0)


def rpt05_tiered_report(spark, sf):
    return documents.tiered_report(documents.results_from_scores(news(spark, sf)), EN, "In short")


def rpt06_other_news(spark, sf):
    return documents.other_news(news(spark, sf), ZH)


def rpt14_listing(spark, sf):
    return documents.listing(_summed(spark, sf), EN)


def _numbered(document):
    return numbering.ordered(document, ORDER).select("n", "line")


def rpt07_merged(spark, sf):
    """A listing and part two in one document."""
    a = _summed(spark, sf)
    return _numbered(documents.merged([documents.listing(a.where("pos % 2 = 0"), EN), documents.tech_report(a.where("pos % 2 = 1"), EN)], EN))


def rpt08_unified(spark, sf):
    a = _summed(spark, sf)
    return _numbered(documents.unified(a.where("pos % 2 = 0"), a.where("pos % 2 = 1"), EN, False))


def rpt09_platform_article(spark, sf):
    a = _summed(spark, sf)
    items = documents.items_of(documents.results_from_summaries(a.where("pos % 2 = 0")), a)
    return _numbered(documents.platform_article(items, a.where("pos % 2 = 1"), EN))


def rpt10_items(spark, sf):
    """Without results: by the summaries themselves."""
    return documents.items_of(None, _summed(spark, sf)).select("n", "url", "cat", "name", "tier", "text")


def rpt12_podcast_report(spark, sf):
    a = news(spark, sf)
    u = a.withColumn("rank", (F.col("pos") % 3).cast("int")).withColumn("podcast_url", F.when(F.col("pos") % 2 == 0, F.concat("url", F.lit("/show?utm_source=x")))).withColumn("full_text", F.when(F.col("pos") % 2 == 1, F.lit("")))
    return documents.podcast_report(u, a.where("pos % 5 = 0").select(F.col("url").alias("key"), F.lit("Heard\nit").alias("summary")), ZH)


def rpt13_account_report(spark, sf):
    a = news(spark, sf).withColumn("category", _pick(("wechat_dev", "z", "wechat_security", "b"), F.col("pos")))
    return documents.account_report(a, a.where("pos % 5 = 0").select("url", F.lit("Read|it").alias("summary")), ZH)


QUERIES = [
    rpt02_points_section, rpt05_tech_report, rpt04_tiered_sections, rpt05_tiered_report, rpt06_other_news, rpt14_listing, rpt07_merged, rpt08_unified, rpt09_platform_article, rpt10_items, rpt12_podcast_report, rpt13_account_report,
]


# --- oracles ---


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _blk(src: str, sec, grp, tier, pos, *lines: str) -> str:
    return f"""SELECT {sec}::INTEGER AS sec, ({grp})::BIGINT AS grp, ({tier})::INTEGER AS tier, ({pos})::BIGINT AS pos, unnest(range(len(l)))::INTEGER AS sub, unnest(l) AS line
        FROM (SELECT *, list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL) AS l FROM {src})"""


def _given(sec, lines, grp=0, tier=0, where="true") -> str:
    return _blk(f"(SELECT 1 AS one WHERE {where})", sec, grp, tier, 0, *[x if x.startswith("(") else _q(x) for x in lines])


def _cell(x: str) -> str:
    return f"replace(replace(coalesce({x}, ''), '|', '\\|'), chr(10), ' ')"


def _piped(x: str) -> str:
    return f"replace(coalesce({x}, ''), '|', '\\|')"


_TITLE = f"'[**' || {_cell('title')} || '**](' || {_cell('url')} || ')'"
_SRC = f"'*' || {_cell('source')} || '*'"


def _row(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"


def _table_row(text: str) -> str:
    return f"CASE WHEN coalesce({text}, '') <> '' THEN {_row('i', _TITLE, _SRC, _cell(text))} ELSE {_row('i', _TITLE, _SRC)} END"


_PLAIN = "regexp_replace(trim(coalesce(description, ''), ' ' || chr(9) || chr(13) || chr(10)), '<[^>]+>', '', 'g')"
_SHORT = f"CASE WHEN length({_PLAIN}) > 150 THEN substring({_PLAIN}, 1, 150) || '...' ELSE {_PLAIN} END"
_OLD, _CATS = fixed.OLD_CATEGORIES, fixed.CATEGORIES


def _normal(c: str) -> str:
    return f"coalesce({_list(_OLD.values())}[list_position({_list(_OLD)}, {c})], {c})"


def _display(c: str) -> str:
    return f"coalesce({_list(d for _, _, d in _CATS)}[list_position({_list(k for k, _, _ in _CATS)}, {c})], {c})"


def _place(c: str) -> str:
    return f"coalesce(list_position({_list(k for k, _, _ in _CATS)}, {c}), 99)"


NEWS = f"""{TEXT_ARTICLES}, news AS (
    SELECT pos, title, url, source, description, {_list(CYCLE)}[pos % 6 + 1] AS category, CASE WHEN pos % 3 = 0 THEN pos % 500 END AS hn_points, CASE WHEN pos % 2 = 0 THEN pos % 70 END AS hn_comments,
        CASE WHEN pos % 25 = 0 THEN 'must_read' WHEN pos % 5 = 1 THEN 'brief' WHEN pos % 5 = 2 THEN 'noteworthy' END AS editorial_tier, (pos % 97) / 100.0::DOUBLE AS score, pos % 7 = 0 AS cross_source, pos % 9 + 1 AS cluster_size, pos % 4 + 1 AS priority FROM text_articles
), summed AS (
    SELECT *, CASE WHEN pos % 8 = 0 THEN 'Sum | ' || pos WHEN pos % 4 = 0 THEN '' END AS ai_summary, CASE WHEN pos % 4 = 0 THEN {_list(GIVEN)}[(pos // 4) % 4 + 1] END AS ai_category,
        CASE WHEN pos % 4 = 0 THEN ['must_read', 'brief', 'noteworthy'][pos % 3 + 1] END AS ai_tier, CASE WHEN pos % 12 = 0 THEN 'Why ' || pos END AS ai_reason, {_normal('category')} AS own FROM news
)"""
_STATS = "concat_ws(' · ', '🔥 ' || hn_points, '💬 ' || hn_comments)"


def _points(src: str, w: dict, sec: int, texts: bool) -> list[str]:
    """Blocks of the table of points; texts: whether any item has a summary."""
    head = [f"('## {w['points_table']} (' || (SELECT count(*) FROM {src}) || ' {w['count']})')", "", f"| # | {w['article']} | {w['stats']} |" + (f" {w['summary']} |" if texts else ""), "|---:|------|------|------|" if texts else "|---:|------|------|"]
    some = f"(SELECT count(*) FROM {src}) > 0"
    cells = ["i", _TITLE, _cell(_STATS), *([_cell("ai_summary")] if texts else [])]
    return [_given(sec, head, where=some), _blk(f"(SELECT *, row_number() OVER (ORDER BY pos) AS i FROM {src})", sec, 0, 1, "pos", _row(*cells)), _given(sec, [""], tier=2, where=some)]


def _tables(src: str, w: dict, sec: int) -> list[str]:
    """src: cat, text."""
    base = f"(SELECT *, CASE WHEN {_place('cat')} < 99 THEN cat ELSE '{fixed.OTHER_CATEGORY}' END AS c, {_place('cat')} AS g FROM {src})"
    heads = f"(SELECT c, g, count(*) AS n, bool_or(text <> '') AS texts FROM {base} GROUP BY c, g)"
    header = f"'| # | {w['article']} | {w['source']} |' || CASE WHEN texts THEN ' {w['summary']} |' ELSE '' END"
    rule = "CASE WHEN texts THEN '|---:|------|------|------|' ELSE '|---:|------|------|' END"
    return [
        _blk(heads, sec, "g", 0, 0, f"'## ' || {_display('c')} || ' (' || n || ' {w['count']})'", "''", header, rule),
        _blk(f"(SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS i FROM {base})", sec, "g", 1, "pos", _table_row("text")),
        _blk(heads, sec, "g", 2, 0, "''"),
    ]


def _all(ctes: str, blocks: list[str]) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(blocks)


_E, _Z = fixed.LABELS["en"], fixed.LABELS["zh"]
_TECH_SRC = f"""(SELECT *, CASE WHEN coalesce(ai_category, '') <> '' THEN {_normal('ai_category')} ELSE own END AS cat, CASE WHEN coalesce(ai_summary, '') <> '' THEN ai_summary ELSE {_SHORT} END AS text FROM {{src}} WHERE own IS DISTINCT FROM 'hacker_news')"""


def _tech(src: str, w: dict, insight: str, texts: bool) -> list[str]:
    head = [f"# {w['daily']} — 2026-04-06", "", "('> " + w["checked"].format(checked=12, hours=25, n=f"' || (SELECT count(*) FROM {src}) || '") + "')", "", "---", "", *([f"## {w['insight']}", "", insight, "", "---", ""] if insight else [])]
    return [_given(0, head), *_tables(_TECH_SRC.format(src=src), w, 1), *_points(f"(SELECT * FROM {src} WHERE own = 'hacker_news')", w, 2, texts), _given(3, [f"*{w['footer']}: 2026-04-06 05:30 UTC*"])]


# results: cat, name, grp, key, tier, text
_BY_SUMMARY = f"""results AS (SELECT *, min(pos) OVER (PARTITION BY cat) AS grp, {_display('cat')} AS name FROM (
    SELECT pos, title, url, source, CASE WHEN coalesce(ai_category, '') <> '' THEN {_normal('ai_category')} ELSE own END AS cat, pos AS key, CASE ai_tier WHEN 'must_read' THEN 1 WHEN 'brief' THEN 3 ELSE 2 END AS tier,
        CASE WHEN ai_tier = 'brief' THEN '' ELSE coalesce(nullif(ai_reason, ''), ai_summary, '') END AS text FROM {{src}}))"""
_REASON = """CASE WHEN cluster_size >= 3 OR cross_source OR priority = 1 OR hn_points >= 100 THEN concat_ws('，', CASE WHEN cluster_size >= 3 THEN cluster_size || '篇相关报道' END, CASE WHEN cross_source THEN '多源验证' END,
    CASE WHEN priority = 1 THEN '权威来源' END, CASE WHEN hn_points >= 100 THEN 'HN ' || hn_points || '赞' END) WHEN score >= 0.6::DOUBLE THEN '高新闻价值' WHEN description <> '' THEN substring(description, 1, 80) ELSE '值得关注' END"""
_BY_SCORE = f"""results AS (SELECT *, min(pos) OVER (PARTITION BY cat) AS grp, {_display('cat')} AS name FROM (
    SELECT pos, title, url, source, {_normal('category')} AS cat, (1000 - (pos % 97) * 10) * 4398046511104 + pos AS key, CASE editorial_tier WHEN 'must_read' THEN 1 WHEN 'brief' THEN 3 ELSE 2 END AS tier,
        CASE WHEN editorial_tier = 'brief' THEN '' ELSE {_REASON} END AS text FROM news))"""


def _tiers(w: dict, sec: int, rules: bool) -> list[str]:
    heads = "(SELECT grp, name, count(*) AS n, count(*) FILTER (tier = 1) AS n1, count(*) FILTER (tier = 2) AS n2, count(*) FILTER (tier = 3) AS n3 FROM results GROUP BY grp, name)"
    rows = "(SELECT *, row_number() OVER (PARTITION BY grp, tier ORDER BY key) AS i FROM results)"
    some = lambda t: f"(SELECT * FROM {heads} WHERE n{t} > 0)"
    of = lambda t: f"(SELECT * FROM {rows} WHERE tier = {t})"
    linked = f"'**' || i || '. [' || {_cell('title')} || '](' || {_piped('url')} || ')**'"
    said = f"'> **{w['source']}**: *' || {_piped('source')} || '*' || CASE WHEN text <> '' THEN ' | **{w['why']}**: ' || text ELSE '' END"
    return [
        _blk(heads, sec, "grp", 0, 0, f"'## ' || name || ' (' || n || ' {w['articles']})'", "''"),
        _blk(some(1), sec, "grp", 1, -1, _q(f"### {w['must']}"), "''"),
        _blk(of(1), sec, "grp", 1, "key", linked, "''", said, "''"),
        _blk(some(2), sec, "grp", 2, -1, _q(f"### {w['note']}"), "''", _q(f"| # | {w['article']} | {w['source']} | {w['point']} |"), "'|---|---------|--------|-----------|'"),
        _blk(of(2), sec, "grp", 2, "key", _row("i", _TITLE, _SRC, _cell("text"))),
        _blk(some(2), sec, "grp", 3, -2, "''"),
        _blk(some(3), sec, "grp", 3, -1, "'<details>'", f"'<summary>📋 {w['brief']} (' || n3 || ' {w['articles']})</summary>'", "''", _q(f"| # | {w['article']} | {w['source']} |"), "'|---|---------|--------|'"),
        _blk(of(3), sec, "grp", 3, "key", _row("i", _TITLE, _SRC)),
        _blk(some(3), sec, "grp", 4, 0, "''", "'</details>'", "''"),
        *([_blk(heads, sec, "grp", 5, 0, "'---'", "''")] if rules else []),
    ]


def _tiered_report(w: dict, executive: str) -> list[str]:
    n, g = "(SELECT count(*) FROM results)", "(SELECT count(DISTINCT grp) FROM results)"
    made = f"('> 📰 ' || {n} || ' " + w["ai_made"].format(n=f"' || {g} || '") + "')"
    top = "(SELECT * FROM results WHERE tier = 1 ORDER BY grp, key LIMIT 5)"
    linked = f"'### ⭐ [' || {_cell('title')} || '](' || {_piped('url')} || ')'"
    said = _q(f"> **{w['source']}**: *") + f" || {_piped('source')} || " + _q(f"* | **{w['why']}**: ") + " || text"
    some = "(SELECT count(*) FROM results WHERE tier = 1) > 0"
    return [
        _given(0, [f"# {w['daily']} — 2026-04-06", "", made, "", "---", "", f"## {w['executive']}", "", executive, "", "---", ""]),
        _given(1, [f"## {w['highlights']}", ""], grp=-1, where=some), _blk(top, 1, "grp", 1, "key", linked, "''", said, "''"), _given(1, ["---", ""], grp=1 << 62, where=some),
        *_tiers(w, 2, True), _given(3, [f"*{w['tiered_footer']}: 2026-04-06 05:30 UTC*"]),
    ]


def _other(src: str, w: dict, sec: int) -> list[str]:
    top = f"(SELECT * FROM {src} WHERE coalesce(editorial_tier = 'must_read', false) AND own IS DISTINCT FROM 'hacker_news')"
    line = f"'- **[' || {_cell('title')} || '](' || {_cell('url')} || ')** — ' || coalesce(source, '') || CASE WHEN cross_source THEN {_q(w['verified'])} ELSE '' END"
    rest = f"(SELECT *, own AS cat, {_SHORT} AS text FROM {src} WHERE own NOT IN ('hacker_news', 'ai_ml', 'ai_tools') AND editorial_tier IS DISTINCT FROM 'must_read')"
    return [
        _given(sec, ["('" + w["part2"].format(n=f"' || (SELECT count(*) FROM {src}) || '") + "')", ""]),
        _given(sec + 1, [w["top_news"], ""], where=f"(SELECT count(*) FROM {top}) > 0"), _blk(top, sec + 1, 0, 1, "pos", line, f"'  > ' || nullif(substring({_PLAIN}, 1, 150), '')", "''"),
        *_tables(rest, w, sec + 2), *_points(f"(SELECT * FROM {src} WHERE own = 'hacker_news')", w, sec + 3, False),
    ]


def _listing(src: str, w: dict) -> list[str]:
    title = f"'[**' || {_cell('title')} || '**](' || {_piped('url')} || ')'"
    cells = _row("i", title, f"'*' || {_piped('source')} || '*'", _piped("category"), _cell("ai_summary"))
    head = ["('" + w["part1"].format(n=f"' || (SELECT count(*) FROM {src}) || '") + "')", "", w["listing"], "", f"| # | {w['article']} | {w['source']} | {w['category']} | {w['summary']} |", "|---:|------|------|------|------|"]
    return [_given(0, head), _blk(f"(SELECT *, row_number() OVER (ORDER BY pos) AS i FROM {src})", 0, 0, 1, "pos", cells), _given(0, [""], tier=2)]


def _doc(name: str, blocks: list[str]) -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY sec, grp, tier, pos, sub) AS n, line FROM ({' UNION ALL '.join(blocks)}))"


_EVEN, _ODD = "(SELECT * FROM summed WHERE pos % 2 = 0)", "(SELECT * FROM summed WHERE pos % 2 = 1)"


def _unified() -> str:
    n = [f"(SELECT count(*) FROM {x})" for x in (_EVEN, _ODD, "summed")]
    head = ["# 📰 Desk — 2026-04-06", "", "('" + _E["unified"].format(ai=f"' || {n[0]} || '", other=f"' || {n[1]} || '", n=f"' || {n[2]} || '") + "')", "", _E["unified_time"].format(time="05:30"), "", "---", ""]
    first, second = _doc("a", _listing(_EVEN, _E)), _doc("b", _other(_ODD, _E, 0))
    parts = [_given(0, head), "SELECT 1, 0, 0, n, 0, line FROM a", _given(2, ["", "---", ""]), "SELECT 3, 0, 0, n, 0, line FROM b"]
    return f"WITH {NEWS}, {first}, {second}, {_doc('u', parts)} SELECT n, line FROM u"


def _merged() -> str:
    """The two documents have a head of six and of six lines (the second ends with its footer) before their bodies."""
    first, second = _doc("a", _listing(_EVEN, _E)), _doc("b", _tech(_ODD, _E, "", False))
    names = ["('' || (SELECT ltrim(line, '# ') FROM a WHERE n = 1))", "('' || (SELECT ltrim(line, '# ') FROM b WHERE n = 1))"]
    both = f"('> 📡 ' || {names[0][7:-1]} || ' · ' || {names[1][7:-1]})"
    anchor = lambda x: f"lower(regexp_replace(regexp_replace(regexp_replace({x}, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', '-', 'g'))"
    entry = lambda x: f"('- [' || {x} || '](#' || {anchor(x)} || ')')"
    head = ["# 📰 Desk — 2026-04-06", "", both, "", _E["time"].format(time="05:30"), "", "---", "", _E["contents"], "", entry(names[0][7:-1]), entry(names[1][7:-1]), "", "---", ""]
    # the listing has no rule: its body begins after the title and ends before the blank line; the report's lies between its rule and its footer
    deeper = "CASE WHEN regexp_matches(line, '^#{1,6} ') THEN repeat('#', least(length(regexp_extract(line, '^(#+) ', 1)) + 3, 6)) || regexp_replace(line, '^#+', '') ELSE line END"
    heading = lambda x: f"('## ' || {x})"
    parts = [
        _given(0, head), _given(1, [heading(names[0][7:-1]), ""]), f"SELECT 2, 0, 0, n, 0, {deeper} FROM a WHERE n > 2 AND n < (SELECT max(n) FROM a)", _given(3, ["", "---", ""]),
        _given(4, [heading(names[1][7:-1]), ""]), f"SELECT 5, 0, 0, n, 0, {deeper} FROM b WHERE n > 6 AND n < (SELECT max(n) - 1 FROM b)",
    ]
    return f"WITH {NEWS}, {first}, {second}, {_doc('m', parts)} SELECT n, line FROM m"


def _linked() -> str:
    return "'- [' || coalesce(title, '') || '](' || coalesce(url, '') || ')' || CASE WHEN coalesce(source, '') <> '' THEN ' — *' || source || '*' ELSE '' END"


def _article() -> str:
    w = _E
    results = _BY_SUMMARY.format(src=_EVEN)
    total, odd = "(SELECT count(*) FROM summed)", f"(SELECT count(*) FROM {_ODD})"
    items = """items AS (SELECT row_number() OVER (ORDER BY grp, key) AS n, * FROM results), parts AS (SELECT cat, (CASE WHEN tier = 1 THEN 0 ELSE 1::BIGINT << 60 END) + n AS k, trim(text) AS text FROM items),
        cats AS (SELECT cat, min(n) FILTER (tier = 1) AS must, min(n) AS first, any_value(name) AS name, count(*) AS refs, bool_or(trim(text) <> '') AS texts FROM items GROUP BY cat),
        ranked AS (SELECT *, (count(*) OVER ()) > 6 AND refs < 2 AND NOT texts AS small FROM cats), kept AS (SELECT cat, row_number() OVER (ORDER BY must IS NULL, coalesce(must, first)) AS theme, regexp_replace(name, '^[\\x{1F300}-\\x{10FFFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\s]+', '') AS title FROM ranked WHERE NOT small),
        themes AS (SELECT * FROM kept UNION ALL SELECT cat, (SELECT count(*) + 1 FROM kept), '其他 AI 动态' FROM ranked WHERE small), ends AS (SELECT max(theme) AS last FROM themes)"""
    names = "(SELECT DISTINCT theme, title, last FROM themes, ends)"
    texts = "(SELECT theme, text, min(k) AS k FROM parts JOIN themes USING (cat) WHERE text <> '' GROUP BY theme, text)"
    refs = "(SELECT theme, CASE WHEN tier = 1 THEN 0 ELSE 1::BIGINT << 60 END + n AS k, items.title, url, source FROM items JOIN themes USING (cat))"
    blocks = [
        _given(0, ["# Desk AI Technology Daily", "", "('" + w["title_line"].format(date="2026-04-06", n=f"' || {total} || '") + "')", "", "---", ""]),
        _given(1, ["## Highlights", ""]), _blk("(SELECT * FROM items WHERE tier = 1)", 1, 0, 1, "n", "'- ' || title"), _given(1, ["", "---", "", ""], tier=2),
        _given(2, ["## In Depth", ""], grp=-1), _blk(names, 2, "theme", 0, 0, "'### ' || theme || '. ' || title", "''"), _blk(texts, 2, "theme", 1, "k", "text", "''"),
        _blk("(SELECT DISTINCT theme FROM themes)", 2, "theme", 2, -1, "'**Refs：**'", "''"), _blk(refs, 2, "theme", 2, "k", _linked()), _blk("(SELECT DISTINCT theme FROM themes)", 2, "theme", 3, 0, "''"),
        _blk(f"(SELECT * FROM {names} WHERE theme < last)", 2, "theme", 4, 0, "'---'", "''"), _given(2, [""], grp=1 << 62),
        _given(3, ["## Tech Updates", ""]), _blk(f"(SELECT * FROM {_ODD} ORDER BY pos LIMIT 20)", 3, 0, 1, "pos", _linked()),
        _given(3, [f"('- ……等 ' || ({odd} - 20) || ' 条')", "", ""], tier=2), _given(4, ["---", "", "*Desk AI Technology Daily · AI generated · Daily updates*", ""]),
    ]
    return f"WITH {NEWS}, {results}, {items}, {_doc('d', blocks)} SELECT n, line FROM d"


def _podcast() -> str:
    text = "CASE WHEN pos % 5 = 0 THEN 'Heard' || chr(10) || 'it' WHEN length(substring(notes, 1, 500)) > 150 THEN substring(notes, 1, 150) || '...' ELSE notes END"
    src = f"(SELECT *, {text} AS text, row_number() OVER (ORDER BY pos) AS i, CASE WHEN pos % 2 = 0 THEN url || '/show' ELSE url END AS home FROM (SELECT *, coalesce(nullif(description, ''), '内容暂无') AS notes FROM news))"
    line = _row("i", _piped("'[**' || title || '**](' || url || ')'"), _piped("'[' || source || '](' || home || ')'"), "CASE WHEN pos % 3 > 0 THEN '#' || pos % 3 ELSE '-' END", _cell("text"))
    head = ["# 播客更新汇总 — 2026-04-06 05:30", "", "('> 🎙️ 共检查 12 个播客 · 25h 窗口 · 发现 ' || (SELECT count(*) FROM news) || ' 个更新')", "", "---", "", "| # | 节目 | 播客 | 排名 | 摘要 |", "|---:|------|------|------|------|"]
    return _all(NEWS, [_given(0, head), _blk(src, 1, 0, 0, "pos", line), _given(2, [""])])


def _accounts() -> str:
    base = "(SELECT *, ['wechat_dev', 'z', 'wechat_security', 'b'][pos % 4 + 1] AS c FROM news)"
    placed = f"(SELECT *, min(pos) OVER (PARTITION BY c) AS met, CASE c WHEN 'wechat_security' THEN 1 - (1::BIGINT << 62) WHEN 'wechat_dev' THEN 2 - (1::BIGINT << 62) ELSE min(pos) OVER (PARTITION BY c) END AS g FROM {base})"
    heads = f"(SELECT c, g, count(*) AS n FROM {placed} GROUP BY c, g)"
    text = "CASE WHEN pos % 5 = 0 THEN 'Read|it' WHEN length(description) > 150 THEN substring(description, 1, 150) || '...' ELSE description END"
    line = _row("i", _piped("'[**' || title || '**](' || url || ')'"), _piped("'*' || source || '*'"), _cell(text))
    head = ["# 微信公众号更新汇总 — 2026-04-06 05:30", "", "('> 📱 共检查 12 个公众号 · 25h 窗口 · 发现 ' || (SELECT count(*) FROM news) || ' 条更新')", "", "---", ""]
    return _all(NEWS, [
        _given(0, head), _blk(heads, 1, "g", 0, 0, f"'## ' || {_display('c')} || ' (' || n || ' 条)'", "''", "'| # | 文章 | 公众号 | 摘要 |'", "'|---:|------|--------|------|'"),
        _blk(f"(SELECT *, row_number() OVER (ORDER BY g, pos) AS i FROM {placed})", 1, "g", 1, "pos", line), _blk(heads, 1, "g", 2, 0, "''"), _given(2, ["*报告生成时间: 2026-04-06 05:30 UTC*"]),
    ])


ORACLES = {
    "rpt02_points_section": _all(NEWS, _points("summed", _E, 0, True)),
    "rpt05_tech_report": _all(NEWS, _tech("summed", _E, "An insight", False)),
    "rpt04_tiered_sections": _all(f"{NEWS}, {_BY_SUMMARY.format(src='summed')}", _tiers(_Z, 0, False)),
    "rpt05_tiered_report": _all(f"{NEWS}, {_BY_SCORE}", _tiered_report(_E, "In short")),
    "rpt06_other_news": _all(f"{NEWS}", _other("summed", _Z, 0)),
    "rpt14_listing": _all(NEWS, _listing("summed", _E)),
    "rpt07_merged": _merged(),
    "rpt08_unified": _unified(),
    "rpt09_platform_article": _article(),
    "rpt10_items": f"WITH {NEWS} SELECT row_number() OVER (ORDER BY pos) AS n, url, own AS cat, {_display('own')} AS name, CASE ai_tier WHEN 'must_read' THEN 1 WHEN 'brief' THEN 3 ELSE 2 END AS tier, coalesce(nullif(ai_reason, ''), ai_summary, '') AS text FROM summed",
    "rpt12_podcast_report": _podcast(),
    "rpt13_account_report": _accounts(),
}
