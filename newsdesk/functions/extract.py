"""What pages and report sections hold: episodes, article bodies, section bodies, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import contains_any, normalize_category, normalize_title, strip_html

_EPISODES = "props struct<pageProps struct<podcast struct<episodes array<struct<title string, eid string>>>>>"
_BLANK = " \t\r\n"


def episodes(html: Column) -> Column:
    """array<struct<title, eid>> of the JSON that a podcast's page embeds; empty where there is none or it can't be read."""
    raw = F.regexp_extract(html, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    listed = F.filter(F.from_json(raw, _EPISODES)["props"]["pageProps"]["podcast"]["episodes"], lambda e: (e["title"] != "") & (e["eid"] != ""))
    trimmed = F.transform(listed, lambda e: F.struct(F.trim(e["title"]).alias("title"), F.trim(e["eid"]).alias("eid")))
    return F.coalesce(trimmed, F.array().cast("array<struct<title:string,eid:string>>"))


def match_episode(title: Column, listed: Column) -> Column:
    """eid of the first episode with the title, else of the first whose title holds it or is held by it; null if none."""
    wanted = normalize_title(title)
    named = F.transform(listed, lambda e: F.struct(normalize_title(e["title"]).alias("t"), e["eid"].alias("eid")))
    same = F.get(F.filter(named, lambda e: e["t"] == wanted), 0)
    part = F.get(F.filter(named, lambda e: e["t"].contains(wanted) | wanted.contains(e["t"])), 0)
    return F.coalesce(same["eid"], part["eid"])


def account_body(html: Column, unfinished: bool = True) -> Column:
    """Text between an account page's body mark and the first end mark, if over 100 characters; else null. unfinished: as in :func:`.text.plain_text`."""
    at = lambda mark, start: F.call_function("locate", F.lit(mark), html, start)

    def after(mark: str) -> Column:
        found = F.instr(html, mark)
        start = at(">", found) + 1
        ends = [F.when(at(e, start) > start, at(e, start)) for e in fixed.BODY_ENDS]
        end = F.coalesce(F.least(*ends), F.length(html) + 1)
        return F.when((found > 0) & (start > 1), F.substring(html, start, end - start))

    text = strip_html(F.coalesce(*map(after, fixed.BODY_MARKS)), unfinished)
    return F.when(F.length(text) > 100, text)


def episode_url(eid: Column, url: Column) -> Column:
    """The episode's page where one was found, else the url; without its tracking suffix if it is an episode's page."""
    found = F.coalesce(F.concat(F.lit(fixed.EPISODE_URL), eid), url)
    return F.when(found.contains(fixed.EPISODE_PATH), F.substring_index(found, "?utm_source=", 1)).otherwise(found)


def section_body(text: Column) -> Column:
    """A report section without what precedes its first rule (else its title, blank and quoted lines) and without its footer lines."""
    lines = F.split(text, "\n")
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.trim(x, F.lit(_BLANK)).alias("t")))
    rule = F.array_position(F.transform(placed, lambda p: p["t"]), F.lit("---"))
    body = lambda p: ~(p["x"].startswith("# ") | (p["t"] == "") | p["x"].startswith(">"))
    head = F.array_min(F.transform(F.filter(placed, body), lambda p: p["i"]))
    start = F.when(rule > 0, rule.cast("int")).otherwise(F.coalesce(head, F.size(lines)))
    footer = lambda p: (p["t"] == "") | (p["t"] == "---") | p["x"].contains(fixed.FOOTER_WORDS[0]) | p["x"].contains(fixed.FOOTER_WORDS[1]) | (p["t"].startswith("*") & p["x"].contains("UTC"))
    last = F.array_max(F.transform(F.filter(placed, lambda p: (p["i"] >= start) & ~footer(p)), lambda p: p["i"]))
    return F.when(last.isNull(), F.lit("")).otherwise(F.trim(F.array_join(F.slice(lines, start + 1, last - start + 1), "\n"), F.lit(_BLANK)))


def summary_text(text: Column) -> Column:
    """A summary without its label."""
    for label in fixed.SUMMARY_LABELS:
        text = F.regexp_replace(F.trim(text, F.lit(_BLANK)), label, "")
    return F.trim(text, F.lit(_BLANK))


def composed(texts: Column) -> Column:
    """An array of summaries as one text: without labels, each once, in order, a blank line between them."""
    return F.array_join(F.array_distinct(F.filter(F.transform(texts, lambda t: summary_text(F.coalesce(t, F.lit("")))), lambda t: t != "")), "\n\n")


def is_ai_category(summary_category: Column, category: Column) -> Column:
    """By the summary's category (its id, or a keyword of ten characters at most within it); without one by the article's."""
    direct = lambda c: normalize_category(c).isin(*fixed.DIRECT_CATEGORIES)
    short = sorted({k.lower() for k in fixed.AI_KEYWORDS_ZH + fixed.AI_KEYWORDS_EN if len(k) <= 10})
    named = direct(summary_category) | contains_any(F.lower(summary_category), short)
    return F.when(F.coalesce(summary_category, F.lit("")) != "", named).otherwise(F.coalesce(direct(category), F.lit(False)))
