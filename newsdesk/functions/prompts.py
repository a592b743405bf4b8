"""Prompts: an article's part of a prompt by form, and templates by task and language.

Item functions return one string column from columns of articles; index is the item's number in its prompt. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_P = fixed.PROMPT_PARTS

TEMPLATES = {
    ("classify", "zh"): "判断下列文章是否与人工智能相关。只返回 JSON，键为编号，值为 true 或 false。\n\n{articles}",
    ("classify", "en"): "Which of these articles are about artificial intelligence? Answer with JSON alone: number to true or false.\n\n{articles}",
    ("category", "zh"): "用中文概括「{name}」分类今天的要点，三到五句话。\n\n{articles}",
    ("category", "en"): "Summarise today's items of the category {name} in three to five sentences.\n\n{articles}",
    ("executive", "zh"): "根据 {categories} 个分类、{total} 篇文章的摘要，写一段今日综述。\n\n{articles}",
    ("executive", "en"): "From the summaries of {categories} categories with {total} articles, write one paragraph on today.\n\n{articles}",
    ("podcast", "zh"): "为每个单集写一句摘要。只返回 JSON，键为链接，值为摘要。\n\n{articles}",
    ("account", "zh"): '为每篇文章写一句摘要。只返回 JSON：{{"summaries": [{{"article_url": "", "ai_summary": ""}}]}}。\n\n{articles}',
    ("structure", "zh"): '把文章归为三到六个主题。只返回 JSON：{{"highlights": [""], "themes": [{{"title": "", "summary": "", "refs": [1]}}]}}。\n\n{articles}',
    ("tldr", "zh"): "用三到五个要点概括这份{name}。\n\n{articles}",
    ("tldr", "en"): "Sum up this {name} in three to five bullet points.\n\n{articles}",
    ("deep_analysis", "zh"): "写一份深度分析：热点话题、趋势、重点文章。\n\n{articles}",
    ("deep_analysis", "en"): "Write an analysis in depth: topics, trends, the main articles.\n\n{articles}",
    ("critique", "zh"): "检查这份草稿是否准确、清楚、无遗漏；没有问题就回答「无需修改」。\n\n{draft}",
    ("critique", "en"): "Check this draft for accuracy, clarity and gaps; if there is nothing to change, say 'no changes needed'.\n\n{draft}",
    ("refine", "zh"): "按照意见改进草稿，只输出改进后的版本。\n\n# 草稿\n{draft}\n\n# 意见\n{critique}",
    ("refine", "en"): "Improve the draft as the review asks; output the improved version alone.\n\n# Draft\n{draft}\n\n# Review\n{critique}",
}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _lines(*lines: Column) -> Column:
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def _labelled(label: str, text: Column, indent: str = "   ") -> Column:
    """A line that is left out where its text is empty."""
    return F.when(text != "", F.concat(F.lit(f"{indent}{_P[label]}: "), text))


def article_item(index: Column, limit: int = 300, kind: bool = False) -> Column:
    """Number, language, title, source, link, start of the description and, if asked for, the category."""
    flag = F.when(F.col("language") == "zh", "🇨🇳").otherwise("🇺🇸")
    first = F.concat(index.cast("string"), F.lit(". ["), flag, F.lit("] "), _text("title"))
    always = lambda label, c: F.concat(F.lit(f"   {_P[label]}: "), _text(c))
    return _lines(first, always("source", "source"), always("link", "url"), _labelled("summary", F.substring(_text("description"), 1, limit)), *([_labelled("kind", _text("category"))] if kind else []))


def deep_item(index: Column) -> Column:
    """An article for the deep analysis: its cluster if it is not alone (cluster_size, theme), itself, the start of its full text."""
    cluster = F.when(F.coalesce("cluster_size", F.lit(1)) > 1, F.concat(F.lit("[CLUSTER: "), F.col("cluster_size").cast("string"), F.lit(f'{_P["about"]}"'), _text("theme"), F.lit('"]')))
    text = _text("full_text")
    return _lines(cluster, article_item(index, 300, True), _labelled("text", F.when(F.length(text) > 500, F.substring(text, 1, 2000)).otherwise(text)), F.lit(""))


def filter_item(index: Column) -> Column:
    return _lines(F.concat(F.lit("["), index.cast("string"), F.lit("] "), _text("title")), _labelled("source", _text("source"), "    "), _labelled("summary", F.substring(_text("description"), 1, 200), "    "))


def summary_item(index: Column) -> Column:
    return _lines(article_item(index, 200), _labelled("transcript", F.substring(_text("transcript"), 1, 500)), F.lit(""))


def podcast_item(index: Column) -> Column:
    notes = F.substring(F.coalesce(F.nullif(F.col("full_text"), F.lit("")), F.col("description"), F.lit("")), 1, 300)
    return _batch_item(index, "podcast", "episode", "notes", notes)


def account_item(index: Column) -> Column:
    return _batch_item(index, "account", "article", "summary", F.substring(_text("description"), 1, 200))


def _batch_item(index: Column, who: str, what: str, about: str, text: Column) -> Column:
    first = F.concat(index.cast("string"), F.lit(f". {_P[who]}: "), _text("source"))
    return _lines(first, F.concat(F.lit(f"   {_P[what]}: "), _text("title")), F.concat(F.lit(f"   {_P['link']}: "), _text("url")), _labelled(about, text), F.lit(""))


def structure_item(index: Column) -> Column:
    wide = lambda label, c: F.concat(F.lit(f"   {_P[label]}："), c)
    source, text = _text("source"), F.substring(_text("description"), 1, 200)
    return _lines(F.concat(index.cast("string"), F.lit(". "), _text("title")), F.when(source != "", wide("source", source)), F.when(text != "", wide("summary", text)), wide("link", _text("url")), F.lit(""))
