"""Calls of a language model as batch maps, through an injected function; without one, the fallbacks.

``call`` takes a prompt and a :class:`Profile` and returns the answer; what fails is tried again and then null. It is pickled to the
workers. A batch is a row; rows are dealt into lanes, a task each, which make so many calls at once (see :mod:`.lanes`).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, prompts
from ..functions.text import category_display, has_ai_keyword, no_change, strip_code_fences
from ..operators import numbering
from ..operators.documents import ORDER
from ..operators.report import prompt_items
from .lanes import HELD, dealt, side_by_side


@dataclass(frozen=True)
class Profile:
    """Settings of a task's calls."""

    temperature: float
    top_p: float
    max_tokens: int

    @classmethod
    def of(cls, task: str) -> Profile:
        return cls(*fixed.TASK_PROFILES.get(task, fixed.TASK_PROFILES["summarize"]))


Call = Callable[[str, Profile], str]


@dataclass(frozen=True)
class Endpoint:
    """Where a model is asked; the key is looked up in the worker, so that it isn't pickled with the function."""

    base_url: str
    model: str
    key_name: str = "API_KEY"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Endpoint | None:
        """As API_KEY, BASE_URL and MODEL say; None without a key, a base url or a model."""
        if not all(env.get(k) for k in ("API_KEY", "BASE_URL", "MODEL")):
            return None
        return cls(env["BASE_URL"].rstrip("/"), env["MODEL"])

    def __call__(self, prompt: str, profile: Profile) -> str:
        from urllib import request

        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": profile.temperature, "top_p": profile.top_p, "max_tokens": profile.max_tokens}
        asked = request.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ[self.key_name]}"})
        with request.urlopen(asked, timeout=600) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


def ask(asked: DataFrame, column: str, call: Call | None, task: str = "summarize", attempts: int = 2, pause: Callable[[float], None] = time.sleep, into: str = "response", lanes: int | None = None, at_once: int = 3) -> DataFrame:
    """asked with the answer to the prompt in ``column``: null where the prompt is, where each attempt failed or without a call.

    ``lanes * at_once`` calls run at once at most; lanes are by default as many as the cluster has cores.
    """
    names, profile = asked.columns, Profile.of(task)

    def answer(prompt: str | None) -> str | None:
        for k in range(attempts if call is not None and prompt is not None else 0):
            try:
                return call(prompt, profile)
            except (OSError, ValueError, KeyError):
                if k < attempts - 1:
                    pause(min(2**k * 2, 30))
        return None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), HELD * at_once):
                b = whole.iloc[k : k + HELD * at_once]
                yield b.assign(**{into: pd.Series(side_by_side(answer, b[column], at_once), index=b.index, dtype=object)})[[*names, into]]

    return dealt(asked, F.col(column), lanes).mapInPandas(each, ", ".join(f"`{n}` {t}" for n, t in asked.dtypes) + f", `{into}` string")


def parsed(response: Column, schema: str) -> Column:
    """The JSON of a response, with or without fences; null where it can't be read."""
    return F.from_json(strip_code_fences(response), schema, {"mode": "PERMISSIVE"})


def _filled(template: str, **columns: Column) -> Column:
    """A template with columns put in."""
    out, rest = [], template
    for name, c in columns.items():
        before, _, rest = rest.partition("{" + name + "}")
        out += [F.lit(before.replace("{{", "{").replace("}}", "}")), F.coalesce(c.cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest.replace("{{", "{").replace("}}", "}")))


def refined(asked: DataFrame, column: str, call: Call | None, task: str = "summarize", language: str = "zh", critique: bool = True, **options) -> DataFrame:
    """asked with ``response``: a draft, or the draft as a review of it asked to change it. A review or a change that fails leaves the draft."""
    drafted = ask(asked, column, call, task, into="draft", **options)
    if not critique or os.environ.get("SKIP_CRITIQUE"):
        return drafted.withColumnRenamed("draft", "response")
    draft, names = F.col("draft"), asked.columns
    reviewed = drafted.withColumn("review_prompt", F.when(F.coalesce(draft, F.lit("")) != "", _filled(prompts.TEMPLATES["critique", language], draft=draft)))
    reviewed = ask(reviewed, "review_prompt", call, "critique", into="review", **options)
    change = (F.coalesce("review", F.lit("")) != "") & ~no_change(F.coalesce("review", F.lit("")))
    wanted = reviewed.withColumn("change_prompt", F.when(change, _filled(prompts.TEMPLATES["refine", language], draft=draft, critique=F.col("review"))))
    changed = ask(wanted, "change_prompt", call, task, into="changed", **options)
    return changed.select(*names, F.coalesce(F.nullif(F.col("changed"), F.lit("")), draft).alias("response"))


def _batched(articles: DataFrame, item: Callable[[Column], Column], size: int, template: str, separator: str) -> tuple[DataFrame, DataFrame]:
    """articles with batch and j (1-based in it) by pos, and a prompt a batch."""
    numbered = numbering.within(articles.withColumn("__all", F.lit(0)), ["__all"], name="__n").drop("__all")
    placed = numbered.withColumn("batch", F.floor((F.col("__n") - 1) / size)).withColumn("j", ((F.col("__n") - 1) % size + 1).cast("int")).drop("__n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", item(F.col("j")).alias("x")))), lambda s: s["x"]), separator)
    return placed, placed.groupBy("batch").agg(text.alias("articles")).select("batch", _filled(template, articles=F.col("articles")).alias("prompt"))


def classified(articles: DataFrame, call: Call | None, language: str = "zh", size: int = 50, **options) -> DataFrame:
    """articles with is_ai: those of the subject categories are, others by the model, in batches; by keywords where it has no readable answer.

    An answer names items by number, alone or after 'id_'. Rows are told apart, not urls.
    """
    direct = F.coalesce(F.col("category").isin(*fixed.DIRECT_CATEGORIES), F.lit(False))
    rest = articles.where(~direct)
    placed, asked = _batched(rest, prompts.filter_item, size, prompts.TEMPLATES["classify", language], "\n\n")
    answered = ask(asked, "prompt", call, "classify", **options).select(F.col("batch").alias("__b"), parsed(F.col("response"), "map<string,boolean>").alias("__said"))
    key = F.col("j").cast("string")
    said = F.coalesce(F.try_element_at("__said", key), F.try_element_at("__said", F.concat(F.lit("id_"), key)), F.lit(False))
    by_model = F.when(F.col("__said").isNotNull(), said).otherwise(has_ai_keyword(F.col("title"), F.col("description")))
    return articles.where(direct).withColumn("is_ai", F.lit(True)).unionByName(placed.join(answered, F.col("batch") == F.col("__b")).withColumn("is_ai", by_model).drop("batch", "j", "__b", "__said"))


def category_summaries(articles: DataFrame, call: Call | None, language: str = "zh", most: int = 15, **options) -> DataFrame:
    """category, n, summary: of each category's first articles by priority (a top list); categories without an answer are left out."""
    items = prompt_items(articles, "category", most, prompts.summary_item(F.col("rank")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n")
    sizes = articles.groupBy(F.col("category").alias("__c")).agg(F.count("*").alias("n"))
    asked = items.groupBy("category").agg(text.alias("articles")).join(sizes, F.col("category").eqNullSafe(F.col("__c"))).drop("__c")
    asked = asked.withColumn("prompt", _filled(prompts.TEMPLATES["category", language], name=category_display(F.col("category")), articles=F.col("articles")))
    answered = ask(asked, "prompt", call, "summarize", **options)
    return answered.where("coalesce(response, '') <> ''").select("category", "n", F.col("response").alias("summary"))


def executive_summary(summaries: DataFrame, call: Call | None, language: str = "zh", **options) -> DataFrame:
    """response: a summary of the categories' summaries, 200 characters of each (one row a category); '' without any."""
    named = F.concat(category_display(F.col("category")), F.lit(": "), F.substring("summary", 1, 200))
    asked = summaries.agg(F.sum("n").alias("total"), F.count("*").alias("categories"), F.array_join(F.array_sort(F.collect_list(named)), "\n").alias("articles")).where("categories > 0")
    order = ("total", "categories") if language == "en" else ("categories", "total")
    template = prompts.TEMPLATES["executive", language]
    order = sorted(order, key=lambda k: template.index("{" + k + "}"))
    asked = asked.withColumn("prompt", _filled(template, **{k: F.col(k) for k in order}, articles=F.col("articles")))
    return refined(asked.select("prompt"), "prompt", call, "summarize", language, **options).select("response")


def batch_summaries(articles: DataFrame, kind: str, call: Call | None, size: int = 10, **options) -> DataFrame:
    """key and summary of updates, by batches. kind: podcast (the answer maps urls or titles to summaries) or account (a list of them)."""
    item = prompts.podcast_item if kind == "podcast" else prompts.account_item
    _, asked = _batched(articles, item, size, prompts.TEMPLATES[kind, "zh"], "\n")
    response = F.col("response")
    if kind == "podcast":
        found = F.explode(parsed(response, "map<string,string>")).alias("key", "summary")
    else:
        listed = parsed(response, "summaries array<struct<article_url string, ai_summary string>>")["summaries"]
        found = F.inline(F.transform(listed, lambda s: F.struct(s["article_url"].alias("key"), s["ai_summary"].alias("summary"))))
    rows = ask(asked, "prompt", call, "summarize", **options).select("batch", found).where("coalesce(key, '') <> '' AND coalesce(summary, '') <> ''")
    return rows.groupBy("key").agg(F.max_by("summary", "batch").alias("summary"))


def structure(articles: DataFrame, call: Call | None, most: int = 1000, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """points (n, line), themes (theme, title), texts (theme, k, text) and refs (theme, k, title, url, source) as the model groups the first articles.

    ``most`` bounds the one prompt. References out of range go, and themes without any; None without a readable answer or with an empty one.
    """
    numbered = numbering.within(articles.orderBy("pos").limit(most).withColumn("__all", F.lit(0)), ["__all"], name="ref")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", prompts.structure_item(F.col("ref")).alias("x")))), lambda s: s["x"]), "\n")
    asked = numbered.agg(text.alias("articles")).select(_filled(prompts.TEMPLATES["structure", "zh"], articles=F.col("articles")).alias("prompt"))
    answer = ask(asked, "prompt", call, "wechat_structure", **options).select(parsed(F.col("response"), "highlights array<string>, themes array<struct<title string, summary string, refs array<int>>>").alias("a")).collect()[0]["a"]
    if answer is None or not (answer["highlights"] or answer["themes"]):
        return None
    spark = articles.sparkSession
    points = spark.createDataFrame(list(enumerate(answer["highlights"] or [], 1)), "n long, line string")
    named = spark.createDataFrame([(k, t["title"] or "", t["summary"] or "", t["refs"] or []) for k, t in enumerate(answer["themes"] or [], 1)], "raw int, title string, summary string, refs array<int>")
    refs = named.select("raw", F.posexplode("refs").alias("k", "ref")).join(numbered.select(F.col("ref").alias("__r"), F.col("title"), "url", "source"), F.col("ref") == F.col("__r"))
    kept = [r["raw"] for r in refs.select("raw").distinct().orderBy("raw").collect()]  # at most the themes of one answer
    places = spark.createDataFrame([(raw, k) for k, raw in enumerate(kept, 1)], "raw int, theme int")
    themes = named.join(places, "raw")
    return points, themes.select("theme", "title"), themes.where("summary <> ''").select("theme", F.lit(0).cast("long").alias("k"), F.col("summary").alias("text")), refs.join(places, "raw").select("theme", F.col("k").cast("long").alias("k"), "title", "url", "source")


_KINDS = {"tech": ("科技日报", "Tech Daily"), "podcast": ("播客日报", "Podcast Daily"), "wechat": ("微信日报", "Accounts Daily"), "digest": ("每日摘要", "Daily Summary")}


def _as_text(lines: DataFrame) -> DataFrame:
    """articles: the lines of a document as one text, in a row."""
    line = F.struct(*ORDER, F.coalesce("line", F.lit("")).alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("articles"))


def tldr_of(document: DataFrame, call: Call | None, kind: str = "tech", language: str = "zh", most: int = 8000, **options) -> DataFrame:
    """tldr: bullets on a report's first ``most`` characters, in a row; '' without an answer."""
    # no line is shorter than its end, so that many lines hold that many characters
    text = _as_text(document.orderBy(*ORDER).limit(most)).select(F.substring("articles", 1, most).alias("articles"))
    template = prompts.TEMPLATES["tldr", language].replace("{name}", _KINDS.get(kind, (kind, kind))[language == "en"])
    answer = ask(text.select(_filled(template, articles=F.col("articles")).alias("prompt")), "prompt", call, "tldr", **options)
    return answer.select(F.coalesce(strip_code_fences(F.col("response")), F.lit("")).alias("tldr"))


def tldr(document: DataFrame, call: Call | None, *args, **options) -> str:
    return tldr_of(document, call, *args, **options).collect()[0]["tldr"] if call else ""


def deep_analysis_of(articles: DataFrame, call: Call | None, language: str = "zh", most: int = 1000, **options) -> DataFrame:
    """answer: an analysis of the first articles (see :func:`tiered_items`), reviewed, in a row; null without one.

    ``most`` bounds the one prompt.
    """
    text = _as_text(tiered_items(articles.orderBy("pos").limit(most)))
    asked = text.select(_filled(prompts.TEMPLATES["deep_analysis", language], articles=F.col("articles")).alias("prompt"))
    answer = refined(asked, "prompt", call, "deep_analysis", language, **options)
    return answer.select(F.nullif(F.trim("response", F.lit(" \t\r\n")), F.lit("")).alias("answer"))


def deep_analysis(articles: DataFrame, call: Call | None, *args, **options) -> str | None:
    """The same as a text; None for the listing to take its place."""
    return deep_analysis_of(articles, call, *args, **options).collect()[0]["answer"] if call else None


def tiered_items(articles: DataFrame) -> DataFrame:
    """Articles of a prompt as lines: by tiers if any has one (must-reads, noteworthy, brief; others left out), numbered through, else by pos.

    Needs language, category, full_text, cluster_size, theme, editorial_tier.
    """
    from ..operators.documents import block, given, joined

    spark = articles.sparkSession
    tier = F.when(F.col("editorial_tier") == "must_read", 1).when(F.col("editorial_tier") == "noteworthy", 2).when(F.col("editorial_tier") == "brief", 3)
    if articles.where(F.coalesce("editorial_tier", F.lit("")) != "").isEmpty():
        numbered = numbering.within(articles.withColumn("__all", F.lit(0)), ["__all"])
        return block(numbered, 0, 0, 0, F.col("pos"), prompts.deep_item(F.col("number")))
    rows = numbering.continuous(articles.withColumn("__tier", tier).where("__tier IS NOT NULL"), F.col("__tier"))
    present = [r["__tier"] for r in rows.select("__tier").distinct().collect()]  # three at most
    parts = [block(rows, 0, F.col("__tier"), 1, F.col("pos"), prompts.deep_item(F.col("number")))]
    for t in sorted(present):
        parts += [given(spark, 0, [fixed.PROMPT_TIERS[t - 1]], grp=t), given(spark, 0, [""], grp=t, tier=2)]
    return joined(parts)
