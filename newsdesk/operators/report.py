"""Reports as ordered lines: each section yields (line_no, line), a document is its sections in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import category_order


def with_tldr(lines: DataFrame, tldr: DataFrame) -> DataFrame:
    """doc, line_no, part, sub, line: reports with their TL;DR before the first heading of level two or rule, never before the title.

    lines: doc, line_no (from 0), line. tldr: doc, bullets (lines of one text); reports without one stay as they are. Without a heading or rule
    it follows the last quoted line. part 0 are the TL;DR's lines, in order of sub; part 1 the report's own.
    """
    bare = F.trim("line")
    place = lines.groupBy("doc").agg(F.min(F.when(bare.startswith("## ") | (bare == "---"), F.col("line_no"))).alias("rule"), F.max(F.when(bare.startswith("> "), F.col("line_no") + 1)).alias("quote"))
    at = F.greatest(F.coalesce("rule", "quote", F.lit(0)), F.lit(1)).cast("long")
    quoted = F.transform(F.split(F.trim("bullets", F.lit(" \n")), "\n"), lambda x: F.concat(F.lit("> "), x))
    block = F.concat(F.array(F.lit("## 📌 TL;DR"), F.lit("")), quoted, F.array(F.lit(""), F.lit("---"), F.lit("")))
    new = tldr.join(place, "doc").select("doc", at.alias("line_no"), F.lit(0).alias("part"), F.posexplode(block).alias("sub", "line"))
    return lines.select("doc", F.col("line_no").cast("long").alias("line_no"), F.lit(1).alias("part"), F.lit(0).alias("sub"), "line").union(new)


def prompt_items(articles: DataFrame, category: str, most: int = 15, item: Column | None = None) -> DataFrame:
    """Each category's items for a prompt: by priority, then pos, the first of them (a top list), numbered. item: the line, made from rank."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy("priority", "pos"))
    plain = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.col("source"), F.lit("] "), F.col("title"))
    return articles.withColumn("rank", rank).where(F.col("rank") <= most).select(category, "rank", (plain if item is None else item).alias("line"))


def highlights(articles: DataFrame, most: int = 5) -> DataFrame:
    """The first must-reads in order of their categories, by score and pos within (a top list)."""
    order = category_order(F.col("category"))
    return articles.where("editorial_tier = 'must_read'").orderBy(order, "category", F.desc("news_value_score"), "pos").limit(most)
