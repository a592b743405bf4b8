"""The domain's relations derived from the driver's tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title, the whole text the description."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("https://doc.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        "source", F.col("lang").alias("language"), F.col("text").alias("description"), F.lit("").alias("full_text"),
    )


def web_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("pos"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "url", urls.host(F.col("url")).alias("source"), "html")


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url and a variant of it with tracking parameters, a slash at the end of the path and an upper-case host."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    path, rest = F.regexp_extract("url", "^([^?#]*)", 1), F.regexp_extract("url", "^[^?#]*\\??([^#]*)", 1)
    other = F.concat(path, F.lit("/?utm_campaign=x&fbclid="), F.col("page_id").cast("string"), F.when(rest != "", F.concat(F.lit("&"), rest)).otherwise(""), F.lit("#top"))
    return p.select(F.col("page_id").alias("pos"), "url").union(p.select(F.col("page_id") + 1_000_000_000_000, other))


#: SQL for the same relations in the oracles.
TEXT_ARTICLES = "text_articles AS (SELECT doc_id AS pos, split_part(text, chr(10), 1) AS title, 'https://doc.example.com/' || doc_id AS url, source, lang AS language, text AS description FROM documents)"
URL_VARIANTS = r"""url_variants AS (SELECT page_id AS pos, url FROM pages UNION ALL
SELECT page_id + 1000000000000, regexp_extract(url, '^([^?#]*)', 1) || '/?utm_campaign=x&fbclid=' || page_id || CASE WHEN regexp_extract(url, '^[^?#]*\??([^#]*)', 1) <> '' THEN '&' || regexp_extract(url, '^[^?#]*\??([^#]*)', 1) ELSE '' END || '#top' FROM pages)"""
