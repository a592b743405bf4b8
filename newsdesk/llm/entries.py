"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, html, lm, mixing, quality, rules, simhash, sketch, substrings, tokenfile, variants, warc
from .shared import documents, stored


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = stored(documents(spark, sf_dir).select("doc_id", rules.examine(F.col("text")).alias("x")).select("doc_id", "x.*"), "examined")
    model = rules.fit(rules.pattern_counts(seen, "pattern"))
    probability = model.column(F.col("pattern"))
    failed = rules.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return seen.select("doc_id", *rules.BASE, failed.alias("base_failed"), (~failed & (probability >= 0.5)).alias("kept"), probability.alias("probability"), F.col("pattern").alias("votes"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tokenfile.write_file(documents(spark, sf_dir))
    return tokenfile.read_file(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), ranker).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compared(documents(spark, sf_dir))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.score(docs, *lm.fit(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, books = codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return done.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_QUERIES = (
    op1_quality_rules,
    op2_html_extraction,
    op3_token_file,
    op4_simhash_near_dedup,
    op5_quality_classifier,
    op6_source_mixing,
    op7_byte_bpe,
    op8_scaled_sketch,
    op9_warc_archive,
    op10_lm_scoring,
    op11_spelling_variants,
    op12_vector_codes,
    op13_substring_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_source_mixing": mixing.ORACLE,
        "op8_scaled_sketch": sketch.ORACLE,
        "op9_warc_archive": warc.ORACLE,
        "op11_spelling_variants": variants.ORACLE,
        "op12_vector_codes": codes.ORACLE,
        "op13_substring_dedup": substrings.ORACLE,
    }
