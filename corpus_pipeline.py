"""A corpus from raw documents to token ids, in five stages that each take the documents their predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last keep the columns of docs, whatever they are named, but for names that begin with ``__nd_``, which are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import bpe, mixing, nearcopies, quality, rules
from newsdesk.llm.shared import bound_batches, discard, documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are more likely good than bad.

    Null texts count as empty and go, as texts of less than 50 words do; repeated rows stay or go together; an empty table gives an empty one.
    """
    bound_batches(spark)
    examined = rules.examine(F.col("text"))
    seen = stored(docs.select(examined.alias("__nd_x")).select("__nd_x.pattern"), "patterns")
    model = rules.fit(rules.pattern_counts(seen, "pattern"))
    x = F.col("__nd_x")
    good = ~rules.base_failed(x["n_words"], x["n_repeat_words"]) & (model.column(x["pattern"]) >= 0.5)
    return docs.withColumn("__nd_x", examined).where(good).drop("__nd_x")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, learnt from the labelled documents of the input, predicts to be good.

    Null texts are scored as empty ones; equal texts stay or go together; without labels of both kinds all stay; an empty table gives an empty one.
    """
    bound_batches(spark)
    ranker = quality.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("__nd_score", quality.score(F.col("text"), ranker)).where(F.col("__nd_score") >= quality.CUT).drop("__nd_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Groups are connected by a five-word Jaccard similarity of at least 0.8. SimHash's tiled comparison proposes the closest pairs; as its
    radius doesn't reach all such copies, a prefix filter proposes the others; all are compared exactly. Texts decide, not ids: of each
    group one row stays, the first by id (rows without one last) and then by text, so that rows of different texts that share an id are
    told apart. Null and blank texts are one group; an empty table gives an empty one.
    """
    bound_batches(spark)
    return nearcopies.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Null texts have size 0 and are taken 0 times beyond their source's whole share; a null source is one of its own; rows that repeat an id
    are taken together; an empty table gives an empty one.
    """
    bound_batches(spark)
    _, plan = mixing.planned(docs)
    sized = docs.withColumn("__nd_size", mixing.size(F.col("text"))).withColumn("__nd_hash", mixing.hashed(F.col("doc_id"), F.col("text")))
    joined = sized.join(F.broadcast(plan.drop("source_size", "target")), F.col("source").eqNullSafe(F.col("__nd_source")))
    copies = joined.withColumn("__nd_times", mixing.times(F.col("__nd_size"), F.col("__nd_hash"))).where("__nd_times > 0")
    return copies.withColumn("__nd_copy", F.explode(F.sequence(F.lit(1), F.col("__nd_times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of a round trip, a row for each row; null texts count as empty. An empty table gives an empty one."""
    bound_batches(spark)
    return bpe.round_trip(docs).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the trained stages; a test holds each stage's rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
