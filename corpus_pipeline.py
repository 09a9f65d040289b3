"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns
of documents; the last returns the token ids of each remaining document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import contamination, nbest, neardup, quality, secrets
from veldra.llm.folds import learnable
from veldra.session import table
from veldra.storage import Scratch

#: Documents that score less are rejected.
LEAST_QUALITY = 0.7
#: Ids that are broadcast (8 MB); more are joined.
BROADCAST_IDS = 1 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null texts are scored like empty ones; repeated rows are judged alike; all columns stay as they are.
    """
    model = quality.fit(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality", learnable("doc_id"))
    return quality.with_score(docs, "text", model, "_score").where(F.col("_score") >= LEAST_QUALITY).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): the smallest id.

    Rows of a kept doc_id with one and the same text are reduced to one, that with the least other columns; unlike texts
    of a doc_id all stay. Rows without an id stay.
    """
    scratch = Scratch(spark, "pipeline")
    found = scratch.keep(neardup.near_duplicates(docs, "doc_id", "text", k=5, numerator=80).select("doc_id", "kept"), "groups")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    repeated = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice")
    n = gone.count()
    left = docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    if repeated.isEmpty():
        return left
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    twice = left.join(repeated, left["doc_id"] == F.col("_twice"), "left_semi")
    once = twice.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_0"), *rest)).alias("_rest")).select("doc_id", "text", *(F.col(f"_rest.{c}").alias(c) for c in rest))
    return left.join(repeated, left["doc_id"] == F.col("_twice"), "left_anti").unionByName(once.select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs.

    Null and empty texts stay; repeated rows are judged alike; all columns stay as they are.
    """
    return contamination.decontaminate(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and ``n_chars``, if there is one, counted again.

    Null and empty texts stay as they are; repeated rows each return.
    """
    ledger = secrets.update(spark, docs, "text", Scratch(spark, "pipeline").fresh("ledger"))
    masked = secrets.redact(secrets.with_spans(docs, "text", ledger, into="_spans"), "text", "_spans")
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, scores, others, round_trip) of each document; null and empty texts have no ids, repeated rows each return."""
    out = nbest.with_segmentation(docs.select("doc_id", "text"), "text", public_tokenizers.path("piece_bpe_32k.model"), 4, "s")
    return out.select("doc_id", "s.*")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding and decoding", segmentation_stage),
]

#: SQL can express neither the classifier nor the segmentation; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
