"""Query op13: toxicity score of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import toxicity
from veldra.session import table

THRESHOLD = 0.7


def held_out(doc_id: str) -> Column:
    """True where the CRC-32 of the id's text leaves 1 when divided by 3; false for a null id, which is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    known = F.col("doc_id").isNotNull() & ~held_out("doc_id")
    return toxicity.fit(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic", known, known)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null texts are scored like empty ones; a null id has held_out false and teaches nothing; repeated rows each return;
    without confirmed toxic documents every score is near 0; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, "text", fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op13_toxicity": op13_toxicity}
ORACLE_SQL: dict[str, str] = {}
