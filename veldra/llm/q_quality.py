"""Query op2: quality score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import quality
from veldra.llm.folds import held_out, learnable
from veldra.session import table

THRESHOLD = 0.7


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.RuleEnsemble:
    return quality.fit(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality", learnable("doc_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null texts are scored like empty ones; a null id has held_out false and teaches nothing; repeated rows each return;
    without labels every score is 0.5; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, "text", fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
