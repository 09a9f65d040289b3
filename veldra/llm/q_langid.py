"""Query op1: language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import langid
from veldra.llm.folds import held_out, learnable
from veldra.session import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language by name; rows with a
    null id are scored, held_out false, and teach nothing; repeated rows each return; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), "doc_id", "text", "lang", learnable("doc_id"))
    found = langid.with_language(docs.select("doc_id", "text"), "text", model, "language")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


QUERIES = {"op1_language": op1_language}
ORACLE_SQL: dict[str, str] = {}
