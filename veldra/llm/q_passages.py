"""Query op10: passages that repeat across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldra.llm.passages import repeated_passages
from veldra.session import table


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals (doc_id, row, start, stop, n_words, n_paragraphs, keep_doc_id, cluster) of passages that repeat across documents.

    Null, empty and short texts and null ids have no rows; repeated rows count once; an empty table gives an empty one.
    """
    return repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
