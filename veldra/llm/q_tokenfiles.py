"""Query op9: token-id files of all documents, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldra.llm.tokenfiles import read_token_files, write_token_files
from veldra.session import table
from veldra.storage import Scratch


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    Null and empty texts have their end id alone; null ids come first; equal ids are ordered by a hash of their text;
    an empty table gives an empty one.
    """
    folder = Scratch(spark, "tokens").fresh("files")
    write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder)


QUERIES = {"op9_token_files": op9_token_files}
ORACLE_SQL: dict[str, str] = {}
