"""Query op5: SentencePiece segmentation of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.nbest import with_segmentation
from veldra.session import table


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, scores, others, round_trip) of every document: ``others`` are the ids of the second to fourth best.

    Null and empty texts have no ids and one score, 0; of equal scores that of ``ids`` is the first, then they come in the
    order of their ids; repeated rows each return; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_segmentation(docs, "text", public_tokenizers.path("piece_bpe_32k.model"), 4, "s")
    return found.select("doc_id", F.col("s.n_tokens").alias("n_tokens"), F.col("s.ids").alias("ids"), F.col("s.scores").alias("scores"), F.col("s.others").alias("others"), F.col("s.round_trip").alias("round_trip"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
