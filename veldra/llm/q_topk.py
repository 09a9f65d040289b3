"""Query op8: nearest vectors of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.topk import top_k
from veldra.session import table


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 best of all other rows for each query.

    Null ids, null or empty vectors and such with a null or non-finite component take no part; ties go to smaller ids;
    repeated ids each count; an empty table gives an empty one.
    """
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


QUERIES = {"op8_top_k": op8_top_k}
ORACLE_SQL = {
    "op8_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
}
