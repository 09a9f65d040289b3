"""Query op3: near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldra.llm.neardup import near_duplicates
from veldra.session import table


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document, with shingles of four words.

    Null and empty texts have no shingles and are alone; a null id is linked with nothing; repeated rows each return; an
    empty table gives an empty one.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", k=4, numerator=80)


QUERIES = {"op3_near_dedup": op3_near_dedup}


def components_sql(k: int, source: str = "documents") -> str:
    """DuckDB: doc_id, n_shingles and component_id of the near-duplicate definition, by exact set overlap."""
    return rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({k}, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.doc_id),
component AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)"""


ORACLE_SQL = {
    "op3_near_dedup": f"""
WITH RECURSIVE {components_sql(4)}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN component USING (doc_id)"""
}
