"""Query op7: secrets of every document, through the blob ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import secrets
from veldra.session import table
from veldra.storage import Scratch


#: Setting that names a ledger folder to go on with; a fresh ledger is begun where it is unset.
LEDGER = "spark.veldra.secrets.ledger"


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document; null texts are empty.

    The numbers and the hash are those of the base rules; spans holds those of all rules. Repeated rows each return; an
    empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.update(spark, docs, "text", spark.conf.get(LEDGER, None) or Scratch(spark, "secrets").fresh("ledger"))
    found = secrets.with_spans(docs, "text", ledger)
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["rule"] == kind)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["stop"].cast("string"))))
    base = F.filter("secret_spans", lambda s: s["rule"].isin([r.kind for r in secrets.BASE_RULES]))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = {
    "assign": (_ASSIGN, 6, 2),
    "access": ("AKIA[A-Z0-9]+", 20, 0),
    "hex": ("[0-9a-f]+", 24, 0),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
}
_MATCHES = " UNION ALL ".join(f"SELECT r, t, '{kind}' AS kind, {k} AS k, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS p FROM d" for k, (kind, (p, least, group)) in enumerate(_KINDS.items()))
ORACLE_SQL = {
    "op7_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
e AS (SELECT r, kind, k, least, i, length(m[i]) AS size, length(g[i]) AS counted, length(p[i]) AS before FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
s AS (SELECT r, kind, k, least, counted, size, sum(before + size) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS stop FROM e),
f AS (SELECT r, kind, k, stop - size AS start, stop FROM s WHERE counted >= least),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nk, count(*) FILTER (kind = 'hex') AS nh,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nk, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""
}
