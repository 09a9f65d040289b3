"""Query op11: conversations with planted damage, repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import dialogue
from veldra.session import table


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with a fault for some of them, by the CRC-32 of ``conv_id:turn``; ``present`` is false for dropped ones."""
    t = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    t = t.withColumn("_code", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    t = t.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_code") != 0).alias("present"), "_code")
    copies = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.withColumn("_copy", F.explode(copies)).drop("_code", "_copy")


def op11_dialogue(spark: SparkSession, sf_dir: str, piece: int = dialogue.PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every original conversation.

    A null conv_id is a conversation; null turns come first; a null role or text is one space; rows of equal turn are
    ordered by role and text. Repeated rows are duplicates. An empty table gives an empty one.
    """
    found = dialogue.repair(damaged(table(spark, sf_dir, "conversations")), "conv_id", "turn", "role", "text", "present", piece)
    lines = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    out = found.whole.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
    if found.long_reports is not None:
        digest = dialogue.digests(found.long_turns).withColumnRenamed("conv", "_conv")
        joined = found.long_reports.join(digest, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
        out = out.unionByName(joined.select(*found.long_reports.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
    return out.withColumnRenamed("conv", "conv_id")


QUERIES = {"op11_dialogue": op11_dialogue}

_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: (state, state after the edit, letters, cost, initial that it needs, roles of inserted rows, new role)
_EDITS = [
    (a, c, "I" * n + e, 2 * n + cost, need, lead, new)
    for a, ways in {"0": [("0", []), ("u", ["user"]), ("a", ["user", "assistant"])], "s": [("s", []), ("u", ["user"]), ("a", ["user", "assistant"])], "u": [("u", []), ("a", ["assistant"])], "a": [("a", []), ("u", ["user"])]}.items()
    for b, lead in ways
    for n in [len(lead)]
    for e, cost, c, need, new in [
        ("D", 3, b, "", ""),
        ("R", 2, "a" if b == "u" else "u", "", "assistant" if b == "u" else "user"),
        ("K", 0, "a" if b == "u" else "u", "a" if b == "u" else "u", ""),
        *([("K", 0, "s", "s", "")] if b == "0" else []),
    ]
]
_TABLE = ", ".join(f"('{a}', '{c}', '{e}', {cost}, '{need}', '{''.join(r + ':' + chr(10) for r in lead)}', '{new}')" for a, c, e, cost, need, lead, new in _EDITS)
ORACLE_SQL = {
    "op11_dialogue": f"""
WITH RECURSIVE edits(st, nxt, letters, cost, need, lead, fresh) AS (VALUES {_TABLE}),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT *, {_CRC} % 20 AS code FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded WHERE code <> 0),
ordered AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {_WHITE}) AS body,
  lag(role) OVER w AS was FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM ordered),
walk AS (SELECT conv_id, 0::BIGINT AS i, '0' AS st, 0 AS cost, '' AS audit, '' AS body FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
  SELECT conv_id, i, nxt, m.cost, m.audit, m.body FROM (
    SELECT w.conv_id, f.i, e.nxt, min({{'cost': w.cost + e.cost + CASE WHEN f.fault = 't' AND right(e.letters, 1) <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || e.letters,
      'body': w.body || e.lead || CASE right(e.letters, 1) WHEN 'D' THEN '' WHEN 'R' THEN e.fresh || ':' || f.text || chr(10) ELSE f.role || ':' || f.text || chr(10) END}}) AS m
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN edits e ON e.st = w.st AND (e.need = '' OR e.need = f.initial) AND (f.fault NOT IN ('b', 'd') OR right(e.letters, 1) = 'D')
    GROUP BY w.conv_id, f.i, e.nxt)),
ends AS (SELECT *, cost + CASE st WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS total, audit || CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS whole,
  body || CASE st WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END AS lines FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total, whole) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (was IS NOT NULL AND left(was, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  total::BIGINT AS cost, whole AS audit, sha256(left(lines, greatest(length(lines) - 1, 0))) AS repaired_sha256 FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""
}
