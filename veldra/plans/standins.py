"""Observation, interval, edge, label and log tables derived from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.vectors import sign_bits
from veldra.session import table

WIDTH, HEIGHT, FPS = 1200, 640, 30.0


def boxed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a detection: frame = whole hours since 2024, a box from its id."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    hour = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 3600)
    x1, y1 = (F.col("event_id") * 37) % WIDTH, (F.col("event_id") * 91) % HEIGHT
    return e.select("event_id", F.col("user_id").alias("track"), hour.alias("frame"), F.col("event_type").alias("class_name"), (F.col("value") / 500).alias("confidence"), "value", "props", x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("event_id") % 60).alias("x2"), (y1 + 40 + F.col("event_id") % 90).alias("y2"))


BOXED = """boxed AS (SELECT event_id, user_id AS track, (floor((epoch(ts) - 1704067200) / 3600))::BIGINT AS frame, event_type AS class_name, value / 500 AS confidence, value, props,
  (event_id * 37) % 1200 AS x1, (event_id * 91) % 640 AS y1, (event_id * 37) % 1200 + 20 + event_id % 60 AS x2, (event_id * 91) % 640 + 40 + event_id % 90 AS y2 FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection of each track and frame: the highest value, then the lowest id."""
    b = boxed_events(spark, sf_dir)
    best = b.groupBy("track", "frame").agg(F.max(F.struct("value", -F.col("event_id"), "event_id", "class_name", "confidence", "props", "x1", "y1", "x2", "y2")).alias("m"))
    return best.select("track", "frame", *(f"m.{c}" for c in ("event_id", "class_name", "confidence", "value", "props", "x1", "y1", "x2", "y2")))


OBS = BOXED + """,
obs AS (SELECT * FROM boxed QUALIFY row_number() OVER (PARTITION BY track, frame ORDER BY value DESC, event_id) = 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, bits): signs of the first 63 components."""
    return vectors(spark, sf_dir).select("vec_id", "label", sign_bits(F.col("embedding")).alias("bits"))


HASHES = "hashes AS (SELECT vec_id, label, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0::BIGINT END))::BIGINT AS bits FROM embeddings)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a track's frames with gaps of at most 3: (track, start, stop, frames)."""
    from veldra.operators.windows import runs

    return runs(observations(spark, sf_dir), ["track"], "frame", 3).drop("run")


SESSIONS = OBS + """,
marked AS (SELECT track, frame, coalesce((frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) > 3)::INT, 1) AS fresh FROM obs),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY frame) AS run FROM marked),
sessions AS (SELECT track, min(frame) AS start, max(frame) AS stop, count(*) AS frames FROM numbered GROUP BY track, run)"""


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a decision log: event = conversation, revision = turn, action from the role.

    Every third turn supersedes the turn before it.
    """
    c = table(spark, sf_dir, "conversations")
    action = F.when(F.col("role") == "user", "confirm").when(F.col("role") == "assistant", "correct").otherwise("defer")
    pos = F.col("conv_id") * 1000 + F.col("turn")
    old = F.when((F.col("turn") % 3 == 2), F.col("conv_id") * 1000 + F.col("turn") - 1)
    return c.select(F.col("conv_id").alias("event"), F.col("turn").alias("revision"), action.alias("action"), pos.alias("decision"), pos.alias("log_pos"), old.alias("supersedes"), F.length("text").cast("long").alias("size"))


LOG = """log AS (SELECT conv_id AS event, turn AS revision, CASE role WHEN 'user' THEN 'confirm' WHEN 'assistant' THEN 'correct' ELSE 'defer' END AS action,
  conv_id * 1000 + turn AS decision, conv_id * 1000 + turn AS log_pos, CASE WHEN turn % 3 = 2 THEN conv_id * 1000 + turn - 1 END AS supersedes, length(text) AS size FROM conversations)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, confidence, outcome): labelled documents; confidence is a fixed function of the length, with ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "quality", "toxic")
    outcome = F.when(F.col("quality").isNull(), "uncertain").when((F.col("quality") == 1) & (F.col("toxic") == 0), "exact").when(F.col("quality") == 1, "wrong").otherwise("negative")
    return d.join(y, d["doc_id"] == F.col("_d"), "left").select("doc_id", "lang", "n_chars", F.coalesce("quality", F.lit(-1)).alias("quality"), ((F.col("n_chars") % 997) / 997.0).alias("confidence"), outcome.alias("outcome"))


LABELLED = """labelled AS (SELECT d.doc_id, d.lang, d.n_chars, coalesce(quality, -1) AS quality, (n_chars % 997) / 997.0::DOUBLE AS confidence,
  CASE WHEN quality IS NULL THEN 'uncertain' WHEN quality = 1 AND toxic = 0 THEN 'exact' WHEN quality = 1 THEN 'wrong' ELSE 'negative' END AS outcome FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
