"""Several append-only logs in one folder, committed together.

A commit is one file with the rows of all logs that it touches, a number, and a hash over the hash of the commit before it:
readers see all rows of a commit or none. Writers are optimistic: each names the head that it has read, and of two with
the same head only one can create the next file. A file that was torn by a crash fails its own hash and is passed over; a
file that was changed later breaks the chain, and reading fails.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra import storage
from veldra.operators.contracts import ContractError

_COMMIT = "n long, previous string, rows string, sha256 string"
ROOT = ""


class LostRace(RuntimeError):
    """Another writer committed first; read again and decide anew."""


class BrokenChain(ContractError):
    """A commit isn't the one that its successors were made upon."""


@dataclass(frozen=True)
class Head:
    """The last valid commit, and the number of the last file, torn ones included."""

    n: int
    sha256: str
    last_file: int


def _digest(n: int, previous: str, rows: str) -> str:
    return hashlib.sha256(f"{n}\n{previous}\n{rows}".encode()).hexdigest()


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(n, previous, rows, sha256, file_n, valid) of every commit file; ``valid`` is false for torn ones."""
    if not storage.exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], f"{_COMMIT}, file_n long, valid boolean")
    raw = spark.read.option("wholetext", True).text(f"{folder}/commits").select(F.from_json("value", _COMMIT).alias("c"), F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("file_n"))
    want = F.sha2(F.concat_ws("\n", F.col("c.n").cast("string"), "c.previous", "c.rows"), 256)
    return raw.select("c.*", "file_n", F.coalesce((want == F.col("c.sha256")) & (F.col("c.n") == F.col("file_n")), F.lit(False)).alias("valid"))


def head(spark: SparkSession, folder: str) -> Head:
    """What a writer must name to commit next."""
    top = commits(spark, folder).agg(F.max(F.struct(F.when(F.col("valid"), F.col("n")).alias("n"), "sha256")).alias("h"), F.max("file_n").alias("f")).first()
    return Head(-1, ROOT, -1 if top.f is None else top.f) if top.h is None or top.h.n is None else Head(top.h.n, top.h.sha256, top.f)


def read(spark: SparkSession, folder: str, log: str, schema: str) -> DataFrame:
    """The rows of one log in the order of their commits, with ``log_pos`` (commit number, place) as one rising long.

    A commit of which a predecessor is missing or was changed raises BrokenChain when rows are read. An empty folder gives
    an empty table.
    """
    good = commits(spark, folder).where("valid")
    w = Window.orderBy("n")  # commits, not rows: a short chain of hashes
    linked = good.withColumn("_was", F.coalesce(F.lag("sha256").over(w), F.lit(ROOT)))
    checked = F.when(F.col("previous") == F.col("_was"), F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("broken chain at commit "), F.col("n").cast("string"))))
    rows = linked.select("n", F.from_json(checked, "map<string,array<string>>").alias("_rows"))
    each = rows.select("n", F.posexplode(F.element_at("_rows", F.lit(log))).alias("_p", "_row"))
    return each.select(F.from_json("_row", schema, {"mode": "FAILFAST"}).alias("_r"), (F.col("n") * 1_000_000 + F.col("_p")).alias("log_pos")).select("_r.*", "log_pos")


def commit(spark: SparkSession, folder: str, rows: dict[str, list[dict]], seen: Head) -> Head:
    """Append rows to several logs at once, if nothing was committed since ``seen``; else LostRace."""
    if head(spark, folder).sha256 != seen.sha256:
        raise LostRace(f"{folder}: the head isn't {seen.sha256 or 'empty'} any more")
    text = json.dumps({k: [json.dumps(r, sort_keys=True, allow_nan=False, ensure_ascii=False) for r in v] for k, v in rows.items()}, sort_keys=True, ensure_ascii=False)
    n = seen.last_file + 1
    sha = _digest(n, seen.sha256, text)
    fs, path = storage.hadoop_path(spark, f"{folder}/commits/{n:012d}.json")
    try:
        out = fs.create(path, False)  # refuses a file that is there
    except Exception as e:
        if fs.exists(path):
            raise LostRace(f"{folder}: commit {n} exists") from e
        raise
    out.write(bytearray(json.dumps({"n": n, "previous": seen.sha256, "rows": text, "sha256": sha}, ensure_ascii=False).encode()))
    out.hsync()
    out.close()
    return Head(n, sha, n)


DECISION_ROW = "decision_id string, event_id string, target_id string, revision long, action string, segment string, track string, start long, stop long, frame long"
APPROVAL_ROW = "approval_id string, decision_id string, target_id string, approval_status string"


def confirm_and_approve(spark: SparkSession, folder: str, event_id: str, target_id: str, segment: str, track: str, start: int, stop: int, frame: int, seen: Head | None = None) -> Head:
    """A confirmation and its approval in one commit: the logs ``decisions`` and ``approvals`` both get their row, or neither.

    The revision follows the event's highest, ids are made of event and revision. The interval is that of the whole track
    and must hold the frame. ``seen``: the head on which the caller decided, the present one if none is given.
    """
    if not segment or not start <= frame <= stop:
        raise ContractError("a confirmation needs a segment and a frame within its interval")
    seen = seen or head(spark, folder)
    last = read(spark, folder, "decisions", DECISION_ROW).where(F.col("event_id") == event_id).agg(F.max("revision")).first()[0]
    revision = (last or 0) + 1
    decision = f"dec_{event_id}_{revision:04d}"
    row = {"decision_id": decision, "event_id": event_id, "target_id": target_id, "revision": revision, "action": "CONFIRM_TARGET", "segment": segment, "track": track, "start": start, "stop": stop, "frame": frame}
    approval = {"approval_id": f"appr_{decision}_0001", "decision_id": decision, "target_id": target_id, "approval_status": "APPROVED"}
    return commit(spark, folder, {"decisions": [row], "approvals": [approval]}, seen)
