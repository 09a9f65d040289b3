"""Files in and out: JSON lines, CSV, embedding bundles, decision logs; publishing a folder."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra import storage
from veldra.operators.contracts import ContractError, require_finite, require_unique
from veldra.operators.windows import numbered

OBSERVATION = T.StructType([
    T.StructField("frame_index", T.LongType()), T.StructField("timestamp_sec", T.DoubleType()), T.StructField("track_id", T.LongType()), T.StructField("class_id", T.LongType()),
    T.StructField("class_name", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox_xyxy", T.ArrayType(T.DoubleType())),
])
DECISION = "decision_id string, event_id string, target_id string, video_sha256 string, revision long, supersedes_decision_id string, action string, selected_segment_id string, selected_frame_index long, confidence string, status string"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str] | None = None, allow_empty: bool = True) -> DataFrame:
    """Rows of JSON objects with a fixed schema. A malformed row, NaN or infinity fails; repeated keys fail if keys are given."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)
    df = require_finite(df, [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))])
    if not allow_empty and df.isEmpty():
        raise ContractError(f"{path} has no rows")
    return require_unique(df, keys) if keys else df


def read_observations(spark: SparkSession, path: str, frames: tuple[int, int] | None = None, tracks: list[int] | None = None) -> DataFrame:
    """Observations with the box as four columns. Rows without a track stay (untracked boxes); aggregates pass them over."""
    df = read_json_lines(spark, path, OBSERVATION, allow_empty=False)
    if frames:
        df = df.where(F.col("frame_index").between(*frames))
    if tracks is not None:
        df = df.where(F.col("track_id").isin(tracks))
    ok = (F.size("bbox_xyxy") == 4) & (F.col("frame_index") >= 0)
    box = F.when(ok, F.col("bbox_xyxy")).otherwise(F.raise_error(F.lit("an observation needs a frame and four box numbers")))
    return df.withColumn("_b", box).select("frame_index", "timestamp_sec", "track_id", "class_id", "class_name", "confidence", *(F.col("_b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def read_track_rows(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str]) -> DataFrame:
    """Rows of JSON objects, checked only for being objects with the keys ``required``; a key may be null, other keys are left out.

    Blank lines are passed over. A line that isn't an object, or lacks a key, fails when it is read and names what it lacks.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    keys = F.map_keys(F.from_json("v", "map<string,string>"))
    lacks = F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))
    checked = F.when(F.size(lacks) == 0, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("a row lacks "), F.concat_ws(", ", lacks))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _no_nan(df: DataFrame) -> DataFrame:
    """``df``, which fails where a double or float, alone or in an array, is not finite."""
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    number_ = (T.DoubleType, T.FloatType)

    def checked(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, number_):
            bad = odd(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, number_):
            bad = F.exists(c, odd)
        else:
            return c
        return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{f.name} isn't finite"))).otherwise(c).alias(f.name)

    return df.select(*map(checked, df.schema))


def read_annotations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header must match the schema; blank cells are null."""
    header = spark.read.text(path).limit(1).collect()
    names = header[0][0].split(",") if header else []
    if names != schema.names:
        raise ContractError(f"header {names} isn't {schema.names}")
    df = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
    return df.withColumns({f.name: F.nullif(F.trim(F.col(f.name)), F.lit("")) for f in schema if isinstance(f.dataType, T.StringType)})


def read_embedding_bundle(spark: SparkSession, matrix: str, index: str, id_: str, size: int = 512) -> DataFrame:
    """(index columns, embedding) of an NPZ matrix and a JSON-lines index joined by row number.

    The matrix must be float32, ``size`` wide, finite and of unit norm; ids must be unique. A one-time import: the
    matrix is one file and is read by one task; write the result as Parquet.
    """
    raw = spark.read.format("binaryFile").load(matrix)

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content)) as z:
                    m = z[z.files[0]]
                if m.dtype != np.float32 or m.ndim != 2 or m.shape[1] != size or not np.isfinite(m).all() or np.abs(np.linalg.norm(m, axis=1) - 1).max(initial=0) > 1e-3:
                    raise ContractError(f"matrix {m.shape} {m.dtype}")
                for a in range(0, len(m), 1024):
                    yield pd.DataFrame({"row_number": np.arange(a, min(len(m), a + 1024)), "embedding": list(m[a : a + 1024])})

    vectors = raw.select("content").mapInPandas(rows, "row_number long, embedding array<float>")
    ids = spark.read.json(index)
    both = vectors.join(ids, "row_number", "full").withColumn(id_, F.when(F.col(id_).isNotNull() & F.col("embedding").isNotNull(), F.col(id_)).otherwise(F.raise_error(F.lit("index and matrix differ"))))
    return require_unique(both, [id_])


def read_log(spark: SparkSession, path: str, schema: str = DECISION) -> DataFrame:
    """An append-only log with ``log_pos``, its line number: files in name order, lines in file order."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return numbered(df.withColumn("_at", at), [F.col("_at")], "log_pos").drop("_at")


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object a row, null fields kept; refuses an existing folder unless told otherwise, and numbers that aren't finite."""
    _no_nan(df).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_template(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, overwrite: bool = False, summary: dict | None = None) -> None:
    """Write tables beside ``folder``, read their counts back, then rename: readers see all of it or none.

    An existing folder is refused, or kept until the new one is in place.
    """
    if storage.exists(spark, folder) and not overwrite:
        raise FileExistsError(folder)
    new, old = f"{folder}.new", f"{folder}.old"
    storage.delete(spark, new)
    for name, df in tables.items():
        df.write.parquet(f"{new}/{name}")
    counts = {name: spark.read.parquet(f"{new}/{name}").count() for name in tables}
    spark.createDataFrame([(json.dumps({"rows": counts, **(summary or {})}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{new}/summary")
    fs, target = storage.hadoop_path(spark, folder)
    _, source = storage.hadoop_path(spark, new)
    _, backup = storage.hadoop_path(spark, old)
    fs.delete(backup, True)
    if fs.exists(target) and not fs.rename(target, backup):
        raise OSError(f"can't move {folder} away")
    if not fs.rename(source, target):
        if fs.exists(backup):
            fs.rename(backup, target)
        raise OSError(f"can't publish {folder}")
    fs.delete(backup, True)


def append_log(spark: SparkSession, row: dict, folder: str, schema: str = DECISION) -> int:
    """Append one decision as the next file of a log with one writer; its revision must be higher than its event's."""
    had = read_log(spark, folder, schema) if storage.exists(spark, folder) else None
    n = had.count() if had is not None else 0
    if had is not None:
        top = had.where(F.col("event_id") == row["event_id"]).agg(F.max("revision")).first()[0]
        if top is not None and row["revision"] <= top:
            raise ContractError(f"revision {row['revision']} isn't higher than {top}")
        if not had.where(F.col("decision_id") == row["decision_id"]).isEmpty():
            raise ContractError(f"decision {row['decision_id']} exists")
    fs, p = storage.hadoop_path(spark, f"{folder}/{n:012d}.json")
    out = fs.create(p, False)  # fails if another writer was first
    out.write(bytearray((json.dumps(row, sort_keys=True, allow_nan=False) + "\n").encode()))
    out.close()
    return n + 1
