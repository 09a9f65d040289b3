"""Files and streams."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.operators.contracts import ContractError
from veldra.sources import files
from veldra.streaming import tracks


def test_json_lines(spark, tmp_path):
    p = tmp_path / "o.jsonl"
    p.write_text("".join(json.dumps({"frame_index": i, "timestamp_sec": i / 30, "track_id": 1 if i else None, "class_id": 0, "class_name": "person", "confidence": 0.5, "bbox_xyxy": [0, 0, 1, 2]}) + "\n" for i in range(4)))
    df = files.read_observations(spark, str(p), frames=(1, 2))
    assert [tuple(r) for r in df.select("frame_index", "x2", "y2").orderBy("frame_index").collect()] == [(1, 1.0, 2.0), (2, 1.0, 2.0)]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,label\n1,x\n2,  \n")
    schema = T.StructType().add("id", T.IntegerType()).add("label", T.StringType())
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "a.csv"), schema).orderBy("id").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ContractError):
        files.read_annotations(spark, str(tmp_path / "a.csv"), T.StructType().add("id", T.IntegerType()))


def test_embedding_bundle(spark, tmp_path):
    m = np.eye(4, dtype=np.float32)
    np.savez(tmp_path / "m.npz", embeddings=m)
    (tmp_path / "i.jsonl").write_text("".join(json.dumps({"row_number": i, "crop_id": f"c{i}"}) + "\n" for i in range(4)))
    got = files.read_embedding_bundle(spark, str(tmp_path / "m.npz"), str(tmp_path / "i.jsonl"), "crop_id", 4)
    assert got.where("crop_id = 'c2'").first()["embedding"] == [0, 0, 1, 0]


def test_publish_and_log(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.publish(spark, {"t": spark.range(3)}, folder)
    with pytest.raises(FileExistsError):
        files.publish(spark, {"t": spark.range(4)}, folder)
    files.publish(spark, {"t": spark.range(4)}, folder, overwrite=True)
    assert spark.read.parquet(f"{folder}/t").count() == 4
    log = str(tmp_path / "log")
    assert files.append_log(spark, {"decision_id": "d1", "event_id": "e", "revision": 1}, log) == 1
    assert files.append_log(spark, {"decision_id": "d2", "event_id": "e", "revision": 2, "supersedes_decision_id": "d1"}, log) == 2
    with pytest.raises(ContractError):
        files.append_log(spark, {"decision_id": "d3", "event_id": "e", "revision": 2}, log)
    assert [r.decision_id for r in files.read_log(spark, log).orderBy("log_pos").collect()] == ["d1", "d2"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, f, "confirm") for f in (1, 2, 9, 10, 30)] + [(2, 5, "defer")], "track long, frame long, action string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track long, frame long, action string").parquet(str(tmp_path / "in"))
    for name, df, mode, rows in (("runs", tracks.track_runs(stream, "track", "frame"), "append", 2), ("heads", tracks.latest_decisions(stream, "track", "frame", "action"), "complete", 2)):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            end = time.time() + 120
            while spark.table(name).count() < rows and time.time() < end and q.exception() is None:
                time.sleep(0.5)
            assert q.exception() is None
        finally:
            q.stop()
    assert [tuple(r) for r in spark.table("runs").orderBy("start").collect()][:2] == [(1, 1, 2, 2), (1, 9, 10, 2)]
    assert [tuple(r) for r in spark.table("heads").orderBy("track").collect()] == [(1, 30, "confirm"), (2, 5, "defer")]


def test_lenient_track_rows(spark, tmp_path):
    from veldra.sources import files

    p = tmp_path / "t.jsonl"
    p.write_text('{"track_id": 1, "frame_index": 2, "extra": {"a": 1}}\n\n  \n{"track_id": null, "frame_index": 3}\n')
    df = files.read_track_rows(spark, str(p), "track_id long, frame_index long", ["track_id", "frame_index"])
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [(1, 2), (None, 3)]
    for bad in ('{"track_id": 1}\n', "[1]\n", "{\n"):
        p.write_text(bad)
        with pytest.raises(Exception):
            files.read_track_rows(spark, str(p), "track_id long, frame_index long", ["track_id", "frame_index"]).collect()


def test_numbers_that_are_not_finite_are_not_written(spark, tmp_path):
    from veldra.sources import files

    df = spark.createDataFrame([(1, 2.0, [1.0])], "a int, b double, c array<double>")
    files.write_json_lines(df, str(tmp_path / "fine"))
    for i, (b, c) in enumerate([(float("nan"), [1.0]), (1.0, [1.0, float("inf")])]):
        with pytest.raises(Exception, match="finite"):
            files.write_json_lines(spark.createDataFrame([(1, b, c)], "a int, b double, c array<double>"), str(tmp_path / f"bad{i}"))


def test_exactly_one_class(spark):
    from pyspark.sql import functions as F

    from veldra.operators.contracts import exactly_one

    rules = {"small": F.col("v") < 10, "large": F.col("v") > 5}
    df = spark.createDataFrame([(1,), (20,), (7,), (None,)], "v int")
    assert [r[0] for r in df.where("v in (1, 20)").select(exactly_one(rules)).collect()] == ["small", "large"]
    for v in ("v = 7", "v is null"):
        with pytest.raises(Exception, match="exactly one"):
            df.where(v).select(exactly_one(rules)).collect()
