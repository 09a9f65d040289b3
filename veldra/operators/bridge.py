"""A target carried over a gap: the predicted box picks the next frame's detection, and what was picked moves the box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules: weights of overlap and nearness, and what a colour adds.
OVERLAP_WEIGHT, NEAR_WEIGHT, SAME_KIT, UNKNOWN_KIT = 0.55, 0.35, 0.08, 0.02


def _moved(box: Column, dx: Column, dy: Column) -> Column:
    return F.struct((box["x1"] + dx).alias("x1"), (box["y1"] + dy).alias("y1"), (box["x2"] + dx).alias("x2"), (box["y2"] + dy).alias("y2"))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _scored(projected: Column, d: Column, most_distance: float, least_iou: float, least_scale: float, most_scale: float) -> Column:
    """(score, track, box, kit) of a detection, null score where a hard rule rejects it."""
    area = lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))
    w = F.greatest(F.least(projected["x2"], d["x2"]) - F.greatest(projected["x1"], d["x1"]), F.lit(0.0))
    h = F.greatest(F.least(projected["y2"], d["y2"]) - F.greatest(projected["y1"], d["y1"]), F.lit(0.0))
    away = lambda a, b: (projected[a] + projected[b] - d[a] - d[b]) / 2
    far = F.sqrt(away("x1", "x2") * away("x1", "x2") + away("y1", "y2") * away("y1", "y2"))
    facts = F.struct(w.alias("w"), h.alias("h"), far.alias("far"), area(projected).alias("pa"), area(d).alias("ca"))

    def judged(f: Column) -> Column:
        union = f["pa"] + f["ca"] - f["w"] * f["h"]
        iou = F.when((f["w"] * f["h"] > 0) & (union > 0), f["w"] * f["h"] / union).otherwise(F.lit(0.0))
        ratio = F.when((f["pa"] > 0) & (f["ca"] > 0), f["ca"] / f["pa"])
        bad = d["excluded"] | ((d["kit"] == "WHITE") & d["reliable"]) | (f["far"] > most_distance) | ((iou < least_iou) & (f["far"] > most_distance * 0.5)) | F.coalesce((ratio < least_scale) | (ratio > most_scale), F.lit(False)) | (f["ca"] <= 1)
        score = OVERLAP_WEIGHT * iou + NEAR_WEIGHT * F.greatest(F.lit(0.0), 1 - f["far"] / most_distance) + F.when(d["kit"] == "YELLOW", SAME_KIT).when(d["kit"] == "UNKNOWN", UNKNOWN_KIT).otherwise(0.0)
        return F.when(~bad, F.struct((-F.round(score, 9)).alias("cost"), d["track"].alias("track"), d["x1"].alias("x1"), d["y1"].alias("y1"), d["x2"].alias("x2"), d["y2"].alias("y2")))

    return _let(facts, judged)


def carried(seeds: DataFrame, flow: DataFrame, detections: DataFrame, by: str, most_distance: float = 80.0, least_iou: float = 0.1, scale: tuple[float, float] = (0.5, 2.0), margin: float = 0.08, confirm: int = 3, abort: int = 5) -> DataFrame:
    """(by, frame, status, track, x1, y1, x2, y2): a row for each frame that a bridge takes, in order.

    ``seeds``: (by, x1, y1, x2, y2, vx, vy), the last sure box and its speed; ``flow``: (by, frame, reliable, dx, dy), the frames
    to take and how the picture moved; ``detections``: (by, frame, track, x1, y1, x2, y2, kit, reliable, excluded). The box is
    moved by the flow, by its speed where the flow is not reliable, and the detections are scored against it. A detection is
    picked if it is the best by ``margin`` or the only one, and then becomes the box: DETECTOR_SNAP, at the ``confirm``-th in a
    row BRIDGE_ACCEPTED, which ends the bridge. A pick without reliable flow is TARGET_UNRESOLVED and leaves the box as it
    was; without a pick the moved box goes on, TARGET_UNRESOLVED or BRIDGE_FLOW_UNRELIABLE. ``abort`` unreliable frames end the
    bridge. Ties of scores (9 digits) go to the smaller track. A bridge without frames has no row; one window's rows are
    folded as one array.
    """
    d = detections.groupBy(F.col(by).alias("_db"), F.col("frame").alias("_df")).agg(F.array_sort(F.collect_list(F.struct("track", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), "kit", "reliable", "excluded"))).alias("_ds"))
    f = flow.join(d, (F.col(by) == F.col("_db")) & (F.col("frame") == F.col("_df")), "left")
    track_type = detections.schema["track"].dataType.simpleString()
    frame_type = flow.schema["frame"].dataType.simpleString()
    none = F.array().cast(f"array<struct<track:{track_type},x1:double,y1:double,x2:double,y2:double,kit:string,reliable:boolean,excluded:boolean>>")
    frames = f.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("frame", "reliable", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), F.coalesce("_ds", none).alias("ds")))).alias("_frames"))
    s = seeds.select(F.col(by).alias("_sb"), F.struct(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).alias("_box"), F.col("vx").cast("double").alias("_vx"), F.col("vy").cast("double").alias("_vy"))
    rows = frames.join(s, F.col(by) == F.col("_sb"))
    record = f"struct<frame:{frame_type},status:string,track:{track_type},box:struct<x1:double,y1:double,x2:double,y2:double>>"
    start = F.struct(F.col("_box").alias("box"), F.lit(0).alias("run"), F.lit(0).alias("lost"), F.lit(False).alias("done"), F.array().cast(f"array<{record}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        projected = F.when(x["reliable"], _moved(acc["box"], x["dx"], x["dy"])).otherwise(_moved(acc["box"], F.col("_vx"), F.col("_vy")))

        def decided(p: Column) -> Column:
            able = F.array_sort(F.array_compact(F.transform(x["ds"], lambda c: _scored(p, c, most_distance, least_iou, *scale))))

            def chosen(a: Column) -> Column:
                clear = (F.size(a) == 1) | ((F.size(a) > 1) & (F.get(a, F.lit(1))["cost"] - F.get(a, F.lit(0))["cost"] >= margin))
                best = F.get(a, F.lit(0))
                snap = clear & x["reliable"]
                box = F.when(snap, F.struct(best["x1"].alias("x1"), best["y1"].alias("y1"), best["x2"].alias("x2"), best["y2"].alias("y2"))).when(clear, acc["box"]).otherwise(p)
                run = F.when(snap, acc["run"] + 1).otherwise(F.lit(0))
                status = F.when(snap & (run >= confirm), "BRIDGE_ACCEPTED").when(snap, "DETECTOR_SNAP").when(clear | x["reliable"], "TARGET_UNRESOLVED").otherwise("BRIDGE_FLOW_UNRELIABLE")
                lost = acc["lost"] + (~x["reliable"]).cast("int")
                made = F.struct(x["frame"].alias("frame"), status.alias("status"), F.when(snap, best["track"]).alias("track"), F.when(snap, box).otherwise(p).alias("box"))
                return F.struct(box.alias("box"), run.alias("run"), lost.alias("lost"), ((snap & (run >= confirm)) | (lost >= abort)).alias("done"), F.concat(acc["out"], F.array(made)).alias("out"))

            return _let(able, chosen)

        return F.when(acc["done"], acc).otherwise(_let(projected, decided))

    out = rows.select(by, F.explode(F.aggregate("_frames", start, step)["out"]).alias("_r"))
    return out.select(by, "_r.frame", "_r.status", "_r.track", *(F.col(f"_r.box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
