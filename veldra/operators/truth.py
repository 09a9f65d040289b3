"""Ground truth of a target and how a tracker's observations compare with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions.geometry import Box, iou

#: States of the target, and the least overlap of a match.
ASSOCIATED, MISSED, WRONG = "TARGET_VISIBLE_ASSOCIATED", "TARGET_VISIBLE_BUT_MISSED", "WRONG_TARGET_ASSIGNED"
UNCERTAIN, OCCLUDED, OUT = "TARGET_UNCERTAIN", "TARGET_OCCLUDED", "TARGET_OUT_OF_FRAME"
MATCH_IOU = 0.5
NOT_MEASURABLE = "NOT_MEASURABLE_WITHOUT_ACCEPTED_GROUND_TRUTH"


def acceptance(events: DataFrame, by: str, pos: str, kind: str, accept: str = "accept", silent: tuple[str, ...] = ()) -> DataFrame:
    """(by, revision, accepted, accepted_pos) after an annotation log: every event but ``silent`` ones is a revision; one
    acceptance lasts, the last one is named. Nothing that follows takes it back."""
    counted = ~F.col(kind).isin(*silent) if silent else F.lit(True)
    return events.groupBy(by).agg(F.count_if(counted).alias("revision"), F.coalesce(F.bool_or(F.col(kind) == accept), F.lit(False)).alias("accepted"), F.max(F.when(F.col(kind) == accept, F.col(pos))).alias("accepted_pos"))


def truth_frames(truth: DataFrame, by: str) -> DataFrame:
    """(by, frame, state, ids) of each frame that an active interval covers; where several do, the one that starts last (then the greatest id) counts.

    ``truth``: (by, id, start, stop, state, ids) with the ids of the tracks that are, or for wrong assignments are not, the target.
    """
    f = truth.select(by, F.explode(F.sequence("start", "stop")).alias("frame"), F.struct("start", "id", "state", "ids").alias("_i"))
    return f.groupBy(by, "frame").agg(F.max_by("_i", F.struct("_i.start", "_i.id")).alias("_i")).select(by, "frame", "_i.state", "_i.ids")


def scored_frames(frames: DataFrame, boxes: DataFrame, observations: DataFrame, by: str) -> DataFrame:
    """(by, frame, state, track, outcome) of each frame of the truth.

    ``boxes``: (by, frame, x1, y1, x2, y2) of the target; ``observations``: the same with track. The match is the
    observation with the greatest overlap, MATCH_IOU at least, the smallest track on ties. outcome: correct, false or
    missed; excluded where the target is uncertain, occluded or out of frame. An associated target that another track
    claims is false, one without known tracks missed; a target that was missed or wrongly assigned is false if those
    tracks, or any, claim it.
    """
    b = boxes.select(F.col(by).alias("_bk"), F.col("frame").alias("_bf"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    o = observations.select(F.col(by).alias("_ok"), F.col("frame").alias("_of"), "track", *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    overlap = iou(Box.of("b_"), Box.of("o_"))
    near = b.join(o, (F.col("_bk") == F.col("_ok")) & (F.col("_bf") == F.col("_of"))).select("_bk", "_bf", "track", overlap.alias("_iou")).where(F.col("_iou") >= MATCH_IOU)
    best = near.groupBy("_bk", "_bf").agg(F.min(F.struct((-F.col("_iou")).alias("_n"), "track"))["track"].alias("track"))
    d = frames.join(best, (F.col(by) == F.col("_bk")) & (F.col("frame") == F.col("_bf")), "left").drop("_bk", "_bf")
    claimed = F.col("track").isNotNull()
    own = F.coalesce(F.array_contains("ids", F.col("track")), F.lit(False))
    empty = F.coalesce(F.size("ids"), F.lit(0)) <= 0
    outcome = F.when(F.col("state") == ASSOCIATED, F.when(own, "correct").when(claimed & ~empty, "false").otherwise("missed"))
    outcome = outcome.when(F.col("state") == MISSED, F.when(claimed, "false").otherwise("missed"))
    outcome = outcome.when(F.col("state") == WRONG, F.when(own, "false").when(claimed, "correct").otherwise("missed")).otherwise("excluded")
    return d.select(by, "frame", "state", "ids", "track", outcome.alias("outcome"))


def target_metrics(scored: DataFrame, accepted: DataFrame, by: str, fps: float) -> DataFrame:
    """Metrics of each target in ``accepted`` (by, accepted) against its truth.

    Excluded frames neither end nor begin a run. A false event begins at a false frame unless the last frame that was
    false, missed or rightly taken back (correct under a wrong assignment) was false too: correct frames of an associated
    target don't end it. A loss begins at the first frame that isn't correct and lasts until the next correct one; that
    takes the recovery time. A switch is a change of track between neighbouring correct frames that the truth doesn't
    explain: the later frame is associated and the earlier track isn't one of its tracks. Without acceptance, or without
    frames, the numbers are null; status says which.
    """
    w = Window.partitionBy(by).orderBy("frame")
    s = scored.where("outcome <> 'excluded'")
    correct, false = F.col("outcome") == "correct", F.col("outcome") == "false"
    marks = F.when(false, 1).when((F.col("outcome") == "missed") | (F.col("state") == WRONG), 0)  # null: the frame changes nothing
    s = s.withColumn("_was_false", F.last(marks, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_was", F.lag("outcome").over(w)).withColumn("_track", F.lag("track").over(w))
    s = s.withColumn("_lost", ~correct & (F.coalesce(F.col("_was"), F.lit("correct")) == "correct"))
    s = s.withColumn("_run", F.sum((~correct).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_lost_at", F.last(F.when(F.col("_lost"), F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = correct & F.coalesce(F.col("_was") != "correct", F.lit(False))
    switch = correct & (F.col("_was") == "correct") & (F.col("track") != F.col("_track")) & (F.col("state") == ASSOCIATED) & ~F.array_contains("ids", F.col("_track"))
    longest = s.where(correct).groupBy(F.col(by).alias("_lk"), "_run").count().groupBy("_lk").agg(F.max("count").alias("_longest"))
    g = s.groupBy(F.col(by).alias("_gk")).agg(
        F.count(F.lit(1)).alias("visible_frames"), F.count("track").alias("claimed_frames"), F.count_if(correct).alias("correct_frames"), F.count_if(false).alias("false_frames"), F.count_if(F.col("outcome") == "missed").alias("missed_frames"),
        F.count_if(false & (F.coalesce(F.col("_was_false"), F.lit(0)) == 0)).alias("false_assignments"), F.count_if("_lost").alias("losses"), F.count_if(switch).alias("false_switches"), F.count_if(back).alias("recoveries"),
        (F.avg(F.when(back, F.col("frame") - F.col("_lost_at"))) / fps).alias("recovery_mean_sec"), (F.max(F.when(back, F.col("frame") - F.col("_lost_at"))) / fps).alias("recovery_max_sec"), F.count_distinct("track").alias("fragmentation"),
    )
    state = {UNCERTAIN: "uncertain_frames", OCCLUDED: "occluded_frames", OUT: "out_of_frame_frames"}
    rest = scored.groupBy(F.col(by).alias("_rk")).agg(*(F.count_if(F.col("state") == k).alias(v) for k, v in state.items()), (F.max("frame") + 1).alias("_frames"))
    out = accepted.select(by, "accepted").join(rest, F.col(by) == F.col("_rk"), "left").join(g, F.col(by) == F.col("_gk"), "left").join(longest, F.col(by) == F.col("_lk"), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = ratio(n("correct_frames"), n("claimed_frames")), ratio(n("correct_frames"), n("visible_frames"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    minutes = F.col("_frames") / fps / 60
    numbers = {c: n(c) for c in ("visible_frames", "claimed_frames", "correct_frames", "false_frames", "missed_frames", "false_assignments", "losses", "false_switches", "recoveries", "fragmentation", *state.values())}
    numbers |= {"longest_correct": n("_longest"), "recovery_mean_sec": F.col("recovery_mean_sec"), "recovery_max_sec": F.col("recovery_max_sec"), "precision": precision, "recall": recall, "f1": f1, "interventions_per_minute": ratio(n("false_assignments") + n("losses"), minutes)}
    ok = F.col("accepted") & F.col("_frames").isNotNull()
    status = F.when(~F.col("accepted"), NOT_MEASURABLE).when(F.col("_frames").isNull(), "no_frames").otherwise("ok")
    return out.select(by, status.alias("status"), *(F.when(ok, c).alias(k) for k, c in numbers.items()))
