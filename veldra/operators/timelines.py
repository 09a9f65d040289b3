"""Target timelines: replay of annotation events, validation, reconstruction from decisions, interval algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "array<struct<id:bigint,start:bigint,stop:bigint>>"


def replay_events(events: DataFrame, by: str, pos: str) -> DataFrame:
    """(by, id, start, stop): the intervals that are active after all events of a target, in the order of ``pos``.

    ``events``: (by, pos, kind, id, start, stop, ref, ref2, at). add: a new interval. supersede: it takes the place of
    ``ref``. split: ``ref`` becomes id + 1 up to ``at`` - 1 and id + 2 from ``at`` on, if ``at`` lies inside. merge:
    ``ref`` and ``ref2`` become one, if the second begins where the first ends. deactivate: ``ref`` goes. Events whose
    reference isn't active change nothing. A target's events are folded as one sorted array: they are bounded by a video.
    """
    row = F.struct(F.col(pos).alias("pos"), "kind", "id", "start", "stop", "ref", "ref2", "at")
    folded = events.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_events"))
    one = lambda i, a, b: F.array(F.struct(i.cast("long").alias("id"), a.cast("long").alias("start"), b.cast("long").alias("stop")))

    def step(acc: Column, e: Column) -> Column:
        old, other = F.filter(acc, lambda x: x["id"] == e["ref"]), F.filter(acc, lambda x: x["id"] == e["ref2"])
        rest = F.filter(acc, lambda x: x["id"] != e["ref"])
        a, b = F.get(old, F.lit(0)), F.get(other, F.lit(0))
        known, new = F.size(old) > 0, one(e["id"], e["start"], e["stop"])
        inside = known & (e["at"] > a["start"]) & (e["at"] <= a["stop"])
        parts = F.concat(one(e["id"] + 1, a["start"], e["at"] - 1), one(e["id"] + 2, e["at"], a["stop"]))
        joined = known & (F.size(other) > 0) & (a["stop"] + 1 == b["start"])
        out = F.when(e["kind"] == "add", F.concat(acc, new)).when((e["kind"] == "supersede") & known, F.concat(rest, new))
        out = out.when((e["kind"] == "split") & inside, F.concat(rest, parts))
        out = out.when((e["kind"] == "merge") & joined, F.concat(F.filter(rest, lambda x: x["id"] != e["ref2"]), one(e["id"], a["start"], b["stop"])))
        return out.when(e["kind"] == "deactivate", rest).otherwise(acc)

    state = F.aggregate("_events", F.array().cast(_STATE), step)
    return folded.select(by, F.explode(state).alias("_s")).select(by, "_s.id", "_s.start", "_s.stop")


def overlapping(intervals: DataFrame, by: list[str], id_: str, start: str, stop: str) -> DataFrame:
    """(by, a, b): pairs of inclusive intervals of a group that share a frame, a < b in order of start and id."""
    a = intervals.select(*by, F.col(id_).alias("a"), F.col(start).alias("_a0"), F.col(stop).alias("_a1"))
    b = intervals.select(*by, F.col(id_).alias("b"), F.col(start).alias("_b0"), F.col(stop).alias("_b1"))
    later = (F.col("_b0") > F.col("_a0")) | ((F.col("_b0") == F.col("_a0")) & (F.col("b") > F.col("a")))
    return a.join(b, by).where(later & (F.col("_b0") <= F.col("_a1"))).select(*by, "a", "b")


def validation_errors(intervals: DataFrame, by: list[str], id_: str, start: str, stop: str, frames: int) -> DataFrame:
    """(by, id, code): range (not within 0 to frames - 1, or upside down) and overlap (with an earlier interval)."""
    bad = (F.col(start) < 0) | (F.col(stop) >= frames) | (F.col(start) > F.col(stop))
    out = intervals.where(bad).select(*by, F.col(id_).alias("id"), F.lit("range").alias("code"))
    return out.unionByName(overlapping(intervals, by, id_, start, stop).select(*by, F.col("b").alias("id"), F.lit("overlap").alias("code")).distinct())


def reconstruct(intervals: DataFrame, by: str, start: str, stop: str, frames: int) -> DataFrame:
    """(by, intervals, conflicts, gaps, gap_frames, covered, status) of each target.

    A conflict is an interval that begins before all earlier ones end; a gap lies between the end of all earlier ones
    and the next start. covered: frames in any interval. status: CONFLICT, PARTIAL (gaps, or not all frames) or COMPLETE.
    """
    w = Window.partitionBy(by).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = intervals.withColumn("_before", before)
    clash, gap = F.col(start) <= F.col("_before"), F.col(start) > F.col("_before") + 1
    fresh = F.greatest(F.col(stop) - F.greatest(F.coalesce(F.col("_before"), F.lit(-1)), F.col(start) - 1), F.lit(0))
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("intervals"), F.count_if(clash).alias("conflicts"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.col(start) - F.col("_before") - 1)), F.lit(0)).alias("gap_frames"), F.sum(fresh).alias("covered"))
    status = F.when(F.col("conflicts") > 0, "CONFLICT").when((F.col("gaps") > 0) | (F.col("covered") < frames), "PARTIAL").otherwise("COMPLETE")
    return g.withColumn("status", status)


def taxonomy(df: DataFrame, classes: dict[str, Column], frames: Column) -> DataFrame:
    """(class, n, frames) of every class, zeros included; a row may belong to several."""
    spark = df.sparkSession
    names = spark.createDataFrame([(k,) for k in classes], "class string")
    hits = df.select(frames.alias("_f"), F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in classes.items())))).alias("_c"))
    g = hits.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("frames"))
    return names.join(g, F.col("class") == F.col("_c"), "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("frames", F.lit(0)).alias("frames"))


def state_runs(df: DataFrame, by: str, order: str, state: Column) -> DataFrame:
    """(by, state, run, first, last, rows): neighbouring rows in order with the same state."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.select(by, F.col(order).alias("_o"), state.alias("state")).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("_o")))
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(by, "state").orderBy("_o")))
    g = d.groupBy(by, "state", "_g").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count(F.lit(1)).alias("rows"))
    return g.withColumn("run", F.row_number().over(Window.partitionBy(by).orderBy("first"))).drop("_g")


def run_metrics(runs: DataFrame, by: str, good: str, false: str) -> DataFrame:
    """(by, correct_runs, false_runs, longest_correct, losses, recoveries, recovery_frames) from ``state_runs``.

    A loss is a run after a correct one; a recovery is a correct run after another one that a correct one came before.
    recovery_frames: frames from the end of the last correct run to the start of the recovery, summed.
    """
    w = Window.partitionBy(by).orderBy("run")
    seen = F.max(F.when(F.col("state") == good, F.col("last"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = runs.withColumn("_seen", seen).withColumn("_was", F.lag("state").over(w))
    is_good = F.col("state") == good
    back = is_good & F.col("_seen").isNotNull()
    return d.groupBy(by).agg(F.count_if(is_good).alias("correct_runs"), F.count_if(F.col("state") == false).alias("false_runs"), F.coalesce(F.max(F.when(is_good, F.col("rows"))), F.lit(0)).alias("longest_correct"), F.count_if(~is_good & (F.col("_was") == good)).alias("losses"), F.count_if(back).alias("recoveries"), F.coalesce(F.sum(F.when(back, F.col("first") - F.col("_seen"))), F.lit(0)).alias("recovery_frames"))


def interval_deltas(old: DataFrame, new: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """(by, start, stop, delta): kept, added, removed, or extended where the same start has another stop."""
    a = old.select(*by, F.col(start).alias("start"), F.col(stop).alias("_old"))
    b = new.select(*by, F.col(start).alias("start"), F.col(stop).alias("_new"))
    both = a.join(b, [*by, "start"], "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "kept").otherwise("extended")
    return both.select(*by, "start", F.coalesce("_new", "_old").alias("stop"), kind.alias("delta"))


def split_at(intervals: DataFrame, by: list[str], start: str, stop: str, at: Column) -> DataFrame:
    """Intervals cut in two before the frame ``at`` where it lies inside: (by, part, start, stop)."""
    inside = (at > F.col(start)) & (at <= F.col(stop))
    row = lambda name, a, b: F.struct(F.lit(name).alias("part"), a.alias("start"), b.alias("stop"))
    parts = F.when(inside, F.array(row("before", F.col(start), at - 1), row("after", at, F.col(stop)))).otherwise(F.array(row("whole", F.col(start), F.col(stop))))
    return intervals.select(*by, F.explode(parts).alias("_p")).select(*by, "_p.part", "_p.start", "_p.stop")


def overlaid(intervals: DataFrame, by: str, kind: str, start: str, stop: str, priority: list[str]) -> DataFrame:
    """(by, kind, start, stop): no frame has two kinds; where several are active, the first of ``priority`` counts.

    Intervals are inclusive, may overlap and touch; neighbouring frames of one kind are one interval. Kinds that aren't in
    ``priority`` take no part. A sweep over all ends: the running number of active intervals of each kind says which
    kind a stretch has, so rows are twice as many as intervals and no frame is spelled out.
    """
    ends = F.array(F.struct(F.col(start).alias("_f"), F.lit(1).alias("_d")), F.struct((F.col(stop) + 1).alias("_f"), F.lit(-1).alias("_d")))
    rows = intervals.where(F.col(kind).isin(*priority) & (F.col(start) <= F.col(stop))).select(by, F.col(kind).alias("_k"), F.explode(ends).alias("_e"))
    change = rows.groupBy(by, F.col("_e._f").alias("_f")).agg(*(F.sum(F.when(F.col("_k") == k, F.col("_e._d")).otherwise(0)).alias(f"_d{i}") for i, k in enumerate(priority)))
    w = Window.partitionBy(by).orderBy("_f")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    active = [F.sum(f"_d{i}").over(upto) > 0 for i in range(len(priority))]
    s = change.select(by, "_f", F.coalesce(*(F.when(c, F.lit(k)) for c, k in zip(active, priority, strict=True))).alias("kind"), (F.lead("_f").over(w) - 1).alias("_to"))
    s = s.withColumn("_new", (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")).withColumn("_run", F.sum("_new").over(upto))
    return s.where("kind is not null").groupBy(by, "_run", "kind").agg(F.min("_f").alias("start"), F.max("_to").alias("stop")).select(by, "kind", "start", "stop")
