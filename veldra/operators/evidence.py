"""Per-track evidence: roll-ups, frame look-ups, pockets of absence, context, bucketed choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped_fraction(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """Share of a box's area outside the frame; 0 for an empty box."""
    w = F.greatest(F.least(x2, F.lit(width)) - F.greatest(x1, F.lit(0)), F.lit(0))
    h = F.greatest(F.least(y2, F.lit(height)) - F.greatest(y1, F.lit(0)), F.lit(0))
    area = (x2 - x1) * (y2 - y1)
    return F.when(area > 0, 1 - (w * h).cast("double") / area).otherwise(F.lit(0.0))


def rollup(df: DataFrame, by: list[str], values: list[str], flags: dict[str, Column]) -> DataFrame:
    """Per group: rows, min, median, max and mean of each value, and how many rows have each flag."""
    of = [x for v in values for x in (F.min(v).alias(f"{v}_min"), F.median(v).alias(f"{v}_median"), F.max(v).alias(f"{v}_max"), F.avg(v).alias(f"{v}_mean"))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *of, *(F.count_if(c).alias(k) for k, c in flags.items()))


def mean_array(df: DataFrame, by: list[str], array: str) -> DataFrame:
    """(by, pos, mean): elementwise mean of arrays."""
    return df.select(*by, F.posexplode(array).alias("pos", "_x")).groupBy(*by, "pos").agg(F.avg(F.col("_x").cast("double")).alias("mean"))


def top_shares(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """(by, value, share, rank): the n most frequent values of a group; ties by value."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    c = c.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by)))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), value))).where(F.col("rank") <= n).select(*by, value, "share", "rank")


def sequence_summary(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, values, distinct, changes, top_change): chronological values, and the most frequent change as "a>b", ties by text."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_was", F.lag(value).over(w))
    change = F.when(F.col("_was") != F.col(value), F.concat(F.col("_was"), F.lit(">"), F.col(value)))
    lists = d.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(value).alias("_v")))), lambda x: x["_v"]).alias("values"), F.countDistinct(value).alias("distinct"), F.count(change).alias("changes"))
    top = d.withColumn("_c", change).where("_c is not null").groupBy(by, "_c").count()
    top = top.groupBy(F.col(by).alias("_by")).agg(F.min(F.struct((-F.col("count")).alias("_n"), "_c"))["_c"].alias("top_change"))
    return lists.join(top, F.col(by) == F.col("_by"), "left").drop("_by")


def frames_back(df: DataFrame, by: str, frame: str, values: list[str], back: int) -> DataFrame:
    """(by, frame, d_<value>): change against the row exactly ``back`` frames earlier; no row without one."""
    was = df.select(F.col(by).alias("_by"), (F.col(frame) + back).alias("_at"), *(F.col(v).alias(f"_{v}") for v in values))
    both = df.join(was, (F.col(by) == F.col("_by")) & (F.col(frame) == F.col("_at")))
    return both.select(by, frame, *((F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values))


def absence_pockets(df: DataFrame, by: str, frame: str, least: int) -> DataFrame:
    """(by, start, stop, frames): runs of frames, present in the table, that a track misses between two of its own.

    A pocket is counted in frames in which others are present, ``least`` at least. One that is open at the end isn't one.
    Places of the distinct frames are numbered, so that a pocket is a step of more than one place.
    """
    from veldra.operators.windows import numbered

    spine = numbered(df.select(F.col(frame).alias("_f")).distinct(), [F.col("_f")], "_i")
    own = df.select(by, frame).distinct().join(spine, F.col(frame) == F.col("_f"))
    w = Window.partitionBy(by).orderBy("_i")
    g = own.withColumn("_was", F.lag("_i").over(w)).where(F.col("_i") - F.col("_was") - 1 >= least).select(by, (F.col("_was") + 1).alias("_a"), (F.col("_i") - 1).alias("_b"))
    at = spine.select(F.col("_i").alias("_x"), F.col("_f").alias("_y"))
    first, last = at.select(F.col("_x").alias("_ax"), F.col("_y").alias("start")), at.select(F.col("_x").alias("_bx"), F.col("_y").alias("stop"))
    return g.join(first, F.col("_a") == F.col("_ax")).join(last, F.col("_b") == F.col("_bx")).select(by, "start", "stop", (F.col("_b") - F.col("_a") + 1).alias("frames"))


def absence_runs(own: DataFrame, every: DataFrame, by: str, track: str, frame: str, least: int) -> DataFrame:
    """(by, track, start, stop): runs of consecutive frames within a track's span that it misses while others are present.

    ``own``: rows of the tracks asked for; ``every``: all rows. A frame without anyone ends a run, and so does the track
    itself; runs shorter than ``least`` frames, or from the first to the last frame of one, go. Each frame of ``every``
    carries the start of its run of frames with anyone, so a run is the part of it between two frames of the track.
    """
    spine = every.select(by, frame).distinct()
    w = Window.partitionBy(by).orderBy(frame)
    island = F.sum((F.col(frame) - F.coalesce(F.lag(frame).over(w), F.col(frame) - 2) > 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spine = spine.withColumn("_i", island)
    lands = spine.groupBy(F.col(by).alias("_lb"), "_i").agg(F.min(frame).alias("_la"), F.max(frame).alias("_lz"))
    steps = own.select(by, track, frame).distinct().withColumn("_was", F.lag(frame).over(Window.partitionBy(by, track).orderBy(frame))).where(F.col(frame) - F.col("_was") > 1)
    gaps = steps.select(by, track, (F.col("_was") + 1).alias("_a"), (F.col(frame) - 1).alias("_z"))
    hit = gaps.join(lands, (F.col(by) == F.col("_lb")) & (F.col("_la") <= F.col("_z")) & (F.col("_lz") >= F.col("_a")))
    out = hit.select(by, track, F.greatest("_a", "_la").alias("start"), F.least("_z", "_lz").alias("stop"))
    return out.where(F.col("stop") - F.col("start") + 1 >= least)


def nearest_frames(df: DataFrame, by: str, frame: str, shares: list[float]) -> DataFrame:
    """(by, target, frame): the observed frame nearest to each point of a track's span, the earlier one on ties."""
    span = df.groupBy(by).agg(F.min(frame).alias("_a"), F.max(frame).alias("_b"))
    points = span.select(F.col(by).alias("_by"), F.explode(F.array(*(F.floor(F.col("_a") + s * (F.col("_b") - F.col("_a"))) for s in shares))).alias("target")).distinct()
    near = df.join(points, F.col(by) == F.col("_by")).groupBy(by, "target").agg(F.min(F.struct(F.abs(F.col(frame) - F.col("target")).alias("_d"), F.col(frame).alias("_f"))).alias("m"))
    return near.select(by, "target", F.col("m._f").alias("frame"))


def at_places(df: DataFrame, by: str, order: list[str], shares: list[tuple[int, int]]) -> DataFrame:
    """Rows at the places n * p div q of their group in order (n - 1 at most), each once: ``df`` with ``place``."""
    w = Window.partitionBy(by)
    d = df.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    spots = F.array(*(F.least(F.floor(F.col("_n") * p / q), F.col("_n") - 1) for p, q in shares))
    return d.where(F.array_contains(spots.cast("array<int>"), F.col("place"))).drop("_n")


def buckets_then_fill(df: DataFrame, by: str, bucket: Column, order: list[Column], k: int) -> DataFrame:
    """``df`` with ``selection_rank`` up to k: the best of each bucket first, by bucket, then the best of the rest."""
    first = F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order))
    d = df.withColumn("_b", bucket).withColumn("_first", (first == 1).cast("int"))
    turn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_first"), F.when(F.col("_first") == 1, F.col("_b")), *order))
    return d.withColumn("selection_rank", turn).where(F.col("selection_rank") <= k).drop("_b", "_first")


def containing_box(points: DataFrame, boxes: DataFrame, on: list[str], x: str, y: str, id_: str) -> DataFrame:
    """``points`` with the smallest box of columns x1, y1, x2, y2 around each (``box``), ties to smaller ids; null without one."""
    b = boxes.select(*on, F.struct(((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("_area"), F.col(id_).alias("_id")).alias("_b"), "x1", "y1", "x2", "y2")
    inside = (F.col(x) >= F.col("x1")) & (F.col(x) < F.col("x2")) & (F.col(y) >= F.col("y1")) & (F.col(y) < F.col("y2"))
    best = points.select(*on, x, y).distinct().join(b, on).where(inside).groupBy(*on, x, y).agg(F.min("_b")["_id"].alias("box"))
    return points.join(best, [*on, x, y], "left")


def relative_flag(df: DataFrame, value: str, share: float, flag: str) -> DataFrame:
    """``df`` with a flag for values under ``share`` of the median of all."""
    return df.join(F.broadcast(df.agg(F.median(value).alias("_m"))), how="cross").withColumn(flag, F.col(value) < F.col("_m") * share).drop("_m")  # one row


def ordering_counts(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row (greater, tie, less): pairs of a positive and a negative by their scores, from counts of each score."""
    from veldra.operators.windows import numbered

    c = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    d = numbered(c, [F.col(score)], "_r", {"_upto": "_n"})
    all_n = F.sum("_n")
    return d.agg(F.sum(F.col("_p") * (F.col("_upto") - F.col("_n"))).alias("greater"), F.sum(F.col("_p") * F.col("_n")).alias("tie"), (F.sum("_p") * all_n - F.sum(F.col("_p") * F.col("_upto"))).alias("less"))


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row (n_pos, auprc): the sum over score cuts of precision times the gain in recall; equal scores are one cut."""
    from veldra.operators.windows import numbered

    c = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(positive).alias("_p"), F.count(F.lit(1)).alias("_n"))
    d = numbered(c, [F.desc(score)], "_r", {"_tp": "_p", "_all": "_n"})
    return d.agg(F.sum("_p").alias("n_pos"), (F.sum(F.col("_p") * F.col("_tp") / F.col("_all")) / F.nullif(F.sum("_p"), F.lit(0))).alias("auprc"))
