"""Order-sensitive operators: ranks, strata, transitions, runs, gaps, change points. Every order is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.storage import Scratch


def numbered(df: DataFrame, order: list[Column], into: str = "rank", sums: dict[str, str] | None = None, total: str | None = None) -> DataFrame:
    """``df`` with its row number in a complete ``order`` of the whole table, without one task for all rows.

    ``sums``: running totals {new column: summed column}, the row itself included; ``total``: a column for the number of
    rows. Rows are dealt to partitions by ranges of the order and written; counts of the partitions give each its base.
    """
    scratch, sums = Scratch(df.sparkSession, "order"), sums or {}
    # A row's place in its sorted partition is written with it: without sums nothing is shuffled or sorted again.
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_o_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_o_part", F.shiftright("_o_id", 33).cast("int")).withColumn("_o_place", F.col("_o_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    dealt = scratch.keep(placed.drop("_o_id"), "ranges")
    each = dealt.groupBy("_o_part").agg(F.count(F.lit(1)).alias("_o_n"), *(F.sum(c).alias(f"_o_s_{k}") for k, c in sums.items()))
    before = Window.orderBy("_o_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    whole = Window.partitionBy()
    base = each.select(F.col("_o_part").alias("_o_p"), F.coalesce(F.sum("_o_n").over(before), F.lit(0)).alias("_o_base"), F.sum("_o_n").over(whole).alias("_o_total"), *(F.coalesce(F.sum(f"_o_s_{k}").over(before), F.lit(0)).alias(f"_o_b_{k}") for k in sums))
    upto = Window.partitionBy("_o_part").orderBy("_o_place").rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(base), F.col("_o_part") == F.col("_o_p"))
    extra = [F.col("_o_total").alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_o_place") + F.col("_o_base")).alias(into), *((F.sum(c).over(upto) + F.col(f"_o_b_{k}")).alias(k) for k, c in sums.items()), *extra)


def independent_ranks(df: DataFrame, metrics: dict[str, tuple[str, bool]], id_: str, stratum: list[str] | None = None) -> DataFrame:
    """One rank column for each metric {name: (column, higher is better)}; nulls get no rank; ties by id."""
    out = df
    for name, (c, high) in metrics.items():
        order = [F.col(c).desc_nulls_last() if high else F.col(c).asc_nulls_last(), F.col(id_)]
        if stratum:
            out = out.withColumn(name, F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)))
        else:
            out = numbered(out, order, name)
        out = out.withColumn(name, F.when(F.col(c).isNotNull(), F.col(name)).cast("int"))
    return out


def rank_to_unit(df: DataFrame, value: str, id_: str, high: bool = True, into: str = "unit_rank") -> DataFrame:
    """(m - rank) / (m - 1) among the m rows with a value: 1 for the best, 0 for the worst; 1 if m is 1; null stays null."""
    r = numbered(df.where(F.col(value).isNotNull()), [F.col(value).desc() if high else F.col(value).asc(), F.col(id_)], "_r", total="_m")
    unit = F.when(F.col("_m") == 1, F.lit(1.0)).otherwise((F.col("_m") - F.col("_r")) / F.nullif(F.col("_m") - 1, F.lit(0)))
    known = r.withColumn(into, unit).drop("_r", "_m")
    return known.unionByName(df.where(F.col(value).isNull()).withColumn(into, F.lit(None).cast("double")))


def composite(weights: dict[str, float], penalties: dict[str, float] | None = None) -> Column:
    """Weighted mean of the unit columns that aren't null, less a penalty for each that is; null if all are."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    loss = sum((F.when(F.col(c).isNull(), F.lit(p)).otherwise(F.lit(0.0)) for c, p in (penalties or {}).items()), F.lit(0.0))
    return value / F.nullif(total, F.lit(0.0)) - loss


def position_strata(df: DataFrame, order: list[Column], cuts: list[float], into: str = "stratum") -> DataFrame:
    """Number of cuts that the relative position (rank - 1) / n has reached."""
    d = numbered(df, order, "_r", total="_m")
    share = (F.col("_r") - 1) / F.col("_m")
    return d.withColumn(into, sum((share >= c).cast("int") for c in cuts)).drop("_r", "_m")


def tiles(df: DataFrame, n: int, order: list[Column], into: str = "tile") -> DataFrame:
    """n groups in order, 1 to n; the first groups take the remainder."""
    d = numbered(df, order, "_r", total="_m")
    small, extra = F.floor(F.col("_m") / n), F.col("_m") % n
    edge = extra * (small + 1)
    tile = F.when(F.col("_r") <= edge, F.floor((F.col("_r") - 1) / (small + 1))).otherwise(extra + F.floor((F.col("_r") - edge - 1) / F.nullif(small, F.lit(0)))) + 1
    return d.withColumn(into, tile.cast("int")).drop("_r", "_m")


def timeline_bins(df: DataFrame, frame: str, bins: int, into: str = "bin") -> DataFrame:
    """Bin 0 to bins - 1 by the dense position among distinct frames; equal frames share a bin."""
    p = numbered(df.select(F.col(frame).alias("_f")).distinct(), [F.col("_f")], "_r", total="_m")
    p = p.select("_f", F.floor((F.col("_r") - 1) * bins / F.col("_m")).cast("int").alias(into))
    return df.join(p, df[frame] == p["_f"]).drop("_f")


def transitions(df: DataFrame, by: str, order: list[str | Column], values: list[str]) -> DataFrame:
    """Neighbouring rows: (by, transition, from_<v>, to_<v>)."""
    w = Window.partitionBy(by).orderBy(*order)
    nxt = F.lead(F.struct(*values)).over(w)
    out = df.withColumn("_to", nxt).withColumn("transition", F.row_number().over(w) - 1).where(F.col("_to").isNotNull())
    return out.select(by, "transition", *(F.col(v).alias(f"from_{v}") for v in values), *(F.col(f"_to.{v}").alias(f"to_{v}") for v in values))


def runs(df: DataFrame, by: list[str], frame: str, most_gap: int = 1) -> DataFrame:
    """Runs of frames that follow each other within ``most_gap``: (by, run, start, stop, frames). Repeats count once."""
    d = df.select(*by, frame).distinct()
    w = Window.partitionBy(*by).orderBy(frame)
    new = F.coalesce((F.col(frame) - F.lag(frame).over(w) > most_gap).cast("int"), F.lit(1))
    g = d.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return g.groupBy(*by, "run").agg(F.min(frame).alias("start"), F.max(frame).alias("stop"), F.count(F.lit(1)).alias("frames"))


def gaps_between(df: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """Frames between an interval and the next by (start, stop): (by, gap_start, gap_stop). No head or tail gap.

    The gap begins after the previous row's own end, not after the latest end so far.
    """
    w = Window.partitionBy(*by).orderBy(start, stop)
    d = df.withColumn("_next", F.lead(start).over(w)).where(F.col("_next") - 1 >= F.col(stop) + 1)
    return d.select(*by, (F.col(stop) + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_stop"))


def merged_intervals(df: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """Union of inclusive intervals; touching ones join: (by, start, stop)."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.coalesce((F.col(start) > before + 1).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(*by, "_g").agg(F.min(start).alias("start"), F.max(stop).alias("stop")).drop("_g")


def complement(df: DataFrame, by: list[str], start: str, stop: str, first: int, last: int) -> DataFrame:
    """What the intervals leave of first..last: (by, start, stop). Groups come from the rows."""
    m = merged_intervals(df, by, start, stop).where(f"stop >= {first} and start <= {last}")
    marks = m.select(*by, "start", "stop").unionByName(df.select(*by).distinct().select(*by, F.lit(first - 1).cast("long").alias("start"), F.lit(first - 1).cast("long").alias("stop")))
    w = Window.partitionBy(*by).orderBy("stop", "start")
    nxt = F.coalesce(F.lead("start").over(w), F.lit(last + 1))
    d = marks.withColumn("_a", F.greatest(F.col("stop") + 1, F.lit(first))).withColumn("_b", F.least(nxt - 1, F.lit(last)))
    return d.where("_a <= _b").select(*by, F.col("_a").alias("start"), F.col("_b").alias("stop"))


def change_points(df: DataFrame, by: str, order: list[str], flag: Column, support: Column, least: int) -> DataFrame:
    """First run of at least ``least`` neighbouring rows with the flag of which one has support: (by, first, last, rows).

    Neighbours are rows in order, not frames.
    """
    w = Window.partitionBy(by).orderBy(*order)
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_s", F.coalesce(support, F.lit(False))).withColumn("_i", F.row_number().over(w))
    f = d.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(by).orderBy("_i")))
    g = f.groupBy(by, "_g").agg(F.min("_i").alias("_first"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("rows"), F.bool_or("_s").alias("_ok")).where((F.col("rows") >= least) & F.col("_ok"))
    return g.groupBy(by).agg(F.min(F.struct("_first", "first", "last", "rows")).alias("m")).select(by, "m.first", "m.last", "m.rows")


def clip_window(start: Column, stop: Column, total: int, pad: int, least: int) -> tuple[Column, Column]:
    """A padded window of a least length within 0..total - 1."""
    a, b = F.greatest(start - pad, F.lit(0)), F.least(stop + pad, F.lit(total - 1))
    short = F.greatest(F.lit(least) - (b - a + 1), F.lit(0))
    a2 = F.greatest(a - F.floor(short / 2), F.lit(0))
    return a2, F.least(F.greatest(b, a2 + least - 1), F.lit(total - 1))
