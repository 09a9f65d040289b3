"""Aggregates over observation tables, vectors and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.storage import Scratch

def track_stats(df: DataFrame, track: str, frame: str) -> DataFrame:
    """Rows, distinct frames, first and last frame and span of each track; a null track is no track."""
    out = df.where(F.col(track).isNotNull()).groupBy(track).agg(F.count(F.lit(1)).alias("observations"), F.countDistinct(frame).alias("frames"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))
    return out.withColumn("span", F.col("last_frame") - F.col("first_frame") + 1)


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, min, max, mean and median of a column; nulls are left out, an empty group gives nulls."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"))


def linear_percentiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation; nulls are left out."""
    at = {}
    for k, p in points.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        at |= {f"_lo_{k}": F.floor(place) + 1, f"_hi_{k}": F.ceil(place) + 1}
    g = _at_ranks(df, value, at, by or [])
    for k, p in points.items():
        place, lo, hi = F.lit(float(p)) * (F.col("_n") - 1), F.col(f"_lo_{k}").cast("double"), F.col(f"_hi_{k}").cast("double")
        g = g.withColumn(k, F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi))
    return g.select(*(by or []), *points)


def _at_ranks(df: DataFrame, value: str, ranks: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, _n, one column a rank): the values at ranks (from 1) of each group's sorted values; ranks may name ``_n``.

    Equal values are counted first, and running counts over ranges of the values find the ranks, so no task sorts or
    holds a group. Every group has a row; without values its columns are null.
    """
    from veldra.operators.windows import numbered

    scratch = Scratch(df.sparkSession, "ranks")
    each = scratch.keep(df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k")), "values")
    upto = scratch.keep(numbered(each.where("_v is not null"), [*map(F.col, by), F.col("_v")], "_i", sums={"_upto": "_k"}).drop("_i"), "upto")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    sizes = upto.groupBy(*(F.col(c).alias(f"_g_{c}") for c in by)).agg(F.sum("_k").alias("_n"), F.min(F.col("_upto") - F.col("_k")).alias("_base"))
    mine = F.col("_upto") - F.col("_base")
    found = upto.join(sizes, same).groupBy(*by).agg(F.max("_n").alias("_n"), *(F.min(F.when(mine >= r, F.col("_v"))).alias(k) for k, r in ranks.items()))
    if not by:
        return found
    groups = each.select(*(F.col(c).alias(f"_g_{c}") for c in by)).distinct()
    return groups.join(found, same, "left").select(*(F.col(f"_g_{c}").alias(c) for c in by), "_n", *ranks)


def nearest_rank_percentiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles that are values of the column."""
    ranks = {k: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_n"))) for k, p in points.items()}
    return _at_ranks(df, value, ranks, by or []).select(*(by or []), *points)


def upper_median(values: Column) -> Column:
    """Entry n // 2 of the sorted array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def track_gaps(df: DataFrame, track: str, frame: str) -> DataFrame:
    """Per track: span, number of gaps between neighbouring frames, longest gap, coverage."""
    d = df.where(F.col(track).isNotNull()).select(track, frame).distinct()
    gap = F.lead(frame).over(Window.partitionBy(track).orderBy(frame)) - F.col(frame) - 1
    out = d.withColumn("_gap", gap).groupBy(track).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("frames"), F.count_if(F.col("_gap") > 0).alias("gaps"), F.coalesce(F.max(F.greatest("_gap", F.lit(0))), F.lit(0)).alias("longest_gap"))
    span = F.col("last_frame") - F.col("first_frame") + 1
    return out.withColumn("span", span).withColumn("coverage", F.col("frames") / span)


def l2_mean(df: DataFrame, by: list[str], vector: str, normalise_rows: bool = True) -> DataFrame:
    """(by, n, vector): mean of the rows' vectors as a unit vector; rows are made unit vectors first, or not (centroid).

    One row of sums by position for each group: partial sums are added before the shuffle, no vectors are gathered.
    """
    from veldra.functions.vectors import unit

    v = unit(F.col(vector)) if normalise_rows else F.col(vector)
    e = df.select(*by, F.posexplode(v).alias("_p", "_x"))
    mean = e.groupBy(*by, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    g = mean.groupBy(*by).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_v"))
    raw = F.transform("_v", lambda s: s["_m"])
    return g.select(*by, "n", unit(raw).alias("vector"))


def medoids(df: DataFrame, by: str, id_: str, vector: str, include_self: bool = False) -> DataFrame:
    """(by, id, mean_distance): the member with the smallest mean cosine distance to the others; ties to smaller ids.

    The sum of a member's products with all is its product with the group's sum, so members aren't paired. Vectors are
    unit vectors. ``include_self``: its own distance (0 for a unit vector) counts as well. A single member has distance 0.
    """
    from veldra.functions.vectors import dot

    sums = df.select(by, F.posexplode(vector).alias("_p", "_x")).groupBy(by, "_p").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    total = sums.groupBy(F.col(by).alias("_by")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda s: s["_s"]).alias("_total"))
    n = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    both = df.join(total.join(n, "_by"), df[by] == F.col("_by"))
    own = dot(F.col(vector), F.col(vector))
    whole = dot(F.col(vector), F.col("_total"))
    distance = 1 - whole / F.col("_n") if include_self else F.when(F.col("_n") > 1, 1 - (whole - own) / F.nullif(F.col("_n") - 1, F.lit(0))).otherwise(F.lit(0.0))
    d = both.select(F.col(by), F.col(id_).alias("id"), F.round(distance, 9).alias("mean_distance"))
    return d.groupBy(by).agg(F.min(F.struct("mean_distance", "id")).alias("m")).select(by, "m.id", "m.mean_distance")


def mad_outliers(df: DataFrame, by: list[str], value: str, times: float = 3.0) -> DataFrame:
    """``df`` with ``outlier``: below median - times * MAD of its group; never where the MAD is 0."""
    med = df.groupBy(*by).agg(F.median(value).alias("_med"))
    d = df.join(med, by)
    mad = d.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return d.join(mad, by).withColumn("outlier", (F.col("_mad") > 0) & (F.col(value) < F.col("_med") - times * F.col("_mad"))).drop("_med", "_mad")


def majority(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, value, rows, share): the most frequent value, the first seen on ties."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("_first"))
    w = Window.partitionBy(*by)
    r = F.row_number().over(w.orderBy(F.desc("rows"), "_first"))
    return c.withColumn("share", F.col("rows") / F.sum("rows").over(w)).withColumn("_r", r).where("_r = 1").drop("_r", "_first")


def largest_remainder(df: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, seats): ``total`` dealt in proportion to the weights by largest remainders; ties to smaller keys."""
    g = df.agg(F.sum(weight).alias("_all"))
    q = df.join(F.broadcast(g)).select(key, (F.lit(total) * F.col(weight) / F.nullif(F.col("_all"), F.lit(0))).alias("_q"))  # one row
    base = q.withColumn("_b", F.floor("_q")).withColumn("_rest", F.round(F.col("_q") - F.col("_b"), 12))
    left = F.lit(total) - F.sum("_b").over(Window.partitionBy())
    r = F.row_number().over(Window.orderBy(F.desc("_rest"), key))
    return base.select(key, (F.col("_b") + (r <= left).cast("long")).alias("seats"))


def union_coverage(pairs: DataFrame, by: list[str], target: str = "t_", other: str = "o_") -> DataFrame:
    """Pixels of each target box that other boxes cover together: (by, target_area, covered).

    By slabs: within the distinct x edges of the clipped boxes, the union of y ranges is added up. Whole numbers.
    """
    lo = {a: F.greatest(F.col(f"{target}{a}1"), F.col(f"{other}{a}1")) for a in "xy"}
    hi = {a: F.least(F.col(f"{target}{a}2"), F.col(f"{other}{a}2")) for a in "xy"}
    clip = pairs.select(*by, ((F.col(f"{target}x2") - F.col(f"{target}x1")) * (F.col(f"{target}y2") - F.col(f"{target}y1"))).alias("target_area"), lo["x"].alias("cx1"), lo["y"].alias("cy1"), hi["x"].alias("cx2"), hi["y"].alias("cy2"))
    real = clip.where("cx1 < cx2 and cy1 < cy2")
    edges = real.select(*by, F.explode(F.array("cx1", "cx2")).alias("x")).distinct().withColumn("x_next", F.lead("x").over(Window.partitionBy(*by).orderBy("x"))).where("x_next is not null")
    slab = edges.join(real, by).where("cx1 <= x and x_next <= cx2").select(*by, "x", "x_next", "cy1", "cy2")
    w = Window.partitionBy(*by, "x").orderBy("cy1", "cy2").rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest(F.coalesce(F.max("cy2").over(w), F.col("cy1")), F.col("cy1"))
    part = slab.withColumn("_dy", F.greatest(F.col("cy2") - top, F.lit(0))).groupBy(*by).agg(F.sum(F.col("_dy") * (F.col("x_next") - F.col("x"))).alias("covered"))
    return clip.select(*by, "target_area").distinct().join(part, by, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
