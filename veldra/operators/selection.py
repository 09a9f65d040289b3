"""Ranked and constrained selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_with_gap(df: DataFrame, by: str, order: list[Column], frame: str, k: int, gap: int, keep: list[str]) -> DataFrame:
    """Per group the first k rows in order that are at least ``gap`` frames from every row chosen before.

    The rows of a group are folded as one sorted array of (rank, frame, kept columns): a track is bounded by its video.
    """
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.withColumn("_r", F.row_number().over(w)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col(frame).alias("_f"), *(F.col(c).alias(c) for c in keep)))).alias("_rows"))
    chosen = F.aggregate("_rows", F.slice(F.col("_rows"), 1, 0), lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda c: F.abs(c["_f"] - x["_f"]) < gap), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select(by, F.posexplode(chosen).alias("_p", "_x")).select(by, (F.col("_p") + 1).alias("selection_rank"), *(F.col(f"_x.{c}").alias(c) for c in keep))


def uniform_sample(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """Rows at positions round_half_even(i * (n - 1) / (k - 1)); all rows if there are at most k."""
    w = Window.partitionBy(by)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return d.where((F.col("_n") <= k) | F.array_contains(spots, F.col("_i").cast("int"))).drop("_n").withColumnRenamed("_i", "position")


def capped_quotas(df: DataFrame, cls: str, segment: str, order: list[Column], per_segment: int, quota: int) -> DataFrame:
    """At most ``per_segment`` rows of a class and segment, then at most ``quota`` of the class, in order."""
    a = df.withColumn("_s", F.row_number().over(Window.partitionBy(cls, segment).orderBy(*order))).where(F.col("_s") <= per_segment)
    return a.withColumn("selection_rank", F.row_number().over(Window.partitionBy(cls).orderBy(*order))).where(F.col("selection_rank") <= quota).drop("_s")


def best_with_margin(df: DataFrame, by: str, cost: str, id_: str, most_cost: float, least_margin: float) -> DataFrame:
    """(by, best, cost, margin, decision): accepted if the best is cheap enough and far enough before the second.

    One candidate alone has a null margin and needs only the cost bound.
    """
    w = Window.partitionBy(by).orderBy(cost, id_)
    d = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    g = d.groupBy(by).agg(F.max(F.when(F.col("_r") == 1, F.col(id_))).alias("best"), F.max(F.when(F.col("_r") == 1, F.col(cost))).alias("cost"), F.max(F.when(F.col("_r") == 2, F.col(cost))).alias("_second"))
    margin = F.col("_second") - F.col("cost")
    rule = F.when(F.col("cost") > most_cost, "unresolved").when(margin.isNull() | (margin >= least_margin), "accepted").otherwise("review")
    return g.select(by, "best", "cost", margin.alias("margin"), rule.alias("decision"))


def review_groups(df: DataFrame, rank_by: dict[str, Column], id_: str, n: int) -> DataFrame:
    """(review_group, position, id): the top and the bottom n rows of each named metric; nulls take no part."""
    out = None
    for name, metric in rank_by.items():
        d = df.select(F.col(id_).alias("id"), metric.alias("_m")).where("_m is not null")
        for side, order in (("top", F.desc("_m")), ("bottom", F.asc("_m"))):
            few = d.orderBy(order, "id").limit(n)  # each task keeps n rows; the rank is over those alone
            part = few.withColumn("position", F.row_number().over(Window.orderBy(order, "id"))).select(F.lit(f"{name}_{side}").alias("review_group"), "position", "id")
            out = part if out is None else out.unionByName(part)
    return out


def diverse_allocation(df: DataFrame, id_: str, order: list[str], caps: dict[str, int], k: int) -> DataFrame:
    """(id, position): the first k rows in order of which no value of a capped column occurs more often than its cap.

    Each row depends on all before it, so one group function walks them. Of the rows with the same values in all capped
    columns only the first can be chosen, as many as the smallest cap, so no others reach it: the walk is bounded by the
    number of such combinations.
    """
    import pandas as pd

    cols = list(caps)
    first = Window.partitionBy(*cols).orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= min([k, *caps.values()])).drop("_r")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        out = []
        for row in pdf.sort_values(order).itertuples(index=False):
            keys = [(c, getattr(row, c)) for c in cols]
            if len(out) < k and all(used.get(x, 0) < caps[x[0]] for x in keys):
                out.append(getattr(row, id_))
                for x in keys:
                    used[x] = used.get(x, 0) + 1
        return pd.DataFrame({"id": pd.Series(out, dtype="int64"), "position": pd.Series(range(1, len(out) + 1), dtype="int64")})

    return df.select(*dict.fromkeys([id_, *order, *cols])).groupBy().applyInPandas(walk, "id long, position long")


def suppressed_choice(df: DataFrame, by: str, id_: str, bucket: str, buckets: list[str], order: list[Column], frame: str, bits: str, most: int, gap: int, hamming: int) -> DataFrame:
    """(by, selected, suppressed_gap, suppressed_duplicate): ids chosen in order of their frames, at most ``most``.

    First the best row of each bucket, in the order of ``buckets``, then the best of the rest, as long as a row is at
    least ``gap`` frames from every chosen one and more than ``hamming`` bits from each; rows that fail are counted by
    the first reason, a gap before a duplicate, for each pass in which they fail. Rows with a frame that the first pass
    chose take no part in the second. A group's rows are folded as one sorted array: they are bounded by a video.
    """
    place = F.lit(len(buckets))
    for i, b in reversed(list(enumerate(buckets))):
        place = F.when(F.col(bucket) == b, i).otherwise(place)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    d = df.select(by, F.col(id_).alias("id"), place.alias("place"), F.col(frame).alias("frame"), F.col(bits).alias("bits"), rank.alias("rank"))
    rows = d.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "place", "id", "frame", "bits"))).alias("_rows"))
    first = F.array_sort(F.transform(F.filter("_rows", lambda x: x["place"] < len(buckets)), lambda x: F.struct(x["place"].alias("place"), x["rank"].alias("rank"), x["id"].alias("id"), x["frame"].alias("frame"), x["bits"].alias("bits"))))

    def taken(acc: Column, x: Column, bucket_once: bool, free: Column) -> Column:
        # The first chosen row in conflict gives the reason.
        clash = F.filter(acc["chosen"], lambda c: (F.abs(c["frame"] - x["frame"]) < gap) | (F.bit_count(c["bits"].bitwiseXOR(x["bits"])) <= hamming))
        why_gap = F.abs(F.get(clash, F.lit(0))["frame"] - x["frame"]) < gap
        done = (F.size(acc["chosen"]) >= most) | ~free
        if bucket_once:
            done = done | F.exists(acc["chosen"], lambda c: c["place"] == x["place"])
        new = F.concat(acc["chosen"], F.array(F.struct(x["id"].alias("id"), x["frame"].alias("frame"), x["bits"].alias("bits"), x["place"].alias("place"))))
        hit = F.size(clash) > 0
        state = lambda chosen, g, n: F.struct(chosen.alias("chosen"), g.alias("gap"), n.alias("dup"))
        return F.when(done, acc).when(hit & why_gap, state(acc["chosen"], acc["gap"] + 1, acc["dup"])).when(hit, state(acc["chosen"], acc["gap"], acc["dup"] + 1)).otherwise(state(new, acc["gap"], acc["dup"]))

    kinds = {c: df.schema[n].dataType.simpleString() for c, n in (("id", id_), ("frame", frame), ("bits", bits))}
    empty = F.struct(F.array().cast(f"array<struct<id:{kinds['id']},frame:{kinds['frame']},bits:{kinds['bits']},place:int>>").alias("chosen"), F.lit(0).alias("gap"), F.lit(0).alias("dup"))
    rows = rows.withColumn("_one", F.aggregate(first, empty, lambda acc, x: taken(acc, x, True, F.lit(True))))
    both = F.aggregate("_rows", F.col("_one"), lambda acc, x: taken(acc, x, False, ~F.exists(F.col("_one.chosen"), lambda c: c["frame"] == x["frame"])))
    rows = rows.select(by, both.alias("_s"))
    sorted_ = F.array_sort(F.transform("_s.chosen", lambda c: F.struct(c["frame"].alias("frame"), c["id"].alias("id"))))
    return rows.select(by, F.transform(sorted_, lambda c: c["id"]).alias("selected"), F.col("_s.gap").cast("long").alias("suppressed_gap"), F.col("_s.dup").cast("long").alias("suppressed_duplicate"))


def spaced_windows(windows: DataFrame, by: str, order: list[str], center: str, apart: int, most: int) -> DataFrame:
    """``windows`` with ``position``: in order, those whose center is at least ``apart`` frames from every one kept before, at most ``most``.

    A group's windows are folded as one sorted array; callers bound them by a budget.
    """
    names = windows.columns
    row = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in names if c not in order))
    g = windows.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kept = F.aggregate("_rows", F.slice(F.col("_rows"), 1, 0), lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda c: F.abs(c[center] - x[center]) < apart), acc).otherwise(F.concat(acc, F.array(x))))
    return g.select(F.posexplode(kept).alias("_p", "_x")).select(*(F.col(f"_x.{c}").alias(c) for c in names), (F.col("_p") + 1).alias("position"))


def failure_windows(observations: DataFrame, by: str, selected: DataFrame, most: int, reach: int, least_absence: int, apart: int) -> DataFrame:
    """(by, track, kind, center, other, position): windows to look at around a selected track's end.

    ``observations``: (by, track, frame, x1, y1, x2, y2), one for each track and frame; ``selected``: (by, track), any
    number. Candidates in this order: the track's last frame; the first frames of other tracks within ``reach`` frames
    after it, nearest centre first, ``most`` - 1 of them; the middles of pockets in which the track is absent for
    ``least_absence`` frames or more while others are present, in order, until there are ``most``. Then a window less than
    ``apart`` frames from one before it goes.
    """
    from veldra.operators.evidence import absence_runs
    from veldra.operators.joins import range_join

    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    o = observations.select(by, "track", "frame", middle("x1", "x2").alias("cx"), middle("y1", "y2").alias("cy"))
    own = o.join(selected.select(F.col(by).alias("_sb"), F.col("track").alias("_st")).distinct(), (F.col(by) == F.col("_sb")) & (F.col("track") == F.col("_st"))).drop("_sb", "_st")
    ends = own.groupBy(by, "track").agg(F.max(F.struct("frame", "cx", "cy")).alias("_e")).select(by, "track", F.col("_e.frame").alias("lost"), F.col("_e.cx").alias("_px"), F.col("_e.cy").alias("_py"))
    left = ends.withColumn("_lo", F.col("lost") + 1).withColumn("_hi", F.col("lost") + reach)
    right = o.select(by, F.col("track").alias("other"), "cx", "cy", F.col("frame").alias("_f"), F.col("frame").alias("_g"))
    seen = range_join(left, right, [by], ("_lo", "_hi"), ("_f", "_g"), reach).where("other <> track")
    births = seen.groupBy(by, "track", "other").agg(F.min(F.struct(F.col("_f").alias("frame"), F.sqrt((F.col("cx") - F.col("_px")) ** 2 + (F.col("cy") - F.col("_py")) ** 2).alias("far"))).alias("_m"))
    rank = F.row_number().over(Window.partitionBy(by, "track").orderBy(F.round("_m.far", 9), "_m.frame", "other"))
    near = births.withColumn("_r", rank).where(F.col("_r") < most)
    pockets = absence_runs(own, o, by, "track", "frame", least_absence)
    later = F.row_number().over(Window.partitionBy(by, "track").orderBy("start"))
    pockets = pockets.withColumn("_r", later).where(F.col("_r") <= most)  # more never fit the budget
    none = F.lit(None).cast(observations.schema["track"].dataType)
    w = ends.select(by, "track", F.lit(0).alias("_k"), F.lit(0).alias("_r"), F.lit("selected_raw_track_end").alias("kind"), F.col("lost").alias("center"), none.alias("other"))
    w = w.unionByName(near.select(by, "track", F.lit(1).alias("_k"), "_r", F.lit("nearby_new_track_birth").alias("kind"), F.col("_m.frame").alias("center"), "other"))
    w = w.unionByName(pockets.select(by, "track", F.lit(2).alias("_k"), "_r", F.lit("selected_track_absence").alias("kind"), F.floor((F.col("start") + F.col("stop")) / 2).alias("center"), none.alias("other")))
    w = w.withColumn("_turn", F.row_number().over(Window.partitionBy(by, "track").orderBy("_k", "_r")))
    # The budget counts all windows up to and with the first pocket that reaches it.
    w = w.where((F.col("_k") < 2) | (F.col("_turn") <= most)).withColumn("_key", F.struct(by, "track"))
    return spaced_windows(w, "_key", ["_k", "_r"], "center", apart, most).select(by, "track", "kind", "center", "other", "position")


#: Areas at which the size class rises.
SIZE_CLASSES = (2000, 6000, 15000)


def quality_temporal_choice(df: DataFrame, by: str, id_: str, frame: str, edge: str, overlap: str, area: str, sharp: str, most: int, least: int) -> DataFrame:
    """(by, id, frame, selection_rank): at most ``most`` rows of each group, good and spread over its frames; ``least`` if there are so many.

    Better is: fewer edges, less overlap, a larger area, a lower size class, sharper, earlier, a smaller id. For evenly spaced
    places among the rows, the best unused row near the place (in places or frames) is picked, or the best unused one if
    none is near. Of neighbours closer than a third of the spacing the better one stays. What is missing is filled by
    the best of the rest that keep that distance, and up to ``least`` without it. A group's rows are folded as one array.
    """
    size = sum((F.col(area) >= c).cast("int") for c in SIZE_CLASSES)
    row = F.struct(F.col(frame).cast("long").alias("frame"), F.col(id_).alias("id"), F.col(edge).cast("long").alias("k1"), F.col(overlap).cast("double").alias("k2"), (-F.col(area)).cast("double").alias("k3"), size.alias("k4"), (-F.col(sharp)).cast("double").alias("k5"))
    names = ("k1", "k2", "k3", "k4", "k5", "frame", "id")
    g = df.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    g = g.withColumn("_r", F.transform("_r", lambda x, j: F.struct(*(x[k].alias(k) for k in names), j.cast("long").alias("j"))))
    n, first, last = F.size("_r"), F.get("_r", F.lit(0))["frame"], F.element_at("_r", -1)["frame"]
    target = F.least(F.lit(most), n)
    g = g.withColumn("_k", target).withColumn("_span", last - first)
    up = lambda a: F.greatest(F.lit(1).cast("long"), F.ceil(a / (2 * F.col("_k"))))
    g = g.withColumn("_w", up(F.col("_span"))).withColumn("_iw", up(F.size("_r")))
    g = g.withColumn("_gap", F.when(F.col("_span") > 0, F.greatest(F.lit(1).cast("long"), F.floor(F.col("_span") / (3 * F.col("_k"))))).otherwise(F.lit(1).cast("long")))
    slots = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.bround(i * (F.size("_r") - 1) / F.greatest(F.lit(1), F.col("_k") - 1).cast("double")).cast("int"))
    unused = lambda acc: F.filter("_r", lambda x: ~F.exists(acc, lambda p: p["j"] == x["j"]))

    def pick(acc: Column, s: Column) -> Column:
        at = F.get("_r", s)["frame"]
        near = F.filter(unused(acc), lambda x: (F.abs(x["j"] - s) <= F.col("_iw")) | (F.abs(x["frame"] - at) <= F.col("_w")))
        return F.concat(acc, F.array(F.coalesce(F.array_min(near), F.array_min(unused(acc)))))

    none = F.slice(F.col("_r"), 1, 0)
    g = g.withColumn("_p", F.aggregate(slots, none, pick))
    ordered = F.array_sort(F.transform("_p", lambda x, i: F.struct(x["frame"].alias("f"), i.alias("i"), x.alias("x"))))

    def thin(acc: Column, o: Column) -> Column:
        x, prev = o["x"], F.element_at(acc, -1)
        close = (F.size(acc) > 0) & (F.abs(x["frame"] - F.when(F.size(acc) > 0, prev["frame"])) < F.col("_gap"))
        return F.when(close & (x < prev), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).when(close, acc).otherwise(F.concat(acc, F.array(x)))

    g = g.withColumn("_f", F.aggregate(ordered, none, lambda acc, o: F.when(F.size(acc) == 0, F.array(o["x"])).otherwise(thin(acc, o))))
    rest = F.array_sort(unused(F.col("_f")))
    spaced = F.aggregate(rest, F.col("_f"), lambda acc, x: F.when((F.size(acc) >= F.col("_k")) | F.exists(acc, lambda p: F.abs(p["frame"] - x["frame"]) < F.col("_gap")), acc).otherwise(F.concat(acc, F.array(x))))
    g = g.withColumn("_g", spaced)
    filled = F.aggregate(F.array_sort(unused(F.col("_g"))), F.col("_g"), lambda acc, x: F.when(F.size(acc) >= F.least(F.lit(least), F.size("_r")), acc).otherwise(F.concat(acc, F.array(x))))
    out = g.select(by, F.posexplode(F.array_sort(F.transform(filled, lambda x: F.struct(x["frame"].alias("frame"), x["id"].alias("id"))))).alias("_i", "_x"), "_k").where(F.col("_i") < F.col("_k"))
    return out.select(by, "_x.id", "_x.frame", F.col("_i").alias("selection_rank"))
