"""Retrieval, gate and tracking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators.windows import numbered


def auroc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auroc): Mann-Whitney with average ranks for ties; null without positives or negatives.

    Rows are counted by score first, so ties of any number are one row.
    """
    by = by or []
    c = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    if by:
        c = c.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        c = numbered(c, [F.col(score)], "_r", {"_upto": "_n"})
    u = c.withColumn("_u", F.col("_p") * (F.col("_upto") - F.col("_n") / 2))
    g = u.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum("_u").alias("_u"))
    return g.select(*by, "n_pos", "n_neg", (F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auroc"))


def ranking_metrics(df: DataFrame, rank: str, score: str, positive: Column, ks: list[int]) -> DataFrame:
    """One row: n, n_pos, recall at each k, mean reciprocal rank, average precision, AUROC and margin.

    Average precision is the mean over positives of hits / rank; margin is the lowest positive less the highest
    negative score.
    """
    d = numbered(df.withColumn("_p", positive).withColumn("_one", F.col("_p").cast("int")), [F.col(rank)], "_r", {"_hits": "_one"})
    n_pos = F.count_if(F.col("_p"))
    m = d.agg(
        F.count(F.lit(1)).alias("n"), n_pos.alias("n_positives"),
        *((F.count_if(F.col("_p") & (F.col(rank) <= k)) / F.nullif(n_pos, F.lit(0))).alias(f"recall_at_{k}") for k in ks),
        (1.0 / F.min(F.when(F.col("_p"), F.col(rank)))).alias("mrr"),
        (F.sum(F.when(F.col("_p"), F.col("_hits") / F.col(rank))) / F.nullif(n_pos, F.lit(0))).alias("average_precision"),
        (F.min(F.when(F.col("_p"), F.col(score))) - F.max(F.when(~F.col("_p"), F.col(score)))).alias("margin"),
    )
    return m.join(F.broadcast(auroc(df, score, positive).select("auroc")))  # one row each


def operating_points(df: DataFrame, confidence: str, outcomes: dict[str, Column]) -> DataFrame:
    """(cut, accepted, accepted_<outcome>): for each distinct confidence, rows at or above it."""
    c = df.where(F.col(confidence).isNotNull()).groupBy(F.col(confidence).alias("cut")).agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(v).alias(f"_{k}") for k, v in outcomes.items()))
    names = {"accepted": "_n"} | {f"accepted_{k}": f"_{k}" for k in outcomes}
    return numbered(c, [F.desc("cut")], "_r", names).select("cut", *names)


def lowest_safe_cut(points: DataFrame, wrong: list[str], right: str, least: int = 1) -> DataFrame:
    """One row or none: the lowest cut that accepts nothing wrong and ``least`` right rows at least."""
    safe = points.where(F.col(right) >= least)
    for w in wrong:
        safe = safe.where(F.col(w) == 0)
    return safe.orderBy("cut").limit(1)


def fixed_gate(df: DataFrame, confidence: str, cut: float, right: Column, wrong: Column, least: int) -> DataFrame:
    """One row (accepted, right, wrong, decision): fail if anything wrong is accepted, pass with ``least`` right ones."""
    d = df.where(F.col(confidence) >= cut)
    g = d.agg(F.count(F.lit(1)).alias("accepted"), F.count_if(right).alias("accepted_right"), F.count_if(wrong).alias("accepted_wrong"))
    return g.withColumn("decision", F.when(F.col("accepted_wrong") > 0, "fail").when(F.col("accepted_right") >= least, "pass").otherwise("inconclusive"))


def tracking_metrics(df: DataFrame, by: str, frame: str, truth: Column, found: Column, identity: str) -> DataFrame:
    """Per group of frames: true and false positives, misses, precision, recall, F1, losses and identity switches.

    ``truth``: the target is visible; ``found``: it is followed; ``identity``: the id that follows it. A loss is a
    followed visible frame before a visible frame without; a switch is a change of id between followed visible frames.
    """
    w = Window.partitionBy(by).orderBy(frame)
    d = df.withColumn("_t", truth).withColumn("_f", found).withColumn("_ok", F.col("_t") & F.col("_f"))
    v = d.where("_t").withColumn("_was", F.lag("_ok").over(w))
    s = d.where("_ok").withColumn("_last", F.lag(identity).over(w))
    a = d.groupBy(by).agg(F.count_if("_ok").alias("tp"), F.count_if(~F.col("_t") & F.col("_f")).alias("fp"), F.count_if(F.col("_t") & ~F.col("_f")).alias("fn"))
    b = v.groupBy(by).agg(F.count_if(F.col("_was") & ~F.col("_ok")).alias("losses"))
    c = s.groupBy(by).agg(F.count_if(F.col("_last") != F.col(identity)).alias("switches"))
    out = a.join(b, by, "left").join(c, by, "left").fillna(0, ["losses", "switches"])
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def argmax_with_ties(df: DataFrame, by: list[str], value: str, id_: str, relative: float = 1e-9) -> DataFrame:
    """(by, id, value): going by id, the value that is higher than the best so far, or close to it with a smaller id.

    Values are close if they differ by at most ``relative`` of the larger one. In the order of ids a close value never
    takes over, so the best rises only by steps that are not close. A group's rows are folded as one sorted array.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(value).cast("double").alias("value")))).alias("_rows"))
    close = lambda a, b: F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))
    best = F.aggregate("_rows", F.get("_rows", F.lit(0)), lambda acc, x: F.when((x["value"] > acc["value"]) & ~close(x["value"], acc["value"]), x).otherwise(acc))
    return rows.select(*by, best["id"].alias("id"), best["value"].alias("value"))
