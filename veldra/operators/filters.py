"""Filters that say why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.geometry import Box, clamped

Rules = list[tuple[str, Column]]


def first_reason(rules: Rules) -> Column:
    """The first rule, in order, whose condition holds (null counts as not); null if none does."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def all_reasons(rules: Rules) -> Column:
    """Array of all rules whose condition holds, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)), lambda r: r.isNotNull())


def with_first_reason(df: DataFrame, rules: Rules, into: str = "reject_reason") -> DataFrame:
    return df.withColumn(into, first_reason(rules))


def reason_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """(reason, rows): 'kept' for rows without a reason, and each rule that was first for some row."""
    return df.groupBy(F.coalesce(first_reason(rules), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def sanitized_boxes(df: DataFrame, width: int, height: int, confidence: str = "confidence") -> DataFrame:
    """Boxes cut to the frame; empty ones and confidences outside 0 to 1 go."""
    b = clamped(Box.of(), width, height)
    return df.withColumns({"x1": b.x1, "y1": b.y1, "x2": b.x2, "y2": b.y2}).where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")) & F.col(confidence).between(0, 1))


def excluded_by_keys(df: DataFrame, exclusions: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``df`` with ``exclusion_reason``: the first of (reason, column, keys) whose keys hold the row's value."""
    out, marks = df, []
    for i, (reason, column, keys) in enumerate(exclusions):
        k = keys.select(F.col(keys.columns[0]).alias(f"_k{i}")).distinct()
        out = out.join(k, out[column] == k[f"_k{i}"], "left")
        marks.append((reason, F.col(f"_k{i}").isNotNull()))
    return out.withColumn("exclusion_reason", first_reason(marks)).drop(*(f"_k{i}" for i in range(len(exclusions))))
