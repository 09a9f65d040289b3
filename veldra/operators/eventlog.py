"""Append-only logs with ``log_pos``: effective decisions, states, approvals, replay, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_decisions(log: DataFrame, event: str, decision: str, revision: str, supersedes: str, pos: str = "log_pos") -> DataFrame:
    """The decision of each event with the highest revision that no other supersedes; the first in the log on ties."""
    gone = log.select(F.col(supersedes).alias("_gone")).where("_gone is not null").distinct()
    heads = log.join(gone, log[decision] == gone["_gone"], "left_anti")
    w = Window.partitionBy(event).orderBy(F.desc(revision), pos)
    return heads.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def review_states(events: DataFrame, heads: DataFrame, event: str, action: str, states: dict[str, str], none: str = "UNREVIEWED", other: str = "OPEN") -> DataFrame:
    """(event, state): the state of the effective action; ``none`` without a decision."""
    h = heads.select(F.col(event).alias("_e"), F.col(action).alias("_a"))
    state = F.lit(other)
    for a, s in reversed(list(states.items())):
        state = F.when(F.col("_a") == a, s).otherwise(state)
    return events.select(event).join(h, F.col(event) == F.col("_e"), "left").select(event, F.when(F.col("_a").isNull(), none).otherwise(state).alias("state"))


def active_approvals(log: DataFrame, key: str, status: str, approved: str, pos: str = "log_pos") -> DataFrame:
    """The last row of each key in log order, if its status is ``approved``."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), pos).alias("_l"))
    return last.select(key, "_l.*").where(F.col(status) == approved)


def revision_violations(log: DataFrame, event: str, revision: str, pos: str = "log_pos") -> DataFrame:
    """Rows whose revision isn't higher than all before it in the event's log: (event, log_pos, revision, highest)."""
    w = Window.partitionBy(event).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("highest", F.max(revision).over(w)).where(F.col(revision) <= F.col("highest")).select(event, pos, revision, "highest")


def broken_supersessions(log: DataFrame, decision: str, event: str, supersedes: str, pos: str = "log_pos") -> DataFrame:
    """Rows that supersede a decision that is missing, later in the log, or of another event: (decision, code)."""
    p = log.select(F.col(decision).alias("_d"), F.col(event).alias("_e"), F.col(pos).alias("_p"))
    both = log.where(F.col(supersedes).isNotNull()).join(p, F.col(supersedes) == p["_d"], "left")
    code = F.when(F.col("_d").isNull(), "missing").when(F.col("_e") != F.col(event), "other_event").when(F.col("_p") >= F.col(pos), "later")
    return both.select(decision, code.alias("code")).where("code is not null")


def replay(actions: DataFrame, key: str, kind: str, removing: str, pos: str = "log_pos") -> DataFrame:
    """State after all actions: the last one of each key, if it isn't a removal; an id added again is active again."""
    last = actions.groupBy(key).agg(F.max_by(F.struct(*[c for c in actions.columns if c != key]), pos).alias("_l"))
    return last.select(key, "_l.*").where(F.col(kind) != removing)


def timeline_coverage(intervals: DataFrame, by: str, status: str, start: str, stop: str, total_frames: int, statuses: list[str]) -> DataFrame:
    """Frames and share of each status, and of all together; inclusive intervals that don't overlap."""
    n = F.col(stop) - F.col(start) + 1
    sums = [F.coalesce(F.sum(F.when(F.col(status) == s, n)), F.lit(0)).alias(f"{s}_frames") for s in statuses]
    out = intervals.groupBy(by).agg(*sums, F.sum(n).alias("covered_frames"), F.count(F.lit(1)).alias("intervals"))
    return out.withColumn("coverage", F.col("covered_frames") / F.lit(float(total_frames)))


def next_revision(log: DataFrame, event: str, revision: str) -> DataFrame:
    return log.groupBy(event).agg((F.coalesce(F.max(revision), F.lit(0)) + 1).alias("next_revision"))


def source_class(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The class of the first rule that holds."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out
