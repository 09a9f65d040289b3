"""Streaming forms of the frame-ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def track_windows(stream: DataFrame, time: str, track: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, track, observations, mean, top) in event-time windows; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), track).agg(F.count(F.lit(1)).alias("observations"), F.avg(value).alias("mean"), F.max(value).alias("top"))


def latest_decisions(stream: DataFrame, event: str, revision: str, action: str) -> DataFrame:
    """(event, revision, action): the effective decision of each event so far; for update or complete mode."""
    return stream.groupBy(event).agg(F.max(F.struct(revision, action)).alias("m")).select(event, F.col(f"m.{revision}").alias(revision), F.col(f"m.{action}").alias(action))


def track_runs(stream: DataFrame, track: str, frame: str, most_gap: int = 3, timeout_ms: int = 60_000) -> DataFrame:
    """(track, start, stop, frames) of each run when a later frame ends it or the timeout passes.

    State is the open run of a track: three numbers. Frames of a track must come in order within a trigger's data or
    later; an earlier frame than the open run's last is taken as a repeat.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(state.get)
            state.remove()
        else:
            run = list(state.get) if state.exists else None
            for f in sorted(x for b in batches for x in b[frame]):
                f = int(f)
                if run is None:
                    run = [f, f, 1]
                elif f > run[1] + most_gap:
                    out.append(tuple(run))
                    run = [f, f, 1]
                elif f > run[1]:
                    run = [run[0], f, run[2] + 1]
            if run:
                state.update(tuple(run))
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["track", "start", "stop", "frames"]).astype("int64")

    return stream.groupBy(F.col(track).alias("track")).applyInPandasWithState(step, "track long, start long, stop long, frames long", "start long, stop long, frames long", "append", GroupStateTimeout.ProcessingTimeTimeout)
