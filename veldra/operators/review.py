"""Target timelines from a decision log: eligibility, intervals, gaps, conflicts, markers and status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators.eventlog import active_approvals, effective_decisions, source_class
from veldra.storage import Scratch

#: Actions and classes of the decision log.
CONFIRM, REVOKE, INVALID = "CONFIRM_TARGET", "REVOKE", "INVALID_SEGMENT"
UNRESOLVED = ("NONE_OF_THESE", "UNKNOWN", "DEFER")
APPROVED, GONE, NO_PROVENANCE = "PRODUCT_APPROVED", "REVOKED_OR_SUPERSEDED", "INVALID_PROVENANCE"


def classified(decisions: DataFrame, rules: list[tuple[str, str, Column]], approvals: DataFrame | None = None) -> DataFrame:
    """``decisions`` with ``effective``, ``source_class``, ``exclusion_reason`` and ``timeline_eligible``.

    ``decisions``: (target, event, decision, revision, action, segment, track, frame, direct, supersedes, log_pos).
    ``rules``: (class, reason, condition) of sources that are kept out; the first that holds counts. ``approvals``:
    (decision, status, log_pos); where given, a confirmation needs an active one. Only effective confirmations are
    eligible, and those name a segment or a box drawn by hand.
    """
    heads = effective_decisions(decisions, "event", "decision", "revision", "supersedes").select(F.col("decision").alias("_head"))
    d = decisions.join(heads, F.col("decision") == F.col("_head"), "left").withColumn("effective", F.col("_head").isNotNull()).drop("_head")
    if approvals is None:
        d = d.withColumn("_approved", F.lit(True))
    else:
        ok = active_approvals(approvals, "decision", "status", "APPROVED").select(F.col("decision").alias("_ok"))
        d = d.join(ok, F.col("decision") == F.col("_ok"), "left").withColumn("_approved", F.col("_ok").isNotNull()).drop("_ok")
    confirm = F.col("action") == CONFIRM
    kept_out = source_class([(name, c) for name, _, c in rules], APPROVED)
    known = F.col("segment").isNotNull() | F.coalesce("direct", F.lit(False))
    d = d.withColumn("_class", kept_out)
    clean = F.col("_class") == APPROVED
    blind = clean & confirm & F.col("_approved") & F.col("effective") & ~known
    out = F.when(~clean, F.col("_class")).when(F.col("action") == REVOKE, GONE).when(blind, NO_PROVENANCE).when(~F.col("effective"), GONE).otherwise(APPROVED)
    reason = F.when(~clean, source_class([(why, c) for _, why, c in rules], ""))
    reason = reason.when(F.col("action") == REVOKE, "effective_or_recorded_revoke_not_confirm").when(confirm & ~F.col("_approved"), "missing_product_timeline_approval")
    reason = reason.when(blind, "confirm_missing_segment_or_direct_bbox").when(~F.col("effective"), "not_effective_chain_head")
    eligible = clean & confirm & F.col("effective") & F.col("_approved") & known
    return d.withColumn("source_class", out).withColumn("exclusion_reason", reason).withColumn("timeline_eligible", eligible).drop("_class", "_approved")


def effective_heads(decisions: DataFrame, rules: list[tuple[str, str, Column]], approvals: DataFrame | None = None) -> DataFrame:
    """(target, event, decision, kind, segment, track, frame, known, approved): effective decisions whose source isn't kept out.

    These alone make timelines, so only what these need is shuffled: by decision to leave out what is superseded, by event
    to find its head, and the heads by decision to find their approvals. Arguments as those of ``classified``.
    """
    kind = F.when(F.col("action") == CONFIRM, "c").when(F.col("action") == REVOKE, "r").when(F.col("action").isin(*UNRESOLVED), "u").when(F.col("action") == INVALID, "i").otherwise("o")
    known = F.col("segment").isNotNull() | F.coalesce("direct", F.lit(False))
    clean = source_class([(name, c) for name, _, c in rules], APPROVED) == APPROVED
    slim = decisions.select("target", "event", "decision", "revision", "supersedes", "log_pos", kind.alias("kind"), "segment", "track", "frame", known.alias("known"), clean.alias("_clean"))
    heads = effective_decisions(slim, "event", "decision", "revision", "supersedes").where("_clean and decision is not null").drop("_clean", "revision", "supersedes", "log_pos")
    if approvals is None:
        return heads.withColumn("approved", F.lit(True))
    ok = active_approvals(approvals, "decision", "status", "APPROVED").select(F.col("decision").alias("_ok"))
    return heads.join(ok, F.col("decision") == F.col("_ok"), "left").withColumn("approved", F.col("_ok").isNotNull()).drop("_ok")


def active_spans(intervals: DataFrame, by: str, start: str, stop: str, least: int) -> DataFrame:
    """(by, start, stop, most): longest frame ranges in which at least ``least`` inclusive intervals are active, and how many at most.

    A sweep: +1 at each start and -1 after each stop, a running sum, and runs of sums that reach ``least``.
    """
    ends = F.array(F.struct(F.col(start).alias("_f"), F.lit(1).alias("_d")), F.struct((F.col(stop) + 1).alias("_f"), F.lit(-1).alias("_d")))
    steps = intervals.select(by, F.explode(ends).alias("_e")).groupBy(by, F.col("_e._f").alias("_f")).agg(F.sum("_e._d").alias("_d"))
    w = Window.partitionBy(by).orderBy("_f")
    s = steps.withColumn("_n", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_to", F.lead("_f").over(w) - 1)
    s = s.withColumn("_in", F.col("_n") >= least)
    s = s.withColumn("_run", F.sum((F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("_in").groupBy(by, "_run").agg(F.min("_f").alias("start"), F.max("_to").alias("stop"), F.max("_n").alias("most")).drop("_run")


def overlapping_pairs(intervals: DataFrame, by: str, start: str, stop: str, same: list[str]) -> DataFrame:
    """(by, pairs): how many pairs of a group share a frame, but for those alike in the columns ``same``; no pair is formed.

    Of the intervals that start no later than another one, those that ended before it are subtracted; equal starts
    count once. Intervals alike in ``same`` must have the same frames.
    """
    ends = F.array(F.struct(F.col(start).alias("_f"), F.lit(1).alias("_in"), F.lit(0).alias("_out")), F.struct((F.col(stop) + 1).alias("_f"), F.lit(0).alias("_in"), F.lit(1).alias("_out")))
    steps = intervals.select(by, F.explode(ends).alias("_e")).groupBy(by, F.col("_e._f").alias("_f")).agg(F.sum("_e._in").alias("_in"), F.sum("_e._out").alias("_out"))
    w = Window.partitionBy(by).orderBy("_f").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.sum(F.col("_in")).over(w) - F.col("_in") - F.sum("_out").over(w)  # begun at an earlier frame and not over
    met = steps.withColumn("_pairs", F.col("_in") * open_ + F.col("_in") * (F.col("_in") - 1) / 2)
    alike = intervals.groupBy(by, *same).agg(F.count(F.lit(1)).alias("_k")).groupBy(F.col(by).alias("_by")).agg(F.sum(F.col("_k") * (F.col("_k") - 1) / 2).alias("_alike"))
    total = met.groupBy(by).agg(F.sum("_pairs").alias("_pairs")).join(alike, F.col(by) == F.col("_by"))
    return total.select(by, (F.col("_pairs") - F.col("_alike")).cast("long").alias("pairs"))


@dataclass
class TargetTimelines:
    """``intervals``: (target, kind, id, segment, track, start, stop) of confirmed intervals, gaps between them, and the
    markers of unresolved events and invalid segments (frame 0). ``conflicts``: frame ranges with several segments at
    once, and segments bound to several targets. ``summary``: a row for each target of the log."""

    decisions: DataFrame
    intervals: DataFrame
    conflicts: DataFrame
    summary: DataFrame


def timelines_from_decisions(decisions: DataFrame, segments: DataFrame, rules: list[tuple[str, str, Column]], approvals: DataFrame | None, frames: int) -> TargetTimelines:
    """Timelines of all targets at once.

    ``segments``: (segment, track, start, stop). An eligible confirmation whose segment isn't known, or of another track,
    or whose frame lies outside, blocks its target: no interval, status BLOCKED. One without a segment is not linkable
    and left out. A gap lies between an interval's own end and the next start in the order of (start, stop); none is
    filled. Status: CONFLICTED if confirmed intervals of unlike segments share a frame or a segment is bound to several
    targets, else NO_APPROVED_PRODUCT_DECISIONS without an eligible confirmation, EMPTY without intervals, or OK.
    Repeated decisions must not occur; null frames aren't checked. The effective decisions are written to the shared folder;
    ``decisions`` is read several times.
    """
    scratch = Scratch(decisions.sparkSession, "timelines")
    heads = scratch.keep(effective_heads(decisions, rules, approvals), "heads")
    eligible = (F.col("kind") == "c") & F.col("approved") & F.col("known")
    seg = segments.select(F.col("segment").alias("_seg"), F.col("track").alias("_track"), "start", "stop")
    linked = heads.where(eligible).join(seg, F.col("segment") == F.col("_seg"), "left")
    wrong = F.col("segment").isNotNull() & (F.col("_seg").isNull() | F.coalesce(F.col("track") != F.col("_track"), F.lit(False)) | F.coalesce((F.col("frame") < F.col("start")) | (F.col("frame") > F.col("stop")), F.lit(False)))
    linked = scratch.keep(linked.select("target", "decision", "segment", "_track", "start", "stop", wrong.alias("_wrong")), "linked")
    blocked = linked.where("_wrong").select(F.col("target").alias("_t")).distinct()
    confirmed = linked.where(F.col("segment").isNotNull()).join(blocked, F.col("target") == F.col("_t"), "left_anti")
    confirmed = confirmed.select("target", F.lit("confirmed").alias("kind"), F.col("decision").cast("string").alias("id"), "segment", F.col("_track").alias("track"), "start", "stop")
    w = Window.partitionBy("target").orderBy("start", "stop")
    after = confirmed.withColumn("_a", F.lag("stop").over(w) + 1).withColumn("_b", F.col("start") - 1).where("_b >= _a")
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {c: confirmed.schema[c].dataType for c in ("segment", "track", "start")}
    gaps = after.select("target", F.lit("gap").alias("kind"), F.concat_ws("_", F.lit("gap"), "_a", "_b").alias("id"), none(kinds["segment"]).alias("segment"), none(kinds["track"]).alias("track"), F.col("_a").alias("start"), F.col("_b").alias("stop"))
    mark = heads.join(blocked, F.col("target") == F.col("_t"), "left_anti")
    zero = F.lit(0).cast(kinds["start"])
    open_events = mark.where("kind = 'u'").select("target", F.lit("unresolved_event").alias("kind"), F.col("event").cast("string").alias("id"), none(kinds["segment"]).alias("segment"), none(kinds["track"]).alias("track"), zero.alias("start"), zero.alias("stop"))
    invalid = mark.where("kind = 'i'").select("target", F.lit("invalid").alias("kind"), F.col("decision").cast("string").alias("id"), "segment", "track", zero.alias("start"), zero.alias("stop"))
    intervals = confirmed.unionByName(gaps).unionByName(open_events).unionByName(invalid)

    unlike = confirmed.select("target", "segment", "track", "start", "stop").distinct()
    spans = active_spans(unlike, "target", "start", "stop", 2)
    bound = confirmed.groupBy("segment").agg(F.collect_set("target").alias("_ts")).where(F.size("_ts") > 1)
    bindings = bound.select(F.explode("_ts").alias("target"), "segment", F.size("_ts").cast("long").alias("targets"))
    conflicts = spans.select("target", F.lit("overlap").alias("kind"), none(kinds["segment"]).alias("segment"), "start", "stop", F.col("most").cast("long").alias("n"))
    conflicts = conflicts.unionByName(bindings.select("target", F.lit("binding").alias("kind"), "segment", none(kinds["start"]).alias("start"), none(kinds["start"]).alias("stop"), F.col("targets").alias("n")))

    length = F.col("stop") - F.col("start") + 1
    of = lambda kind: F.col("kind") == kind
    totals = intervals.groupBy("target").agg(
        F.count_if(of("confirmed")).alias("confirmed"), F.coalesce(F.sum(F.when(of("confirmed"), length)), F.lit(0)).alias("confirmed_frames"), F.count_if(of("gap")).alias("gaps"),
        F.coalesce(F.sum(F.when(of("gap"), length)), F.lit(0)).alias("gap_frames"), F.count_if(of("unresolved_event")).alias("unresolved_events"), F.count_if(of("invalid")).alias("invalid"),
        F.count_distinct(F.when(of("confirmed"), F.col("track"))).alias("tracks"),
    )
    pairs = overlapping_pairs(confirmed, "target", "start", "stop", ["segment", "track"])
    shared = bindings.groupBy("target").agg(F.count(F.lit(1)).alias("_bound"))
    named = lambda df, k: df.withColumnRenamed("target", k)
    blind = (F.col("kind") == "c") & F.col("approved") & ~F.col("known")
    held = heads.groupBy(F.col("target").alias("_t")).agg(F.count_if(eligible).alias("_eligible"), F.count_if((F.col("kind") != "r") & ~blind).alias("_kept"))
    all_ = decisions.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).join(held, F.col("target").eqNullSafe(F.col("_t")), "left")
    all_ = all_.select("target", F.coalesce("_eligible", F.lit(0)).alias("eligible"), (F.col("_n") - F.coalesce("_kept", F.lit(0))).alias("excluded"))
    s = all_.join(named(totals, "_t1"), F.col("target") == F.col("_t1"), "left").join(named(pairs, "_t2"), F.col("target") == F.col("_t2"), "left").join(named(shared, "_t3"), F.col("target") == F.col("_t3"), "left").join(named(blocked.withColumnRenamed("_t", "target"), "_t4"), F.col("target") == F.col("_t4"), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    clash = n("pairs") + n("_bound")
    status = F.when(F.col("_t4").isNotNull(), "BLOCKED").when(clash > 0, "CONFLICTED").when((F.col("eligible") == 0) & (n("confirmed") == 0), "NO_APPROVED_PRODUCT_DECISIONS").when(n("confirmed") == 0, "EMPTY").otherwise("OK")
    columns = ("confirmed", "confirmed_frames", "gaps", "gap_frames", "unresolved_events", "invalid", "tracks")
    summary = s.select("target", "eligible", "excluded", *(n(c).alias(c) for c in columns), clash.alias("conflicts"), (n("confirmed_frames") / F.lit(float(frames))).alias("coverage"), status.alias("status"))
    return TargetTimelines(classified(decisions, rules, approvals), intervals, conflicts, summary)


def provisional_intervals(log: DataFrame, approved: DataFrame) -> DataFrame:
    """(target, id, status, decision, segment, track, start, stop, approved, eligible) as a reviewer's log goes along.

    ``log``: (target, event, decision, log_pos, action, segment, track, start, stop, frame), with the frames of the chosen track;
    ``approved``: (decision) with an active approval. A confirmation is verified at its track's first frame and goes on to its
    last, as a second interval where that is later; approved, it is VERIFIED over the whole track and both may be analysed.
    What leaves a target unresolved is marked at its frame, with segment and track of the last confirmation before it.
    """
    ok = approved.select(F.col("decision").alias("_ok")).distinct()
    d = log.join(ok, F.col("decision") == F.col("_ok"), "left").withColumn("approved", F.col("_ok").isNotNull())
    w = Window.partitionBy("target").orderBy("log_pos").rowsBetween(Window.unboundedPreceding, -1)
    was = F.last(F.when((F.col("action") == CONFIRM) & F.col("start").isNotNull(), F.struct("segment", "track")), ignorenulls=True).over(w)
    d = d.withColumn("_was", was)
    confirm = (F.col("action") == CONFIRM) & F.col("start").isNotNull()
    row = lambda id_, status, segment, track, start, stop, able: F.struct(F.concat(F.lit(id_), F.col("decision").cast("string")).alias("id"), status.alias("status"), segment.alias("segment"), track.alias("track"), start.alias("start"), stop.alias("stop"), able.alias("eligible"))
    seg, track, start, stop = (F.col(c) for c in ("segment", "track", "start", "stop"))
    human = row("human_", F.when(F.col("approved"), "VERIFIED").otherwise("HUMAN VERIFIED"), seg, track, start, F.when(F.col("approved"), stop).otherwise(start), F.col("approved"))
    on = row("continuation_", F.lit("TRACKER CONTINUATION"), seg, track, start, stop, F.col("approved"))
    gap = row("unresolved_", F.lit("UNRESOLVED"), F.col("_was.segment"), F.col("_was.track"), F.col("frame"), F.col("frame"), F.lit(False))
    rows = F.when(confirm & (stop > start), F.array(human, on)).when(confirm, F.array(human)).when(F.col("action").isin(*UNRESOLVED), F.array(gap))
    out = d.select("target", "decision", "approved", F.explode(rows).alias("_r"))
    return out.select("target", "_r.id", "_r.status", "decision", "_r.segment", "_r.track", "_r.start", "_r.stop", "approved", "_r.eligible")


def selection_status(track: Column, track_end: Column, now: Column, unresolved: Column) -> Column:
    """What a reviewer sees of a target: TRACKING, LOST after its track's end, REVIEW REQUIRED without a track, UNRESOLVED where
    either holds and something is unresolved."""
    past = F.coalesce(now > track_end, F.lit(False))
    return F.when(unresolved & (track.isNull() | past), "UNRESOLVED").when(track.isNull(), "REVIEW REQUIRED").when(past, "LOST").otherwise("TRACKING")


def target_states(observations: DataFrame, by: str, order: str, source: str, track: str, hint: str, sources: list[str], statuses: list[str]) -> DataFrame:
    """``observations`` with ``current_track`` and ``target_status`` after each: the last track named and the last hint that is a
    status; other hints change nothing. An unknown source is an error."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(source).isin(*sources), F.col(source)).otherwise(F.raise_error(F.concat(F.lit("unknown observation source "), F.coalesce(F.col(source), F.lit("null")))))
    d = observations.withColumn(source, known)
    return d.withColumn("current_track", F.last(track, ignorenulls=True).over(w)).withColumn("target_status", F.last(F.when(F.col(hint).isin(*statuses), F.col(hint)), ignorenulls=True).over(w))
