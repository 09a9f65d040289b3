"""More named queries over the driver's tables with the same rows in DuckDB SQL: timelines, evidence, joins, choices.

``COVERS`` names the survey's operators that a query exercises.

Thresholds and names in the rules are fixed values: results must agree with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions import geometry as geo
from veldra.functions import text as txt
from veldra.functions import vectors as vec
from veldra.functions.number import rounded
from veldra.operators import aggregates as agg
from veldra.operators import blocks, contracts, eventlog, evidence, graph, joins, metrics, overlap, selection, timelines, windows
from veldra.plans import standins as st
from veldra.session import table
from veldra.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c: rounded(c, 6)
r9 = lambda c: rounded(c, 9)
n_rows = lambda: F.count(F.lit(1))
FRAMES = 720

# --- annotation events and timelines ----------------------------------------------------------------------------


def _annotation_events(spark, sf_dir):
    """Lines of an order as the annotation events of a target; the first adds an interval."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").cast("long").alias("pos"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    # Equal order and line numbers would leave the order open.
    li = li.groupBy("target", "pos").agg(F.min(F.struct("l_partkey", "l_suppkey", "q")).alias("m")).select("target", "pos", "m.*")
    w = Window.partitionBy("target").orderBy("pos")
    kind = F.when(F.row_number().over(w) == 1, "add").otherwise(F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("q") % 5 + 1).cast("int")))
    e = li.withColumn("kind", kind).withColumn("start", F.col("l_partkey") % 600).withColumn("stop", F.col("l_partkey") % 600 + 20 + F.col("l_suppkey") % 40)
    e = e.withColumn("id", F.col("target") * 1000 + F.col("pos") * 10)
    was = F.lag("id").over(w)
    e = e.withColumn("ref", was + (F.lag("kind").over(w) == "split").cast("long")).withColumn("ref2", was + 2)
    return e.withColumn("at", F.lag("start").over(w) + 10).select("target", "pos", "kind", "id", "start", "stop", "ref", "ref2", "at")


_KINDS = ("supersede", "split", "deactivate", "merge", "add")
_EVENTS = """lines AS (SELECT l_orderkey AS target, l_linenumber::BIGINT AS pos, l_partkey, l_suppkey, l_quantity::BIGINT AS q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
kinds AS (SELECT target, pos, row_number() OVER w AS turn, CASE WHEN row_number() OVER w = 1 THEN 'add' ELSE ['supersede', 'split', 'deactivate', 'merge', 'add'][(q % 5 + 1)::INT] END AS kind, l_partkey % 600 AS start, l_partkey % 600 + 20 + l_suppkey % 40 AS stop, target * 1000 + pos * 10 AS id FROM lines WINDOW w AS (PARTITION BY target ORDER BY pos)),
events_ AS (SELECT *, lag(id) OVER w + (lag(kind) OVER w = 'split')::BIGINT AS ref, lag(id) OVER w + 2 AS ref2, lag(start) OVER w + 10 AS at FROM kinds WINDOW w AS (PARTITION BY target ORDER BY pos))"""
_REPLAY = f"""{_EVENTS},
fold AS (SELECT target, 0::BIGINT AS turn, []::STRUCT(id BIGINT, start BIGINT, stop BIGINT)[] AS s FROM (SELECT DISTINCT target FROM events_) UNION ALL
  SELECT f.target, e.turn, CASE
    WHEN kind = 'add' THEN f.s || [{{'id': e.id, 'start': e.start, 'stop': e.stop}}]
    WHEN kind = 'supersede' AND len(list_filter(f.s, lambda x: x.id = e.ref)) > 0 THEN list_filter(f.s, lambda x: x.id <> e.ref) || [{{'id': e.id, 'start': e.start, 'stop': e.stop}}]
    WHEN kind = 'split' AND len(list_filter(f.s, lambda x: x.id = e.ref AND e.at > x.start AND e.at <= x.stop)) > 0 THEN list_filter(f.s, lambda x: x.id <> e.ref)
      || list_transform(list_filter(f.s, lambda x: x.id = e.ref), lambda x: {{'id': e.id + 1, 'start': x.start, 'stop': e.at - 1}}) || list_transform(list_filter(f.s, lambda x: x.id = e.ref), lambda x: {{'id': e.id + 2, 'start': e.at, 'stop': x.stop}})
    WHEN kind = 'merge' AND len(list_filter(f.s, lambda x: x.id = e.ref)) > 0 AND len(list_filter(f.s, lambda x: x.id = e.ref2)) > 0 AND list_filter(f.s, lambda x: x.id = e.ref)[1].stop + 1 = list_filter(f.s, lambda x: x.id = e.ref2)[1].start
      THEN list_filter(f.s, lambda x: x.id <> e.ref AND x.id <> e.ref2) || [{{'id': e.id, 'start': list_filter(f.s, lambda x: x.id = e.ref)[1].start, 'stop': list_filter(f.s, lambda x: x.id = e.ref2)[1].stop}}]
    WHEN kind = 'deactivate' THEN list_filter(f.s, lambda x: x.id <> e.ref) ELSE f.s END
  FROM fold f JOIN events_ e ON e.target = f.target AND e.turn = f.turn + 1),
done AS (SELECT target, unnest(s) AS x FROM fold QUALIFY turn = max(turn) OVER (PARTITION BY target)),
truth AS (SELECT target, x.id AS id, x.start AS start, x.stop AS stop FROM done)"""


def _truth(spark, sf_dir):
    return timelines.replay_events(_annotation_events(spark, sf_dir), "target", "pos")


@query("O209 O210", f"WITH RECURSIVE {_REPLAY} SELECT * FROM truth")
def annotation_replay(spark, sf_dir):
    return _truth(spark, sf_dir)


_OVERLAPS = "pairs AS (SELECT a.target, a.id AS a, b.id AS b FROM truth a JOIN truth b ON a.target = b.target AND (b.start > a.start OR (b.start = a.start AND b.id > a.id)) AND b.start <= a.stop)"


@query("O062", f"WITH RECURSIVE {_REPLAY}, {_OVERLAPS} SELECT * FROM pairs")
def annotation_overlaps(spark, sf_dir):
    return timelines.overlapping(_truth(spark, sf_dir), ["target"], "id", "start", "stop")


@query("O214", f"WITH RECURSIVE {_REPLAY}, {_OVERLAPS} SELECT target, id, 'range' AS code FROM truth WHERE start < 0 OR stop >= 600 OR start > stop UNION ALL SELECT DISTINCT target, b, 'overlap' FROM pairs")
def annotation_errors(spark, sf_dir):
    return timelines.validation_errors(_truth(spark, sf_dir), ["target"], "id", "start", "stop", 600)


@query("O213 O101", f"""WITH RECURSIVE {_REPLAY}, m AS (SELECT *, max(stop) OVER (PARTITION BY target ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM truth),
f AS (SELECT DISTINCT target, unnest(range(start, stop + 1)) AS f FROM truth), c AS (SELECT target, count(*) AS covered FROM f GROUP BY target),
g AS (SELECT target, count(*) AS intervals, count(*) FILTER (start <= b) AS conflicts, count(*) FILTER (start > b + 1) AS gaps, coalesce(sum(start - b - 1) FILTER (start > b + 1), 0)::BIGINT AS gap_frames FROM m GROUP BY target)
SELECT target, intervals, conflicts, gaps, gap_frames, covered, CASE WHEN conflicts > 0 THEN 'CONFLICT' WHEN gaps > 0 OR covered < {FRAMES} THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM g JOIN c USING (target)""")
def target_timelines(spark, sf_dir):
    return timelines.reconstruct(_truth(spark, sf_dir), "target", "start", "stop", FRAMES)


@query("O223", f"WITH RECURSIVE {_REPLAY} SELECT target, id, 'before' AS part, start, 299 AS stop FROM truth WHERE start < 300 AND stop >= 300 UNION ALL SELECT target, id, 'after', 300, stop FROM truth WHERE start < 300 AND stop >= 300 UNION ALL SELECT target, id, 'whole', start, stop FROM truth WHERE NOT (start < 300 AND stop >= 300)")
def intervals_split_at_change(spark, sf_dir):
    return timelines.split_at(_truth(spark, sf_dir), ["target", "id"], "start", "stop", F.lit(300).cast("long"))


_CLASSES = {"SHORT": "frames = 1", "SPARSE": "frames * 2 < stop - start + 1", "LATE": "start >= 600", "LONG": "stop - start >= 12", "NONE": "frames < 0"}


@query("O099", f"WITH {st.SESSIONS}, c AS (SELECT unnest({list(_CLASSES)}) AS class) SELECT class, count(start) AS n, coalesce(sum(stop - start + 1), 0)::BIGINT AS frames FROM c LEFT JOIN sessions ON CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CLASSES.items()) + " END GROUP BY class")
def failure_taxonomy(spark, sf_dir):
    s = st.sessions(spark, sf_dir)
    return timelines.taxonomy(s, {k: F.expr(v) for k, v in _CLASSES.items()}, F.col("stop") - F.col("start") + 1)


_STATE = "CASE WHEN class_name IN ('click', 'view') AND confidence > 0.3 THEN 'correct' WHEN confidence > 0.3 THEN 'false' ELSE 'lost' END"
_RUNS = f"""{st.OBS}, d AS (SELECT track, frame, {_STATE} AS state FROM obs), e AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame) - row_number() OVER (PARTITION BY track, state ORDER BY frame) AS g FROM d),
runs AS (SELECT track, state, min(frame) AS first, max(frame) AS last, count(*) AS rows FROM e GROUP BY track, state, g), numbered_ AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY first) AS run FROM runs)"""


def _runs(spark, sf_dir):
    return timelines.state_runs(st.observations(spark, sf_dir), "track", "frame", F.expr(_STATE))


@query("O218", f"WITH {_RUNS} SELECT track, state, run, first, last, rows FROM numbered_")
def tracking_state_runs(spark, sf_dir):
    return _runs(spark, sf_dir).withColumn("run", F.col("run").cast("long"))


@query("O098 O218", f"""WITH {_RUNS}, s AS (SELECT *, max(CASE WHEN state = 'correct' THEN last END) OVER (PARTITION BY track ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, lag(state) OVER (PARTITION BY track ORDER BY run) AS was FROM numbered_)
SELECT track, count(*) FILTER (state = 'correct') AS correct_runs, count(*) FILTER (state = 'false') AS false_runs, coalesce(max(rows) FILTER (state = 'correct'), 0) AS longest_correct, count(*) FILTER (state <> 'correct' AND was = 'correct') AS losses,
count(*) FILTER (state = 'correct' AND seen IS NOT NULL) AS recoveries, coalesce(sum(first - seen) FILTER (state = 'correct' AND seen IS NOT NULL), 0)::BIGINT AS recovery_frames FROM s GROUP BY track""")
def tracking_quality(spark, sf_dir):
    return timelines.run_metrics(_runs(spark, sf_dir), "track", "correct", "false")


def _sessions_sql(gap: int, name: str) -> str:
    return f"""m{name} AS (SELECT track, frame, coalesce((frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) > {gap})::INT, 1) AS fresh FROM obs), n{name} AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY frame) AS run FROM m{name}),
s{name} AS (SELECT track, min(frame) AS start, max(frame) AS stop, count(*) AS frames FROM n{name} GROUP BY track, run)"""


@query("O072", f"WITH {st.OBS}, {_sessions_sql(3, '3')}, {_sessions_sql(9, '9')} SELECT track, start, coalesce(b.stop, a.stop) AS stop, CASE WHEN a.stop IS NULL THEN 'added' WHEN b.stop IS NULL THEN 'removed' WHEN a.stop = b.stop THEN 'kept' ELSE 'extended' END AS delta FROM s3 a FULL JOIN s9 b USING (track, start)")
def baseline_deltas(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    old, new = (windows.runs(o, ["track"], "frame", g).drop("run") for g in (3, 9))
    return timelines.interval_deltas(old, new, ["track"], "start", "stop")


@query("O097 O105 O159", f"""WITH {st.OBS}, {', '.join(_sessions_sql(g, str(g)) for g in (1, 3, 9))}, v AS (SELECT 1 AS variant, * FROM s1 UNION ALL SELECT 3, * FROM s3 UNION ALL SELECT 9, * FROM s9),
g AS (SELECT variant, count(*) AS segments, sum(stop - start + 1)::BIGINT AS duration, max(stop - start + 1) AS longest FROM v GROUP BY variant) SELECT variant::INT AS variant, segments, duration, longest, round(segments / duration, 9) AS fragmentation, row_number() OVER (ORDER BY segments / duration, variant)::INT AS rank FROM g""")
def variant_summary(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    v = None
    for gap in (1, 3, 9):
        part = windows.runs(o, ["track"], "frame", gap).withColumn("variant", F.lit(gap))
        v = part if v is None else v.unionByName(part)
    g = v.groupBy("variant").agg(n_rows().alias("segments"), F.sum(F.col("stop") - F.col("start") + 1).alias("duration"), F.max(F.col("stop") - F.col("start") + 1).alias("longest"))
    share = F.col("segments") / F.col("duration")
    return g.withColumn("fragmentation", r9(share)).withColumn("rank", F.row_number().over(Window.orderBy(share, "variant")))  # a few variants


@query("O222", f"WITH {st.SESSIONS}, t AS (SELECT *, lead(start) OVER (PARTITION BY track ORDER BY start) AS nxt FROM sessions) SELECT track, 'observed' AS kind, start, stop FROM t UNION ALL SELECT track, CASE WHEN nxt - stop - 1 <= 12 THEN 'bridge' ELSE 'gap' END, stop + 1, nxt - 1 FROM t WHERE nxt > stop + 1")
def timeline_union(spark, sf_dir):
    s = st.sessions(spark, sf_dir)
    g = windows.gaps_between(s, ["track"], "start", "stop")
    kind = F.when(F.col("gap_stop") - F.col("gap_start") < 12, "bridge").otherwise("gap")
    return s.select("track", F.lit("observed").alias("kind"), "start", "stop").unionByName(g.select("track", kind.alias("kind"), F.col("gap_start").alias("start"), F.col("gap_stop").alias("stop")))


@query("O211 O221", f"WITH {st.LOG} SELECT event, CASE action WHEN 'confirm' THEN 'PRESENT' WHEN 'correct' THEN 'MOVED' ELSE 'UNKNOWN' END AS status, decision, log_pos FROM log QUALIFY row_number() OVER (PARTITION BY event ORDER BY log_pos DESC) = 1")
def provisional_timeline(spark, sf_dir):
    last = st.decision_log(spark, sf_dir).groupBy("event").agg(F.max_by(F.struct("action", "decision", "log_pos"), "log_pos").alias("l"))
    status = F.when(F.col("l.action") == "confirm", "PRESENT").when(F.col("l.action") == "correct", "MOVED").otherwise("UNKNOWN")
    return last.select("event", status.alias("status"), "l.decision", "l.log_pos")


@query("O102 O044", f"WITH {st.LOG} SELECT action, count(*) AS decisions, count(DISTINCT event) AS events, count(*) FILTER (supersedes IS NOT NULL) AS superseding FROM log GROUP BY action")
def decision_class_counts(spark, sf_dir):
    return st.decision_log(spark, sf_dir).groupBy("action").agg(n_rows().alias("decisions"), F.countDistinct("event").alias("events"), F.count("supersedes").alias("superseding"))


@query("O103", f"WITH {st.LOG} SELECT size AS segment, count(DISTINCT event) AS targets, string_agg(DISTINCT event::VARCHAR, ',' ORDER BY event::VARCHAR) AS events FROM log GROUP BY size HAVING count(DISTINCT event) > 1")
def segments_with_several_targets(spark, sf_dir):
    g = st.decision_log(spark, sf_dir).groupBy(F.col("size").alias("segment")).agg(F.array_sort(F.collect_set(F.col("event").cast("string"))).alias("e"))
    return g.where(F.size("e") > 1).select("segment", F.size("e").cast("long").alias("targets"), F.concat_ws(",", "e").alias("events"))


_LINE = "decision || ':' || action || ':' || coalesce(supersedes::VARCHAR, '')"


@query("O205", f"WITH {st.LOG} SELECT event, count(*) AS rows, max(revision) AS last_revision, sha256(string_agg({_LINE}, '\n' ORDER BY log_pos)) AS sha256 FROM log GROUP BY event")
def log_integrity(spark, sf_dir):
    line = F.concat_ws(":", F.col("decision").cast("string"), "action", F.coalesce(F.col("supersedes").cast("string"), F.lit("")))
    g = st.decision_log(spark, sf_dir).groupBy("event").agg(n_rows().alias("rows"), F.max("revision").alias("last_revision"), F.array_sort(F.collect_list(F.struct("log_pos", line.alias("line")))).alias("l"))
    return g.select("event", "rows", "last_revision", F.sha2(F.concat_ws("\n", F.transform("l", lambda x: x["line"])), 256).alias("sha256"))


@query("O207 O049", f"WITH {st.LOG} SELECT decision, concat_ws(',', CASE WHEN action = 'defer' THEN 'deferred' END, CASE WHEN size < 20 THEN 'short' END, CASE WHEN revision > 6 THEN 'late' END) AS reasons, NOT (action = 'defer' OR size < 20 OR revision > 6) AS approvable FROM log")
def approvability(spark, sf_dir):
    rules = {"deferred": F.col("action") == "defer", "short": F.col("size") < 20, "late": F.col("revision") > 6}
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return st.decision_log(spark, sf_dir).select("decision", F.concat_ws(",", reasons).alias("reasons"), (F.size(reasons) == 0).alias("approvable"))


@query("O075", f"WITH {st.SESSIONS}, {st.LOG} SELECT l.decision, s.track, s.start, coalesce(l.size BETWEEN s.start AND s.stop, FALSE) AS frame_inside, s.track IS NOT NULL AS known FROM log l LEFT JOIN (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY track ORDER BY start) = 1) s ON s.track = l.event")
def decision_provenance(spark, sf_dir):
    s = st.sessions(spark, sf_dir).groupBy("track").agg(F.min(F.struct("start", "stop")).alias("m")).select("track", "m.*")
    d = st.decision_log(spark, sf_dir).join(s, F.col("event") == F.col("track"), "left")
    return d.select("decision", "track", "start", F.coalesce(F.col("size").between(F.col("start"), F.col("stop")), F.lit(False)).alias("frame_inside"), F.col("track").isNotNull().alias("known"))


# --- observations -----------------------------------------------------------------------------------------------


@query("O033", f"""WITH {st.BOXED} SELECT event_id, x1 <= 2 AS left_edge, y1 <= 2 AS top_edge, x2 >= 1178 AS right_edge, y2 >= 598 AS bottom_edge,
round(1 - greatest(least(x2, 1180) - greatest(x1, 0), 0) * greatest(least(y2, 600) - greatest(y1, 0), 0)::DOUBLE / ((x2 - x1) * (y2 - y1)), 9) AS clipped FROM boxed""")
def edge_clipping(spark, sf_dir):
    c = evidence.clipped_fraction(*(F.col(x) for x in ("x1", "y1", "x2", "y2")), 1180, 600)
    return st.boxed_events(spark, sf_dir).select("event_id", (F.col("x1") <= 2).alias("left_edge"), (F.col("y1") <= 2).alias("top_edge"), (F.col("x2") >= 1178).alias("right_edge"), (F.col("y2") >= 598).alias("bottom_edge"), r9(c).alias("clipped"))


@query("O037 O252", f"WITH {st.OBS} SELECT track, count(*) AS n, count(*) FILTER (x2 <= 1200 AND y2 <= 640) AS inside, concat_ws(',', CASE WHEN count(*) < 5 THEN 'few' END, CASE WHEN count(*) FILTER (x2 <= 1200 AND y2 <= 640) = 0 THEN 'outside' END) AS reasons FROM obs GROUP BY track")
def review_eligibility(spark, sf_dir):
    g = st.observations(spark, sf_dir).groupBy("track").agg(n_rows().alias("n"), F.count_if((F.col("x2") <= 1200) & (F.col("y2") <= 640)).alias("inside"))
    return g.withColumn("reasons", F.concat_ws(",", F.when(F.col("n") < 5, "few"), F.when(F.col("inside") == 0, "outside")))


_COLOR = "CASE WHEN confidence >= 0.1 AND value >= 40 THEN 'YELLOW' WHEN confidence >= 0.05 AND value < 40 THEN 'WHITE' ELSE 'UNKNOWN' END"


@query("O045 O120", f"WITH {st.OBS}, c AS (SELECT track, {_COLOR} AS state, count(*) AS n FROM obs GROUP BY ALL) SELECT track, state, n, round(n / sum(n) OVER (PARTITION BY track), 9) AS share FROM c")
def color_states(spark, sf_dir):
    c = st.observations(spark, sf_dir).select("track", F.expr(_COLOR).alias("state")).groupBy("track", "state").agg(n_rows().alias("n"))
    return c.withColumn("share", r9(F.col("n") / F.sum("n").over(Window.partitionBy("track"))))


@query("O086 O234", f"WITH {st.OBS} SELECT track, count(*) AS rows, min(value) AS value_min, median(value) AS value_median, max(value) AS value_max, round(avg(value), 9) AS value_mean, count(*) FILTER (x1 <= 2) AS at_edge, count(*) FILTER (confidence < 0.1) AS weak FROM obs GROUP BY track")
def quality_rollup(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    return evidence.rollup(o, ["track"], ["value"], {"at_edge": F.col("x1") <= 2, "weak": F.col("confidence") < 0.1}).withColumn("value_mean", r9(F.col("value_mean")))


@query("O091", "SELECT label, p::INT AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS p FROM embeddings) GROUP BY ALL")
def histogram_means(spark, sf_dir):
    return evidence.mean_array(st.vectors(spark, sf_dir), ["label"], "embedding").withColumn("mean", r6(F.col("mean")))


@query("O091", f"WITH {st.OBS}, c AS (SELECT track, class_name, count(*) AS n FROM obs GROUP BY ALL) SELECT track, class_name, round(n / sum(n) OVER (PARTITION BY track), 9) AS share, row_number() OVER (PARTITION BY track ORDER BY n DESC, class_name)::INT AS rank FROM c QUALIFY rank <= 3")
def top_families(spark, sf_dir):
    return evidence.top_shares(st.observations(spark, sf_dir), ["track"], "class_name", 3).withColumn("share", r9(F.col("share")))


def _first_highest(by):
    """Orders rows by their value, then by the least ``by``; rows without either count for nothing."""
    return F.when(F.col("value").isNotNull() & F.col(by).isNotNull(), F.struct("value", -F.col(by)))


@query("O092", f"WITH {st.OBS} SELECT track, min(frame) AS first_frame, max(frame) AS last_frame, arg_max(event_id, value) AS best_value, arg_max(event_id, (x2 - x1) * (y2 - y1) * 1000000000 - event_id) AS best_area, count(DISTINCT class_name) AS strata FROM obs GROUP BY track")
def segment_summary(spark, sf_dir):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * 1000000000 - F.col("event_id")
    return st.observations(spark, sf_dir).groupBy("track").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max_by("event_id", _first_highest("event_id")).alias("best_value"), F.max_by("event_id", area).alias("best_area"), F.countDistinct("class_name").alias("strata"))


@query("O093", f"""WITH {st.OBS}, d AS (SELECT track, frame, class_name, lag(class_name) OVER (PARTITION BY track ORDER BY frame) AS was FROM obs), c AS (SELECT track, was || '>' || class_name AS c, count(*) AS n FROM d WHERE was <> class_name GROUP BY ALL),
t AS (SELECT track, c FROM c QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, c) = 1) SELECT d.track, string_agg(class_name, ',' ORDER BY frame) AS values, count(DISTINCT class_name) AS distinct_values, count(*) FILTER (was <> class_name) AS changes, any_value(t.c) AS top_change FROM d LEFT JOIN t ON t.track = d.track GROUP BY d.track""")
def purity_rollup(spark, sf_dir):
    s = evidence.sequence_summary(st.observations(spark, sf_dir), "track", "frame", "class_name")
    return s.select("track", F.concat_ws(",", "values").alias("values"), F.col("distinct").alias("distinct_values"), "changes", "top_change")


@query("O095 O253 O254", f"WITH {st.OBS}, t AS (SELECT track, min(frame) AS a, max(frame) AS b, count(*) AS n, arg_max(frame, value) AS representative FROM obs GROUP BY track) SELECT track, printf('EXT_%05d', row_number() OVER (ORDER BY a, track)) AS code, a AS first_frame, b AS last_frame, round(n / (b - a + 1), 9) AS coverage, representative FROM t")
def track_mapping(spark, sf_dir):
    t = st.observations(spark, sf_dir).groupBy("track").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), n_rows().alias("n"), F.max_by("frame", _first_highest("frame")).alias("representative"))
    t = windows.numbered(t, [F.asc_nulls_last("first_frame"), F.asc_nulls_last("track")], "_code")
    return t.select("track", F.format_string("EXT_%05d", "_code").alias("code"), "first_frame", "last_frame", r9(F.col("n") / (F.col("last_frame") - F.col("first_frame") + 1)).alias("coverage"), "representative")


_BUCKET = "CASE WHEN frame = a THEN 'first' WHEN frame = b THEN 'last' WHEN (frame - a) * 3 < b - a THEN 'early' WHEN (frame - a) * 3 < 2 * (b - a) THEN 'middle' ELSE 'late' END"


@query("O134", f"WITH {st.OBS}, s AS (SELECT event_id, frame, min(frame) OVER (PARTITION BY track) AS a, max(frame) OVER (PARTITION BY track) AS b FROM obs) SELECT event_id, {_BUCKET} AS bucket FROM s")
def temporal_buckets(spark, sf_dir):
    w = Window.partitionBy("track")
    return st.observations(spark, sf_dir).withColumn("a", F.min("frame").over(w)).withColumn("b", F.max("frame").over(w)).select("event_id", F.expr(_BUCKET).alias("bucket"))


@query("O138", f"""WITH {st.OBS}, d AS (SELECT track, frame, value > 20 AS f, row_number() OVER (PARTITION BY track ORDER BY frame) AS i FROM obs), g AS (SELECT *, i - row_number() OVER (PARTITION BY track ORDER BY i) AS g FROM d WHERE f),
r AS (SELECT track, min(frame) AS first, count(*) AS n FROM g GROUP BY track, g) SELECT track, min(first) FILTER (n >= 4) AS coarse, min(first) FILTER (n >= 2) AS refined, least(min(first) FILTER (n >= 4), min(first) FILTER (n >= 2)) AS boundary FROM r GROUP BY track HAVING min(first) FILTER (n >= 2) IS NOT NULL""")
def boundary_refinement(spark, sf_dir):
    o, yes = st.observations(spark, sf_dir), F.lit(True)
    coarse, fine = (windows.change_points(o, "track", ["frame"], F.col("value") > 20, yes, n) for n in (4, 2))
    both = fine.select("track", F.col("first").alias("refined")).join(coarse.select("track", F.col("first").alias("coarse")), "track", "left")
    return both.select("track", "coarse", "refined", F.least("coarse", "refined").alias("boundary"))


@query("O141", f"WITH {st.OBS} SELECT o.track, o.frame, o.x1 - b.x1 AS d_x1, o.y1 - b.y1 AS d_y1 FROM obs o JOIN obs b ON b.track = o.track AND b.frame = o.frame - 5")
def velocity_from_five_back(spark, sf_dir):
    return evidence.frames_back(st.observations(spark, sf_dir), "track", "frame", ["x1", "y1"], 5)


@query("O142", f"""WITH {st.OBS}, s AS (SELECT f, row_number() OVER (ORDER BY f) AS i FROM (SELECT DISTINCT frame AS f FROM obs)), o AS (SELECT track, i, lag(i) OVER (PARTITION BY track ORDER BY i) AS was FROM obs JOIN s ON f = frame)
SELECT track, a.f AS start, b.f AS stop, o.i - was - 1 AS frames FROM o JOIN s a ON a.i = was + 1 JOIN s b ON b.i = o.i - 1 WHERE o.i - was - 1 >= 3""")
def absence_pockets(spark, sf_dir):
    return evidence.absence_pockets(st.observations(spark, sf_dir), "track", "frame", 3)


_PAIRS = f"{st.OBS}, p AS (SELECT DISTINCT track % 40 AS track, frame // 8 AS a, frame // 8 + x1 // 200 + frame // 180 AS b FROM obs)"
_RUN = f"""{_PAIRS}, walk AS (SELECT track, a AS a0, b AS b0, a, b, 1 AS n FROM p UNION ALL
  SELECT w.track, a0, b0, w.a + 1, min(p.b), any_value(n) + 1 FROM walk w JOIN p ON p.track = w.track AND p.a = w.a + 1 AND p.b > w.b AND abs(p.b - p.a - (b0 - a0)) <= 2 GROUP BY w.track, a0, b0, w.a, w.b),
run AS (SELECT track, max(n) AS n FROM walk GROUP BY track), first AS (SELECT w.track, w.a0, w.b0, r.n FROM walk w JOIN run r ON r.track = w.track AND r.n = w.n QUALIFY row_number() OVER (PARTITION BY w.track ORDER BY a0, b0) = 1),
best AS (SELECT f.n, w.* EXCLUDE (n) FROM first f JOIN walk w ON w.track = f.track AND w.a0 = f.a0 AND w.b0 = f.b0)"""


def _pairs(spark, sf_dir):
    """Matches of two sampled sequences for each of 40 groups: offsets wander with the frame and jump between boxes."""
    o = st.observations(spark, sf_dir)
    a = F.floor(F.col("frame") / 8)
    return o.select((F.col("track") % 40).alias("track"), a.alias("a"), (a + F.floor(F.col("x1") / 200) + F.floor(F.col("frame") / 180)).alias("b"), F.col("x1"), F.col("y1"))


@query("O143", f"WITH RECURSIVE {_RUN} SELECT track, n AS run_length, a0 AS first_a, b0 AS first_b, a - a0 AS step, a, b FROM best")
def matched_run_with_drift(spark, sf_dir):
    return overlap.matched_runs(_pairs(spark, sf_dir), ["track"], "a", "b", 2, Scratch(spark, "overlap")).withColumn("run_length", F.col("run_length").cast("long"))


_OVERLAP = {"drift": 2, "confirmed_least": 8, "ambiguous_least": 3, "ambiguous_most": 7, "median_distance_most": 9, "median_difference_most": 8, "duplicate_coverage": 0.2}


@query("O143 O059", f"""WITH RECURSIVE {_RUN}, sizes AS (SELECT track, count(DISTINCT a) AS n_a, count(DISTINCT b) AS n_b FROM p GROUP BY track),
m AS (SELECT track % 40 AS track, frame // 8 AS a, frame // 8 + x1 // 200 + frame // 180 AS b, min(x1 % 18) AS distance, min(y1 % 14) AS difference FROM obs GROUP BY ALL),
g AS (SELECT track, any_value(n) AS n, median(b - a) AS off, max(b - a) AS hi, min(b - a) AS lo, median(distance) AS dist, median(difference) AS diff FROM best JOIN m USING (track, a, b) GROUP BY track),
c AS (SELECT track, n AS run_length, n / least(n_a, n_b) AS coverage, off::DOUBLE AS "offset", greatest(hi - off, off - lo)::DOUBLE AS offset_drift, dist AS median_distance, diff AS median_difference FROM sizes JOIN g USING (track))
SELECT track, run_length, round(coverage, 9) AS coverage, "offset", offset_drift, median_distance, median_difference, CASE WHEN coverage >= 0.2 AND run_length >= 8 THEN 'near_duplicate_sequence'
  WHEN run_length >= 8 AND median_distance <= 9 AND median_difference <= 8 AND offset_drift <= 2 THEN 'confirmed_temporal_overlap' WHEN run_length >= 3 THEN 'possible_ambiguous_overlap' ELSE 'incidental_similarity' END AS class FROM c""")
def overlap_classification(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    runs = overlap.matched_runs(p, ["track"], "a", "b", _OVERLAP["drift"], Scratch(spark, "overlap"))
    sizes = p.groupBy("track").agg(F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"))
    d = p.select("track", "a", "b", (F.col("x1") % 18).alias("distance"), (F.col("y1") % 14).alias("difference"))
    return overlap.overlap_classes(runs, d, sizes, ["track"], _OVERLAP).withColumn("coverage", r9(F.col("coverage")))


@query("O144 O256", f"""WITH {st.OBS}, s AS (SELECT track, min(frame) AS a, max(frame) AS b FROM obs GROUP BY track), t AS (SELECT DISTINCT track, floor(a + x * (b - a))::BIGINT AS target FROM s, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS x))
SELECT t.track, target, frame FROM t JOIN obs o ON o.track = t.track QUALIFY row_number() OVER (PARTITION BY t.track, target ORDER BY abs(frame - target), frame) = 1""")
def frame_context(spark, sf_dir):
    return evidence.nearest_frames(st.observations(spark, sf_dir), "track", "frame", [0.0, 0.25, 0.5, 0.75, 1.0])


@query("O148", f"WITH {st.OBS}, n AS (SELECT track, frame, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS place, count(*) OVER (PARTITION BY track) AS n FROM obs) SELECT track, frame, place FROM n WHERE place IN (0, n // 4, n // 2, 3 * n // 4, n - 1)")
def five_point_choice(spark, sf_dir):
    o = st.observations(spark, sf_dir).select("track", "frame")
    return evidence.at_places(o, "track", ["frame"], [(0, 1), (1, 4), (1, 2), (3, 4), (1, 1)]).withColumn("place", F.col("place").cast("long"))


@query("O150 O149", f"""WITH {st.OBS}, b AS (SELECT track, event_id, value, frame // 240 AS b FROM obs), f AS (SELECT *, (row_number() OVER (PARTITION BY track, b ORDER BY value DESC, event_id) = 1)::INT AS first FROM b)
SELECT track, event_id, row_number() OVER (PARTITION BY track ORDER BY first DESC, CASE WHEN first = 1 THEN b END, value DESC, event_id)::INT AS selection_rank FROM f QUALIFY selection_rank <= 4""")
def buckets_then_fill(spark, sf_dir):
    o = st.observations(spark, sf_dir).select("track", "event_id", "frame", "value")
    return evidence.buckets_then_fill(o, "track", F.floor(F.col("frame") / 240), [F.desc("value"), F.asc("event_id")], 4).select("track", "event_id", "selection_rank")


@query("O151 O264", f"WITH {st.OBS} SELECT track, event_id, confidence < 0.1 AS exception FROM obs QUALIFY row_number() OVER (PARTITION BY track ORDER BY confidence < 0.1, (x2 - x1) * (y2 - y1) DESC, event_id) = 1")
def single_best_observation(spark, sf_dir):
    weak = F.col("confidence") < 0.1
    w = Window.partitionBy("track").orderBy(weak, F.desc((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), "event_id")
    return st.observations(spark, sf_dir).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("track", "event_id", weak.alias("exception"))


@query("O158", f"""WITH {st.OBS}, b AS (SELECT track, min(frame) AS frame, arg_min(x1, frame) AS x, arg_max(frame, frame) AS last_frame, arg_max(x1, frame) AS last_x FROM obs GROUP BY track)
SELECT a.track, b.track AS born, abs(b.x - a.last_x) AS distance, row_number() OVER (PARTITION BY a.track ORDER BY abs(b.x - a.last_x), b.track)::INT AS rank FROM b a JOIN b ON b.frame BETWEEN a.last_frame + 1 AND a.last_frame + 5 AND b.track <> a.track QUALIFY rank <= 3""")
def nearby_births(spark, sf_dir):
    t = st.observations(spark, sf_dir).groupBy("track").agg(F.min("frame").alias("frame"), F.min_by("x1", "frame").alias("x"), F.max("frame").alias("last_frame"), F.max_by("x1", "frame").alias("last_x"))
    a = t.select("track", "last_x", (F.col("last_frame") + 1).alias("_lo"), (F.col("last_frame") + 5).alias("_hi"))
    b = t.select(F.col("track").alias("born"), "x", F.col("frame").alias("_s"), F.col("frame").alias("_e"))
    p = joins.range_join(a, b, [], ("_lo", "_hi"), ("_s", "_e"), 5).where("track <> born").withColumn("distance", F.abs(F.col("x") - F.col("last_x")))
    w = Window.partitionBy("track").orderBy("distance", "born")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("track", "born", "distance", "rank")


@query("O163", f"WITH {st.OBS} SELECT track, max(frame) - min(frame) + 1 AS span, count(*) AS n FROM obs GROUP BY track ORDER BY span DESC, track LIMIT 15")
def longest_tracks(spark, sf_dir):
    g = st.observations(spark, sf_dir).groupBy("track").agg((F.max("frame") - F.min("frame") + 1).alias("span"), n_rows().alias("n"))
    return g.orderBy(F.desc("span"), "track").limit(15)


@query("O012 O255", f"WITH {st.OBS}, c AS (SELECT frame, count(*) AS n FROM obs GROUP BY frame ORDER BY n DESC, frame LIMIT 1) SELECT track, o.frame, event_id FROM obs o, c WHERE o.frame BETWEEN c.frame - 10 AND c.frame + 10")
def window_at_busiest_frame(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    top = o.groupBy("frame").agg(n_rows().alias("n")).orderBy(F.desc("n"), "frame").limit(1).select(F.col("frame").alias("_c"))
    return o.join(F.broadcast(top), F.col("frame").between(F.col("_c") - 10, F.col("_c") + 10)).select("track", "frame", "event_id")  # one row


@query("O064 O065 O074", f"WITH {st.SESSIONS} SELECT o.event_id, s.track * 10000 + s.start AS segment FROM obs o LEFT JOIN sessions s ON s.track = o.track AND o.frame BETWEEN s.start AND s.stop")
def segment_assignment(spark, sf_dir):
    o = st.observations(spark, sf_dir).select("track", "event_id", F.col("frame").alias("_a"), F.col("frame").alias("_b"))
    s = st.sessions(spark, sf_dir).select("track", "start", "stop")
    hit = joins.range_join(o, s, ["track"], ("_a", "_b"), ("start", "stop"), 24).select(F.col("event_id").alias("_e"), (F.col("track") * 10000 + F.col("start")).alias("segment"))
    return o.join(hit, F.col("event_id") == F.col("_e"), "left").select("event_id", "segment")


@query("O079", f"WITH {st.OBS}, p AS (SELECT DISTINCT frame, 600 AS px, 320 AS py FROM obs) SELECT p.frame, px, py, o.event_id AS box FROM p LEFT JOIN (SELECT * FROM obs WHERE x1 <= 600 AND x2 > 600 AND y1 <= 320 AND y2 > 320) o ON o.frame = p.frame QUALIFY row_number() OVER (PARTITION BY p.frame ORDER BY (x2 - x1) * (y2 - y1), event_id) = 1")
def point_in_box(spark, sf_dir):
    o = st.observations(spark, sf_dir).select("frame", "event_id", "x1", "y1", "x2", "y2")
    p = o.select("frame").distinct().select("frame", F.lit(600).alias("px"), F.lit(320).alias("py"))
    return evidence.containing_box(p, o, ["frame"], "px", "py", "event_id").select("frame", "px", "py", "box")


@query("O076", f"WITH {st.OBS} SELECT a.event_id AS a, b.event_id AS b FROM obs a JOIN boxed b ON a.frame = b.frame AND abs(a.x1 + 0.0005 - b.x1) <= 0.001 AND abs(a.y1 + 0.0005 - b.y1) <= 0.001 AND abs(a.x2 - b.x2) <= 0.001 AND abs(a.y2 - b.y2) <= 0.001")
def approximate_box_lookup(spark, sf_dir):
    # Equal within the tolerance means equal or neighbouring cells of that size; whole pixels need one cell only.
    a = st.observations(spark, sf_dir).select("frame", F.col("event_id").alias("a"), (F.col("x1") + 0.0005).alias("ax1"), (F.col("y1") + 0.0005).alias("ay1"), F.col("x2").alias("ax2"), F.col("y2").alias("ay2"), F.round("x1").alias("_k"))
    b = st.boxed_events(spark, sf_dir).select("frame", F.col("event_id").alias("b"), *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")), F.col("x1").alias("_k"))
    near = lambda c: F.abs(F.col(f"a{c}") - F.col(f"b{c}")) <= 0.001
    return a.join(b, ["frame", "_k"]).where(near("x1") & near("y1") & near("x2") & near("y2")).select("a", "b")


@query("O059", f"""WITH {st.OBS}, a AS (SELECT * FROM obs WHERE class_name = 'click'), b AS (SELECT * FROM obs WHERE class_name = 'view')
SELECT a.event_id AS a, b.event_id AS b FROM a JOIN b ON md5(a.props) = md5(b.props) AND a.frame = b.frame UNION SELECT a.event_id, b.event_id FROM a JOIN b ON a.frame = b.frame AND abs(a.value - b.value) <= 5 AND abs(a.x1 - b.x1) <= 60""")
def fingerprint_overlap(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    side = lambda kind, n: o.where(F.col("class_name") == kind).select("frame", F.col("event_id").alias(n), F.md5("props").alias(f"_h{n}"), F.col("value").alias(f"_v{n}"), F.col("x1").alias(f"_x{n}"))
    p = side("click", "a").join(side("view", "b"), "frame")
    return p.where((F.col("_ha") == F.col("_hb")) | ((F.abs(F.col("_va") - F.col("_vb")) <= 5) & (F.abs(F.col("_xa") - F.col("_xb")) <= 60))).select("a", "b")


@query("O060", f"""WITH {st.OBS} SELECT a.event_id AS a, b.event_id AS b, round(abs(a.value - b.value), 6) AS distance FROM obs a JOIN obs b ON a.frame = b.frame AND a.class_name = 'click' AND b.class_name = 'view' WHERE abs(a.value - b.value) <= 50 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value - b.value), b.event_id) = 1""")
def nearest_overlap_audit(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    # Of the views of a frame only those just below and just above a click's value can be nearest: no pairs.
    a = o.where("class_name = 'click' and value is not null").select("frame", F.col("value").alias("v"), F.col("event_id").alias("a"), F.lit(None).cast("struct<v:double,b:bigint>").alias("view"))
    b = o.where("class_name = 'view' and value is not null").groupBy("frame", F.col("value").alias("v")).agg(F.min("event_id").alias("b")).select("frame", "v", F.lit(None).cast("long").alias("a"), F.struct("v", "b").alias("view"))
    near = lambda order: F.last("view", ignorenulls=True).over(Window.partitionBy("frame").orderBy(order, F.asc_nulls_first("a")).rowsBetween(Window.unboundedPreceding, 0))
    d = a.unionByName(b).withColumn("lo", near(F.asc("v"))).withColumn("hi", near(F.desc("v"))).where("a is not null")
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("v") - F.col(f"{c}.v")).alias("d"), F.col(f"{c}.b").alias("b")))
    return d.withColumn("m", F.least(away("lo"), away("hi"))).where("m.d <= 50").select("a", "m.b", r6(F.col("m.d")).alias("distance"))


@query("O063", "SELECT a.o_custkey AS o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderkey % 1000, b.o_orderkey) > (a.o_orderkey % 1000, a.o_orderkey) AND b.o_orderkey % 1000 <= a.o_orderkey % 1000 + a.o_custkey % 40")
def overlapping_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 1000).alias("start"), (F.col("o_orderkey") % 1000 + F.col("o_custkey") % 40).alias("stop"))
    return timelines.overlapping(o, ["o_custkey"], "o_orderkey", "start", "stop")


@query("O215", f"WITH {st.OBS} SELECT track, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM obs WHERE frame % 15 = 0 GROUP BY track")
def thinned_spans(spark, sf_dir):
    # Every fifteenth frame is the reference's rule for this look-up.
    return st.observations(spark, sf_dir).where(F.col("frame") % 15 == 0).groupBy("track").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), n_rows().alias("n"))


@query("O225 O257", f"WITH {st.SESSIONS} SELECT track, start, greatest(stop - 8, start) AS bridge_start, least(stop + 24, 719) AS bridge_stop, stop - 8 < start AS cut_start, stop + 24 > 719 AS cut_stop FROM sessions")
def bridge_windows(spark, sf_dir):
    a, b = F.col("stop") - 8, F.col("stop") + 24
    return st.sessions(spark, sf_dir).select("track", "start", F.greatest(a, "start").alias("bridge_start"), F.least(b, F.lit(719)).alias("bridge_stop"), (a < F.col("start")).alias("cut_start"), (b > 719).alias("cut_stop"))


@query("O226", f"WITH {st.OBS}, r AS (SELECT track, frame, x1, row_number() OVER (PARTITION BY track ORDER BY frame DESC) AS r FROM obs WHERE confidence >= 0.05) SELECT track, count(*) AS n, min(frame) AS first_frame, round((arg_max(x1, frame) - arg_min(x1, frame)) / nullif(max(frame) - min(frame), 0), 9) AS velocity FROM r WHERE r <= 6 GROUP BY track")
def bridge_templates(spark, sf_dir):
    w = Window.partitionBy("track").orderBy(F.desc("frame"))
    r = st.observations(spark, sf_dir).where("confidence >= 0.05").withColumn("_r", F.row_number().over(w)).where("_r <= 6")
    g = r.groupBy("track").agg(n_rows().alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("_b"), (F.max_by("x1", "frame") - F.min_by("x1", "frame")).alias("_d"))
    return g.select("track", "n", "first_frame", r9(F.col("_d") / F.nullif(F.col("_b") - F.col("first_frame"), F.lit(0))).alias("velocity"))


@query("O228", f"WITH {st.OBS}, g AS (SELECT track, frame, lead(frame) OVER (PARTITION BY track ORDER BY frame) AS nxt FROM obs) SELECT track, coalesce(min(frame) FILTER (nxt - frame > 5), max(frame)) AS followed_to FROM g GROUP BY track")
def continuity_probe(spark, sf_dir):
    nxt = F.lead("frame").over(Window.partitionBy("track").orderBy("frame"))
    g = st.observations(spark, sf_dir).select("track", "frame", nxt.alias("n"))
    return g.groupBy("track").agg(F.coalesce(F.min(F.when(F.col("n") - F.col("frame") > 5, F.col("frame"))), F.max("frame")).alias("followed_to"))


@query("O250", f"WITH {st.BOXED}, u AS (SELECT x2, y2 FROM boxed UNION ALL SELECT o_orderkey % 1300, o_custkey % 700 FROM orders) SELECT max(ceil(x2))::BIGINT AS width, max(ceil(y2))::BIGINT AS height FROM u")
def frame_size(spark, sf_dir):
    u = st.boxed_events(spark, sf_dir).select("x2", "y2").unionByName(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1300).alias("x2"), (F.col("o_custkey") % 700).cast("long").alias("y2")))
    return u.agg(F.max(F.ceil("x2")).cast("long").alias("width"), F.max(F.ceil("y2")).cast("long").alias("height"))


@query("O251", f"WITH {st.OBS} SELECT o.o_orderkey, coalesce(b.event_id, v.event_id) AS box, CASE WHEN b.event_id IS NOT NULL THEN 'reference' WHEN v.event_id IS NOT NULL THEN 'observed' ELSE 'missing' END AS source FROM orders o LEFT JOIN (SELECT * FROM obs WHERE confidence >= 0.2) b ON b.track = o.o_custkey AND b.frame = o.o_orderkey % 720 LEFT JOIN obs v ON v.track = o.o_custkey AND v.frame = o.o_orderkey % 720")
def box_with_fallback(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    a = o.where("confidence >= 0.2").select(F.col("track").alias("_t"), F.col("frame").alias("_f"), F.col("event_id").alias("_a"))
    b = o.select(F.col("track").alias("_u"), F.col("frame").alias("_g"), F.col("event_id").alias("_b"))
    q = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 720).alias("f"))
    d = q.join(a, (F.col("o_custkey") == F.col("_t")) & (F.col("f") == F.col("_f")), "left").join(b, (F.col("o_custkey") == F.col("_u")) & (F.col("f") == F.col("_g")), "left")
    return d.select("o_orderkey", F.coalesce("_a", "_b").alias("box"), F.when(F.col("_a").isNotNull(), "reference").when(F.col("_b").isNotNull(), "observed").otherwise("missing").alias("source"))


@query("O258", f"WITH {st.SESSIONS}, g AS (SELECT track, start, unnest(range(start, stop + 1, 2)) AS frame FROM sessions), n AS (SELECT *, row_number() OVER (PARTITION BY track, start ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY track, start) AS n FROM g) SELECT track, start, frame FROM n WHERE n <= 4 OR i IN (0, round_even((n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0), n - 1)")
def sampled_grid(spark, sf_dir):
    g = st.sessions(spark, sf_dir).select("track", "start", F.explode(F.sequence("start", "stop", F.lit(2))).alias("frame")).withColumn("k", F.concat_ws(":", "track", "start"))
    return selection.uniform_sample(g, "k", ["frame"], 4).select("track", "start", "frame")


@query("O265", f"""WITH {st.OBS}, p AS (SELECT a.event_id, max((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS shared FROM obs a JOIN obs b ON a.frame = b.frame AND a.track <> b.track AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 GROUP BY a.event_id)
SELECT o.event_id, (x2 - x1) * (y2 - y1) AS area, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / ((x2 - x1) * (y2 - y1)), 9) AS covered FROM obs o LEFT JOIN p ON p.event_id = o.event_id""")
def observation_quality(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    side = lambda n: o.select("frame", F.col("event_id").alias(f"{n}id"), F.col("track").alias(f"{n}track"), *(F.col(c).alias(f"{n}{c}") for c in ("x1", "y1", "x2", "y2")))
    p = joins.box_pairs(side("a_"), side("b_"), ["frame"], "a_", "b_", 160).where("a_track <> b_track")
    shared = (F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * (F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    g = p.groupBy("a_id").agg(F.max(shared).alias("shared"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    s = F.coalesce("shared", F.lit(0))
    return o.join(g, F.col("event_id") == F.col("a_id"), "left").select("event_id", area.alias("area"), s.alias("shared"), r9(s / area).alias("covered"))


@query("O270", f"WITH {st.BOXED} SELECT event_id, row_number() OVER (PARTITION BY frame ORDER BY x1, y1, x2, y2, confidence DESC, event_id) - 1 AS detection_index, round(confidence, 6) AS confidence FROM boxed")
def detection_order(spark, sf_dir):
    w = Window.partitionBy("frame").orderBy("x1", "y1", "x2", "y2", F.desc("confidence"), "event_id")
    return st.boxed_events(spark, sf_dir).select("event_id", (F.row_number().over(w) - 1).cast("long").alias("detection_index"), r6(F.col("confidence")).alias("confidence"))


@query("O122", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def runtime_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value")).alias("mean"), r6(F.percentile("value", 0.95)).alias("p95"))


# --- documents, labels and scores -------------------------------------------------------------------------------


@query("O005 O069 O259", "SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS without_signal, count(*) FILTER (d.doc_id IS NULL) AS without_document, count(*) FILTER (quality = 1 AND n_chars < 100) AS suspicious FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def quality_signal_join(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"), "quality")  # noqa: E741
    j = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(l, F.col("doc_id") == F.col("_l"), "full")
    d, s = F.col("doc_id").isNotNull(), F.col("_l").isNotNull()
    return j.agg(F.count_if(d & s).alias("matched"), F.count_if(~s).alias("without_signal"), F.count_if(~d).alias("without_document"), F.count_if((F.col("quality") == 1) & (F.col("n_chars") < 100)).alias("suspicious"))


@query("O006 O048", "SELECT doc_id, n_chars, length(text) AS recomputed FROM documents WHERE n_chars IS DISTINCT FROM length(text)")
def recomputed_cross_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.length("text").cast("long").alias("recomputed"))
    return d.where(~F.col("n_chars").eqNullSafe(F.col("recomputed")))


@query("O047", "SELECT o_orderkey, code FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'enum' END, CASE WHEN NOT regexp_full_match(o_orderpriority, '[1-3]-.*') THEN 'pattern' END, CASE WHEN o_totalprice <= 0 THEN 'range' END], lambda x: x IS NOT NULL)) AS code FROM orders)")
def schema_errors(spark, sf_dir):
    rules = [("enum", ~F.col("o_orderstatus").isin("O", "F")), ("pattern", ~F.col("o_orderpriority").rlike("^[1-3]-.*$")), ("range", F.col("o_totalprice") <= 0)]
    return contracts.rule_errors(table(spark, sf_dir, "orders"), ["o_orderkey"], rules)


@query("O071 O271", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS has_label, b.item_id, b.item_id IS NOT NULL AS has_item, p.url IS NOT NULL AS has_page FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id")
def canonical_items(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"), "quality")  # noqa: E741
    b, p = table(spark, sf_dir, "benchmark").select("item_id"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("_p"), "url")
    d = table(spark, sf_dir, "documents").select("doc_id").join(l, F.col("doc_id") == F.col("_l"), "left").join(b, F.col("doc_id") == F.col("item_id"), "left").join(p, F.col("doc_id") == F.col("_p"), "left")
    return d.select("doc_id", "quality", F.col("_l").isNotNull().alias("has_label"), "item_id", F.col("item_id").isNotNull().alias("has_item"), F.col("url").isNotNull().alias("has_page"))


@query("O073 O167 O261", "SELECT doc_id, 'reused' AS origin FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'recomputed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def provenance_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    l = table(spark, sf_dir, "labels").select("doc_id").distinct()  # noqa: E741
    return d.join(l, "doc_id", "left_semi").withColumn("origin", F.lit("reused")).unionByName(d.join(l, "doc_id", "left_anti").withColumn("origin", F.lit("recomputed")))


@query("O100", f"WITH {st.LABELLED}, c AS (SELECT outcome, count(*) AS n FROM labelled WHERE lang = 'en' GROUP BY outcome) SELECT outcome, n, CASE WHEN (SELECT sum(n) FROM c WHERE outcome <> 'uncertain') >= 50 THEN 'strict' ELSE 'pilot' END AS gate FROM c")
def pilot_summary(spark, sf_dir):
    c = st.labelled(spark, sf_dir).where("lang = 'en'").groupBy("outcome").agg(n_rows().alias("n"))
    known = F.sum(F.when(F.col("outcome") != "uncertain", F.col("n"))).over(Window.partitionBy())  # one row an outcome
    return c.withColumn("gate", F.when(known >= 50, "strict").otherwise("pilot"))


@query("O106", "WITH c AS (SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_length FROM documents GROUP BY ALL), s AS (SELECT source, count(DISTINCT lang) AS languages FROM documents GROUP BY source) SELECT lang, c.source, n, mean_length, languages, row_number() OVER (PARTITION BY lang ORDER BY n DESC, c.source)::INT AS rank FROM c JOIN s ON s.source = c.source WHERE lang IS NOT NULL")
def output_distribution(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    c = d.where("lang is not null").groupBy("lang", "source").agg(n_rows().alias("n"), r6(F.avg("n_chars")).alias("mean_length"))
    s = d.groupBy("source").agg(F.countDistinct("lang").alias("languages"))
    return c.join(s, "source").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source")))


@query("O107", f"""WITH {st.LABELLED}, c AS (SELECT confidence, count(*) FILTER (outcome = 'exact') AS p, count(*) AS n FROM labelled GROUP BY 1), s AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS a FROM c WINDOW o AS (ORDER BY confidence DESC))
SELECT sum(p)::BIGINT AS n_pos, round(sum(p * tp / a) / sum(p), 9) AS auprc FROM s""")
def confidence_auprc(spark, sf_dir):
    return evidence.average_precision(st.labelled(spark, sf_dir), "confidence", F.col("outcome") == "exact").withColumn("auprc", r9(F.col("auprc")))


_EXACT = "outcome = 'exact'"


@query("O113", f"WITH {st.LABELLED} SELECT count(*) FILTER (a.confidence > b.confidence) AS greater, count(*) FILTER (a.confidence = b.confidence) AS tie, count(*) FILTER (a.confidence < b.confidence) AS less FROM labelled a JOIN labelled b ON a.{_EXACT} AND NOT b.{_EXACT}")
def pairwise_ordering(spark, sf_dir):
    return evidence.ordering_counts(st.labelled(spark, sf_dir), "confidence", F.col("outcome") == "exact")


@query("O111 O268", f"WITH {st.LABELLED}, g AS (SELECT lang, min(confidence) FILTER ({_EXACT}) AS a, max(confidence) FILTER ({_EXACT}) AS b, min(confidence) FILTER (NOT {_EXACT}) AS c, max(confidence) FILTER (NOT {_EXACT}) AS d FROM labelled GROUP BY lang) SELECT lang, round(a - d, 9) AS margin, CASE WHEN greatest(a, c) <= least(b, d) THEN round(greatest(a, c), 9) END AS overlap_from, CASE WHEN greatest(a, c) <= least(b, d) THEN round(least(b, d), 9) END AS overlap_to FROM g WHERE a IS NOT NULL AND c IS NOT NULL")
def score_range_overlap(spark, sf_dir):
    of = lambda f, yes: f(F.when((F.col("outcome") == "exact") if yes else (F.col("outcome") != "exact"), F.col("confidence")))
    g = st.labelled(spark, sf_dir).groupBy("lang").agg(of(F.min, True).alias("a"), of(F.max, True).alias("b"), of(F.min, False).alias("c"), of(F.max, False).alias("d")).where("a is not null and c is not null")
    lo, hi = F.greatest("a", "c"), F.least("b", "d")
    return g.select("lang", r9(F.col("a") - F.col("d")).alias("margin"), r9(F.when(lo <= hi, lo)).alias("overlap_from"), r9(F.when(lo <= hi, hi)).alias("overlap_to"))


_MEMBERS = "CASE WHEN bool_or(outcome = 'exact') AND bool_or(outcome = 'negative') THEN 'conflicting' WHEN bool_or(outcome = 'exact') THEN 'positive' WHEN bool_or(outcome = 'negative') THEN 'negative' ELSE 'excluded' END"


@query("O118", f"WITH {st.LABELLED}, d AS (SELECT l.*, md5(text) AS h FROM labelled l JOIN documents d ON d.doc_id = l.doc_id) SELECT h, count(*) AS members, {_MEMBERS} AS label FROM d GROUP BY h")
def component_labels(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.md5("text").alias("h"))
    return st.labelled(spark, sf_dir).join(t, F.col("doc_id") == F.col("_d")).groupBy("h").agg(n_rows().alias("members"), F.expr(_MEMBERS).alias("label"))


@query("O119", f"WITH {st.LABELLED}, p AS (SELECT lang, count(*) FILTER ({_EXACT}) AS p FROM labelled GROUP BY lang) SELECT lang, k::INT AS k, round(least(k, p) / p, 9) AS ceiling FROM p, (SELECT unnest([1, 5, 10, 50]) AS k) WHERE p > 0")
def recall_ceiling(spark, sf_dir):
    p = st.labelled(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("outcome") == "exact").alias("p")).where("p > 0")
    return p.select("lang", F.explode(F.array(*(F.lit(k) for k in (1, 5, 10, 50)))).alias("k"), "p").select("lang", "k", r9(F.least(F.col("k"), F.col("p")) / F.col("p")).alias("ceiling"))


@query("O161 O164", "SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice * 100000 - l_linenumber) AS choice, max(l_extendedprice) AS confidence FROM lineitem GROUP BY l_orderkey")
def digit_choice(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.col("l_extendedprice") * 100000 - F.col("l_linenumber")).alias("choice"), F.max("l_extendedprice").alias("confidence"))


@query("O162", f"WITH {st.LABELLED} SELECT doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC NULLS LAST, doc_id)::INT AS helper_rank FROM (SELECT *, CASE WHEN n_chars >= 3000 THEN 2 WHEN n_chars >= 500 THEN 1 END AS score FROM labelled)")
def helper_rank(spark, sf_dir):
    d = st.labelled(spark, sf_dir).withColumn("score", F.when(F.col("n_chars") >= 3000, 2).when(F.col("n_chars") >= 500, 1))
    w = Window.partitionBy("lang").orderBy(F.desc_nulls_last("score"), "doc_id")
    return d.select("doc_id", "score", F.row_number().over(w).alias("helper_rank"))


@query("O174", """WITH RECURSIVE k AS (SELECT doc_id AS id, md5(text) AS h FROM documents), c AS (SELECT id, min(id) OVER (PARTITION BY h) AS root FROM k) SELECT id, printf('C%06d', dense_rank() OVER (ORDER BY root)) AS code FROM c""")
def evaluation_components(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    g = graph.groups_by_shared_keys(d, "doc_id", ["h"], Scratch(spark, "evaluation"))
    codes = windows.numbered(g.select(F.col("group").alias("_g")).distinct(), [F.col("_g")], "_n")
    return g.join(codes, F.col("group") == F.col("_g")).select("id", F.format_string("C%06d", "_n").alias("code"))


@query("O184", "SELECT vec_id, round(list_min(list_transform(range(1, 33), lambda i: embedding[2 * i - 1]))::DOUBLE * 1200, 4) AS x1, round(list_min(list_transform(range(1, 33), lambda i: embedding[2 * i]))::DOUBLE * 640, 4) AS y1, round(list_max(list_transform(range(1, 33), lambda i: embedding[2 * i - 1]))::DOUBLE * 1200, 4) AS x2, round(list_max(list_transform(range(1, 33), lambda i: embedding[2 * i]))::DOUBLE * 640, 4) AS y2 FROM embeddings")
def polygon_boxes(spark, sf_dir):
    at = lambda odd: F.filter("embedding", lambda x, i: (i % 2) == odd)
    of = lambda f, odd, scale: F.round(f(at(odd)).cast("double") * scale, 4)
    return st.vectors(spark, sf_dir).select("vec_id", of(F.array_min, 0, 1200).alias("x1"), of(F.array_min, 1, 640).alias("y1"), of(F.array_max, 0, 1200).alias("x2"), of(F.array_max, 1, 640).alias("y2"))


@query("O197", f"WITH {st.LABELLED}, m AS (SELECT median(n_chars) AS m FROM labelled WHERE quality < 0) SELECT doc_id, CASE WHEN quality = 0 THEN 'bad' WHEN quality = 1 THEN 'good' WHEN n_chars < 0.35 * m THEN 'short' ELSE 'pending' END AS class FROM labelled, m")
def quality_cascade(spark, sf_dir):
    d = st.labelled(spark, sf_dir)
    pending = evidence.relative_flag(d.where("quality < 0"), "n_chars", 0.35, "_short").select("doc_id", F.when(F.col("_short"), "short").otherwise("pending").alias("class"))
    return pending.unionByName(d.where("quality >= 0").select("doc_id", F.when(F.col("quality") == 0, "bad").otherwise("good").alias("class")))


@query("O241", "SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, (SELECT count(*) FROM documents) AS rows")
def label_blind_two_passes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = contracts.blind_projection(d, ["doc_id", "text", "n_chars"], exact=["lang", "source"])
    second = d.drop("lang", "source").select("doc_id", "text", "n_chars")
    only = lambda a, b, name: a.exceptAll(b).agg(n_rows().alias(name))
    return only(first, second, "only_first").join(only(second, first, "only_second"), how="cross").join(d.agg(n_rows().alias("rows")), how="cross")  # one row each


@query("O242", f"WITH {st.LABELLED} SELECT doc_id, concat_ws(',', CASE WHEN confidence < 0.2 THEN 'low_confidence' END, CASE WHEN n_chars < 200 THEN 'little_text' END, CASE WHEN lang IS NULL THEN 'no_language' END) AS hypotheses FROM labelled WHERE outcome = 'wrong' OR outcome = 'negative'")
def error_hypotheses(spark, sf_dir):
    h = F.concat_ws(",", F.when(F.col("confidence") < 0.2, "low_confidence"), F.when(F.col("n_chars") < 200, "little_text"), F.when(F.col("lang").isNull(), "no_language"))
    return st.labelled(spark, sf_dir).where(F.col("outcome").isin("wrong", "negative")).select("doc_id", h.alias("hypotheses"))


@query("O260 O263", f"WITH {st.LABELLED} SELECT doc_id, CASE WHEN n_chars < 100 THEN 'short' WHEN lang IS NULL THEN 'no_language' WHEN quality >= 0 THEN 'reviewed' ELSE 'scoreable' END AS status FROM labelled")
def scoreable_universe(spark, sf_dir):
    rules = [("short", F.col("n_chars") < 100), ("no_language", F.col("lang").isNull()), ("reviewed", F.col("quality") >= 0)]
    return st.labelled(spark, sf_dir).select("doc_id", eventlog.source_class(rules, "scoreable").alias("status"))


@query("O266", f"WITH {st.LABELLED}, v AS (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS cut) SELECT doc_id, cut, CASE WHEN confidence < cut THEN 'rejected' WHEN {_EXACT} THEN 'right' WHEN outcome = 'uncertain' THEN 'unknown' ELSE 'wrong' END AS result FROM labelled, v")
def ablation_outcomes(spark, sf_dir):
    d = st.labelled(spark, sf_dir).withColumn("cut", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))))
    result = F.when(F.col("confidence") < F.col("cut"), "rejected").when(F.col("outcome") == "exact", "right").when(F.col("outcome") == "uncertain", "unknown").otherwise("wrong")
    return d.select("doc_id", "cut", result.alias("result"))


@query("O269", f"WITH {st.LABELLED}, c AS (SELECT count(*) FILTER ({_EXACT}) AS p, count(*) FILTER (outcome = 'negative') AS n FROM labelled) SELECT 'recall' AS metric, p > 0 AS measurable FROM c UNION ALL SELECT 'auroc', p > 0 AND n > 0 FROM c UNION ALL SELECT 'specificity', n > 0 FROM c")
def metric_validity(spark, sf_dir):
    c = st.labelled(spark, sf_dir).agg((F.count_if(F.col("outcome") == "exact") > 0).alias("p"), (F.count_if(F.col("outcome") == "negative") > 0).alias("n"))
    row = lambda k, v: F.struct(F.lit(k).alias("metric"), v.alias("measurable"))
    return c.select(F.explode(F.array(row("recall", F.col("p")), row("auroc", F.col("p") & F.col("n")), row("specificity", F.col("n")))).alias("x")).select("x.*")


@query("O104", f"WITH {st.LABELLED} SELECT lang, outcome, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, count(*) FILTER (confidence >= 0.5) AS emitted, round(count(*) FILTER (confidence >= 0.5) / count(*), 9) AS emission_rate FROM labelled GROUP BY lang, outcome")
def evaluation_by_class(spark, sf_dir):
    sent = F.count_if(F.col("confidence") >= 0.5)
    return st.labelled(spark, sf_dir).groupBy("lang", "outcome").agg(n_rows().alias("n"), r9(F.avg("confidence")).alias("mean_confidence"), sent.alias("emitted"), r9(sent / n_rows()).alias("emission_rate"))


# --- scalar functions and compositions --------------------------------------------------------------------------


@query("O030 O034", f"""WITH {st.BOXED}, p AS (SELECT event_id, greatest(0, least(x1 - (x2 - x1) * 0.1::DOUBLE, 1200)) AS a, greatest(0, least(y1 - (y2 - y1) * 0.1::DOUBLE, 640)) AS b, greatest(0, least(x2 + (x2 - x1) * 0.1::DOUBLE, 1200)) AS c, greatest(0, least(y2 + (y2 - y1) * 0.1::DOUBLE, 640)) AS d FROM boxed)
SELECT event_id, floor(a)::BIGINT AS x1, floor(b)::BIGINT AS y1, ceil(c)::BIGINT AS x2, ceil(d)::BIGINT AS y2 FROM p""")
def padded_crop_boxes(spark, sf_dir):
    b = geo.whole(geo.padded(geo.Box.of(), 0.1, st.WIDTH, st.HEIGHT))
    return st.boxed_events(spark, sf_dir).select("event_id", *(c.cast("long").alias(n) for n, c in (("x1", b.x1), ("y1", b.y1), ("x2", b.x2), ("y2", b.y2))))


@query("O177", "SELECT o_orderkey, CASE WHEN b < c THEN c - b - 1 WHEN d < a THEN a - d - 1 ELSE 0 END AS gap, a <= d AND c <= b AS overlap FROM (SELECT o_orderkey, o_orderkey % 100 AS a, o_orderkey % 100 + o_custkey % 20 AS b, o_custkey % 100 AS c, o_custkey % 100 + o_orderkey % 20 AS d FROM orders)")
def span_relations(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spans = (k % 100, k % 100 + c % 20, c % 100, c % 100 + k % 20)
    return table(spark, sf_dir, "orders").select("o_orderkey", geo.temporal_gap(*spans).alias("gap"), geo.spans_overlap(*spans).alias("overlap"))


@query("O179 O185", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE))), 6) AS l1_reversed, round(list_sum(list_transform(embedding[1:3], lambda x: abs(x::DOUBLE))), 6) AS l1_head, round(embedding[1]::DOUBLE * embedding[2]::DOUBLE * embedding[3]::DOUBLE, 9) AS product FROM embeddings")
def vector_distances(spark, sf_dir):
    e, head = F.col("embedding"), F.slice("embedding", 1, 3)
    return st.vectors(spark, sf_dir).select("vec_id", r6(vec.l1(e, F.reverse(e))).alias("l1_reversed"), r6(vec.l1(head, F.transform(head, lambda x: F.lit(0.0)))).alias("l1_head"), r9(vec.product(F.transform(head, lambda x: x.cast("double")))).alias("product"))


@query("O186 O187 O191 O193 O198", "SELECT o_orderkey, round(o_orderkey / 1001.0::DOUBLE, 6) AS rate, round((o_orderkey + 1) / 30.0::DOUBLE, 9) AS end_seconds, o_orderpriority <> '' AS safe, printf('ORD_%07d', o_orderkey) AS code FROM orders")
def parsed_values(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(txt.frame_rate(F.concat(k.cast("string"), F.lit("/1001")))).alias("rate"), r9(txt.frame_seconds(k, 30.0, end=True)).alias("end_seconds"), txt.safe_relative_path(F.concat(F.lit("a/"), F.col("o_orderpriority"))).alias("safe"), txt.code("ORD", k, 7).alias("code"))


@query("O123 O272", "SELECT count(*) AS rows, sum(('0x' || substr(sha256(doc_id || '|' || n_chars), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS fingerprint FROM documents")
def determinism_fingerprint(spark, sf_dir):
    return contracts.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], ["n_chars"])


@query("O008 O235", f"WITH {st.SESSIONS}, c AS (SELECT track, sum(frames) AS assigned FROM sessions GROUP BY track), o AS (SELECT track, count(*) AS observed FROM obs GROUP BY track) SELECT count(*) AS tracks, sum(observed)::BIGINT AS observed, sum(assigned)::BIGINT AS assigned, count(*) FILTER (observed <> assigned) AS unequal FROM o JOIN c USING (track)")
def segment_view_counts(spark, sf_dir):
    c = st.sessions(spark, sf_dir).groupBy("track").agg(F.sum("frames").alias("assigned"))
    o = st.observations(spark, sf_dir).groupBy("track").agg(n_rows().alias("observed"))
    return o.join(c, "track").agg(n_rows().alias("tracks"), F.sum("observed").alias("observed"), F.sum("assigned").alias("assigned"), F.count_if(F.col("observed") != F.col("assigned")).alias("unequal"))


@query("O229", f"WITH {st.OBS}, k AS (SELECT track, event_id, (x2 - x1) * (y2 - y1) * confidence AS q FROM obs WHERE confidence >= 0.05 AND least(x2 - x1, y2 - y1) >= 25) SELECT track, event_id, round(q, 6) AS quality, row_number() OVER (PARTITION BY track ORDER BY q DESC, event_id)::INT AS selection_rank FROM k QUALIFY selection_rank <= 3")
def crop_selection(spark, sf_dir):
    q = geo.area(geo.Box.of()) * F.col("confidence")
    kept = st.observations(spark, sf_dir).where((F.col("confidence") >= 0.05) & (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 25)).withColumn("q", q)
    w = Window.partitionBy("track").orderBy(F.desc("q"), "event_id")
    return kept.withColumn("selection_rank", F.row_number().over(w)).where("selection_rank <= 3").select("track", "event_id", r6(F.col("q")).alias("quality"), "selection_rank")


@query("O231", f"""WITH {st.OBS}, l AS (SELECT class_name, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS p FROM obs JOIN embeddings ON vec_id = event_id), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM l GROUP BY vec_id),
m AS (SELECT class_name, p, avg(x / n) AS m, count(*) AS k FROM l JOIN n USING (vec_id) GROUP BY class_name, p), s AS (SELECT class_name, sqrt(sum(m * m)) AS s FROM m GROUP BY class_name) SELECT class_name, k AS n, p::INT AS pos, round(m / s, 6) AS v FROM m JOIN s USING (class_name)""")
def track_aggregation(spark, sf_dir):
    v = st.vectors(spark, sf_dir).join(st.observations(spark, sf_dir).select(F.col("event_id").alias("vec_id"), "class_name"), "vec_id")
    c = agg.l2_mean(v, ["class_name"], "embedding")
    return c.select("class_name", "n", F.posexplode("vector").alias("pos", "v")).withColumn("v", r6(F.col("v")))


@query("O239", f"""WITH {st.LABELLED}, c AS (SELECT confidence AS cut, count(*) FILTER ({_EXACT}) AS e, count(*) FILTER (outcome IN ('wrong', 'negative')) AS w FROM labelled WHERE lang = 'en' AND outcome <> 'uncertain' GROUP BY 1),
p AS (SELECT cut, sum(e) OVER (ORDER BY cut DESC) AS e, sum(w) OVER (ORDER BY cut DESC) AS w FROM c), g AS (SELECT min(cut) AS cut FROM p WHERE w = 0 AND e >= 1)
SELECT g.cut, count(l.doc_id) AS accepted, count(*) FILTER ({_EXACT}) AS accepted_right, count(*) FILTER (outcome IN ('wrong', 'negative')) AS accepted_wrong FROM g LEFT JOIN labelled l ON l.lang <> 'en' AND l.confidence >= g.cut GROUP BY g.cut""")
def gate_derived_and_validated(spark, sf_dir):
    d = st.labelled(spark, sf_dir)
    bad = F.col("outcome").isin("wrong", "negative")
    points = metrics.operating_points(d.where("lang = 'en' and outcome <> 'uncertain'"), "confidence", {"right": F.col("outcome") == "exact", "wrong": bad})
    gate = metrics.lowest_safe_cut(points, ["accepted_wrong"], "accepted_right").agg(F.min("cut").alias("cut"))
    rest = d.where("lang <> 'en'").withColumn("_bad", bad)
    both = F.broadcast(gate).join(rest, F.col("confidence") >= F.col("cut"), "left")  # one row
    return both.groupBy("cut").agg(F.count("doc_id").alias("accepted"), F.count_if(F.col("outcome") == "exact").alias("accepted_right"), F.count_if("_bad").alias("accepted_wrong"))


@query("O238", "WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS root FROM documents) SELECT doc_id, root, CASE WHEN substr(md5(root::VARCHAR), 1, 1) < '8' THEN 'discovery' ELSE 'holdout' END AS split FROM g")
def clean_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    g = graph.groups_by_shared_keys(d, "doc_id", ["h"], Scratch(spark, "split"))
    side = F.when(F.substring(F.md5(F.col("group").cast("string")), 1, 1) < "8", "discovery").otherwise("holdout")
    return g.select(F.col("id").alias("doc_id"), F.col("group").alias("root"), side.alias("split"))


@query("O232 O052", f"""WITH {st.OBS}, t AS (SELECT track, min(frame) AS a, max(frame) AS b, any_value(label) AS label, any_value(embedding) AS v FROM obs JOIN embeddings ON vec_id = track GROUP BY track),
c AS (SELECT x.track AS a, y.track AS b, count(*) AS shared FROM obs x JOIN obs y ON x.frame = y.frame AND x.track < y.track GROUP BY ALL)
SELECT x.track AS track_a, y.track AS track_b, coalesce(shared, 0) AS shared_frames, CASE WHEN x.b < y.a THEN y.a - x.b - 1 WHEN y.b < x.a THEN x.a - y.b - 1 ELSE 0 END AS gap, x.a <= y.b AND y.a <= x.b AS span_overlap,
CASE WHEN shared IS NULL THEN round(list_dot_product(list_transform(x.v, lambda z: z::DOUBLE), list_transform(y.v, lambda z: z::DOUBLE)), 6) END AS similarity, CASE WHEN shared IS NULL THEN 'eligible' ELSE 'rejected' END AS decision
FROM t x JOIN t y ON x.label = y.label AND x.track < y.track LEFT JOIN c ON c.a = x.track AND c.b = y.track""")
def candidate_generation(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    t = o.groupBy("track").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.collect_set("frame").alias("frames")).join(st.vectors(spark, sf_dir).withColumnRenamed("vec_id", "track"), "track")
    # Null or ragged vectors have no similarity: they are compared as vectors of length 0.
    whole = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    p = blocks.track_pairs(t.withColumn("embedding", whole), ["label"], "track", "first", "last", "frames", "embedding", 6)
    spans, free = (F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")), F.col("shared_frames") == 0
    return p.select("track_a", "track_b", "shared_frames", geo.temporal_gap(*spans).alias("gap"), geo.spans_overlap(*spans).alias("span_overlap"), F.when(free, r6(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity"))))).alias("similarity"), F.when(free, "eligible").otherwise("rejected").alias("decision"))
