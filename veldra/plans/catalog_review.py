"""Named queries over decision logs, ground truth, overlap audits and batch choices, with the same rows in DuckDB SQL.

Thresholds and names in the rules are fixed values: results must agree with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions import geometry as geo
from veldra.functions import number
from veldra.operators import bridge as motion
from veldra.operators import allocation, graph, joins, metrics, overlap, review, selection, timelines, truth
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


r9 = lambda c: number.rounded(c, 9)

# --- timelines from decisions -----------------------------------------------------------------------------------

TIMELINE_FRAMES = 20_100
_ACTIONS = ("CONFIRM_TARGET",) * 6 + ("NONE_OF_THESE", "DEFER", "REVOKE", "INVALID_SEGMENT")
_RULES = [("ACCEPTANCE_ISOLATED", "acceptance_isolated_log", "log = '5-LOW'"), ("FIXTURE_DEMO", "fixture_or_demo_decision", "log = '4-NOT SPECIFIED' AND target % 7 = 0"), ("PRODUCT_UNQUALIFIED_TEST_DECISION", "unqualified_product_test_decision_not_user_approved_for_timeline", "decision % 41 = 0")]


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as decisions: the customer is the target, the order the event, the part the segment."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_linestatus").repartition("l_orderkey")  # serves the join too
    li = lines.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("line")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_linestatus")).alias("m"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("*", "m.*")
    q = F.col("l_quantity").cast("long")
    start = (F.col("l_partkey") * 37) % 20_000
    decision = F.col("l_orderkey") * 10 + F.col("line")
    return d.select(
        F.col("o_custkey").alias("target"), F.col("l_orderkey").alias("event"), decision.alias("decision"), F.col("line").alias("revision"), F.element_at(F.array(*map(F.lit, _ACTIONS)), (q % 10 + 1).cast("int")).alias("action"),
        F.when(q % 17 != 0, F.col("l_partkey")).alias("segment"), (F.col("l_partkey") % 97 + F.when(F.col("l_suppkey") % 90 == 0, 1).otherwise(0)).alias("track"), (start + F.col("l_suppkey") % 22).alias("frame"), (q % 34 == 0).alias("direct"),
        F.when((F.col("l_linestatus") == "F") & (F.col("line") > 1), decision - 1).alias("supersedes"), decision.alias("log_pos"), F.col("o_orderpriority").alias("log"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"),
    )


_DECISIONS = f"""lines AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, l_suppkey, l_quantity::BIGINT AS q, l_discount, l_linestatus FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_linestatus) = 1),
decisions AS (SELECT o_custkey AS target, l_orderkey AS event, l_orderkey * 10 + line AS decision, line AS revision, {list(_ACTIONS)}[(q % 10 + 1)::INT] AS action, CASE WHEN q % 17 <> 0 THEN l_partkey END AS segment,
  l_partkey % 97 + (l_suppkey % 90 = 0)::INT AS track, (l_partkey * 37) % 20000 + l_suppkey % 22 AS frame, q % 34 = 0 AS direct, CASE WHEN l_linestatus = 'F' AND line > 1 THEN l_orderkey * 10 + line - 1 END AS supersedes,
  o_orderpriority AS log, round(l_discount * 100)::BIGINT AS discount FROM lines JOIN orders ON o_orderkey = l_orderkey),
segments AS (SELECT p_partkey AS segment, p_partkey % 97 AS track, (p_partkey * 37) % 20000 AS start, (p_partkey * 37) % 20000 + 20 + p_size AS stop FROM part)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("p_partkey") * 37) % 20_000
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment"), (F.col("p_partkey") % 97).alias("track"), start.alias("start"), (start + 20 + F.col("p_size")).alias("stop"))


def _log_and_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list, DataFrame]:
    """The decisions, which are read several times and so written once, the rules of sources that are kept out, the approvals."""
    d = Scratch(spark, "decisions").keep(_decisions(spark, sf_dir), "log")
    given = F.when(F.col("discount") >= 1, F.array(F.lit("APPROVED"))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("discount") >= 9, F.array(F.lit("APPROVED"), F.lit("REVOKED"))).otherwise(given)
    approvals = d.select("decision", F.posexplode(status).alias("_p", "status")).select("decision", "status", (F.col("decision") * 2 + F.col("_p")).alias("log_pos"))
    rules = [(name, why, F.expr(c)) for name, why, c in _RULES]
    return d, rules, approvals


def _timelines(spark: SparkSession, sf_dir: str) -> review.TargetTimelines:
    d, rules, approvals = _log_and_rules(spark, sf_dir)
    return review.timelines_from_decisions(d, _segments(spark, sf_dir), rules, approvals, TIMELINE_FRAMES)


_CASE = lambda at: "CASE " + " ".join(f"WHEN {r[2]} THEN '{r[at]}'" for r in _RULES)
_CLASSIFIED = f"""{_DECISIONS},
flagged AS (SELECT d.*, coalesce(decision NOT IN (SELECT supersedes FROM decisions WHERE supersedes IS NOT NULL) AND revision = (SELECT max(e.revision) FROM decisions e WHERE e.event = d.event AND e.decision NOT IN (SELECT supersedes FROM decisions WHERE supersedes IS NOT NULL)), FALSE) AS effective,
  discount BETWEEN 1 AND 8 AS approved, {_CASE(0)} END AS outside, {_CASE(1)} END AS why FROM decisions d),
classified AS (SELECT *, coalesce(outside, CASE WHEN action = 'REVOKE' THEN 'REVOKED_OR_SUPERSEDED' WHEN action = 'CONFIRM_TARGET' AND approved AND effective AND segment IS NULL AND NOT direct THEN 'INVALID_PROVENANCE' WHEN NOT effective THEN 'REVOKED_OR_SUPERSEDED' ELSE 'PRODUCT_APPROVED' END) AS source_class,
  CASE WHEN outside IS NOT NULL THEN why WHEN action = 'REVOKE' THEN 'effective_or_recorded_revoke_not_confirm' WHEN action = 'CONFIRM_TARGET' AND NOT approved THEN 'missing_product_timeline_approval'
    WHEN action = 'CONFIRM_TARGET' AND effective AND segment IS NULL AND NOT direct THEN 'confirm_missing_segment_or_direct_bbox' WHEN NOT effective THEN 'not_effective_chain_head' END AS exclusion_reason,
  outside IS NULL AND action = 'CONFIRM_TARGET' AND effective AND approved AND (segment IS NOT NULL OR direct) AS timeline_eligible FROM flagged),
linked AS (SELECT c.*, s.track AS s_track, s.start, s.stop, c.segment IS NOT NULL AND (s.segment IS NULL OR c.track <> s.track OR c.frame NOT BETWEEN s.start AND s.stop) AS wrong FROM classified c LEFT JOIN segments s ON s.segment = c.segment WHERE timeline_eligible),
blocked AS (SELECT DISTINCT target FROM linked WHERE wrong),
confirmed AS (SELECT target, decision, segment, s_track AS track, start, stop, lag(stop) OVER (PARTITION BY target ORDER BY start, stop) AS was FROM linked WHERE segment IS NOT NULL AND target NOT IN (SELECT target FROM blocked)),
marked AS (SELECT * FROM classified WHERE source_class = 'PRODUCT_APPROVED' AND effective AND target NOT IN (SELECT target FROM blocked)),
intervals AS (SELECT target, 'confirmed' AS kind, decision::VARCHAR AS id, segment, track, start, stop FROM confirmed
  UNION ALL SELECT target, 'gap', 'gap_' || (was + 1) || '_' || (start - 1), NULL, NULL, was + 1, start - 1 FROM confirmed WHERE start > was + 1
  UNION ALL SELECT target, 'unresolved_event', event::VARCHAR, NULL, NULL, 0, 0 FROM marked WHERE action IN ('NONE_OF_THESE', 'UNKNOWN', 'DEFER')
  UNION ALL SELECT target, 'invalid', decision::VARCHAR, segment, track, 0, 0 FROM marked WHERE action = 'INVALID_SEGMENT'),
bound AS (SELECT segment, count(DISTINCT target) AS n FROM confirmed GROUP BY segment HAVING count(DISTINCT target) > 1)"""


@query("O208 O213 O207", f"WITH {_CLASSIFIED} SELECT decision, effective, source_class, exclusion_reason, timeline_eligible FROM classified")
def decision_classes(spark, sf_dir):
    return review.classified(*_log_and_rules(spark, sf_dir)).select("decision", "effective", "source_class", "exclusion_reason", "timeline_eligible")


@query("O213", f"WITH {_CLASSIFIED} SELECT * FROM intervals")
def decision_timelines(spark, sf_dir):
    return _timelines(spark, sf_dir).intervals


@query("O213 O103 O062", f"""WITH {_CLASSIFIED},
unlike AS (SELECT DISTINCT target, segment, track, start, stop FROM confirmed), covered AS (SELECT target, f, count(*) AS n FROM (SELECT target, unnest(range(start, stop + 1)) AS f FROM unlike) GROUP BY ALL HAVING count(*) > 1),
islands AS (SELECT *, f - row_number() OVER (PARTITION BY target ORDER BY f) AS g FROM covered)
SELECT target, 'overlap' AS kind, NULL::BIGINT AS segment, min(f) AS start, max(f) AS stop, max(n) AS n FROM islands GROUP BY target, g
UNION ALL SELECT DISTINCT target, 'binding', segment, NULL, NULL, n FROM confirmed JOIN bound USING (segment)""")
def decision_timeline_conflicts(spark, sf_dir):
    return _timelines(spark, sf_dir).conflicts


@query("O213 O101", f"""WITH {_CLASSIFIED},
pairs AS (SELECT a.target, count(*) AS n FROM confirmed a JOIN confirmed b ON a.target = b.target AND a.decision < b.decision AND a.start <= b.stop AND b.start <= a.stop AND (a.segment, a.track) <> (b.segment, b.track) GROUP BY a.target),
shared AS (SELECT target, count(DISTINCT segment) AS n FROM confirmed JOIN bound USING (segment) GROUP BY target),
every AS (SELECT target, count(*) FILTER (timeline_eligible) AS eligible, count(*) FILTER (source_class <> 'PRODUCT_APPROVED') AS excluded FROM classified GROUP BY target),
totals AS (SELECT target, count(*) FILTER (kind = 'confirmed') AS confirmed, coalesce(sum(stop - start + 1) FILTER (kind = 'confirmed'), 0)::BIGINT AS confirmed_frames, count(*) FILTER (kind = 'gap') AS gaps, coalesce(sum(stop - start + 1) FILTER (kind = 'gap'), 0)::BIGINT AS gap_frames,
  count(*) FILTER (kind = 'unresolved_event') AS unresolved_events, count(*) FILTER (kind = 'invalid') AS invalid, count(DISTINCT track) FILTER (kind = 'confirmed') AS tracks FROM intervals GROUP BY target),
joined AS (SELECT e.target, eligible, excluded, coalesce(confirmed, 0) AS confirmed, coalesce(confirmed_frames, 0) AS confirmed_frames, coalesce(gaps, 0) AS gaps, coalesce(gap_frames, 0) AS gap_frames, coalesce(unresolved_events, 0) AS unresolved_events, coalesce(invalid, 0) AS invalid, coalesce(tracks, 0) AS tracks,
  coalesce(p.n, 0) + coalesce(s.n, 0) AS conflicts, b.target IS NOT NULL AS stopped FROM every e LEFT JOIN totals t USING (target) LEFT JOIN pairs p USING (target) LEFT JOIN shared s USING (target) LEFT JOIN blocked b ON b.target = e.target)
SELECT * EXCLUDE (stopped), round(confirmed_frames / {TIMELINE_FRAMES}::DOUBLE, 9) AS coverage,
  CASE WHEN stopped THEN 'BLOCKED' WHEN conflicts > 0 THEN 'CONFLICTED' WHEN eligible = 0 AND confirmed = 0 THEN 'NO_APPROVED_PRODUCT_DECISIONS' WHEN confirmed = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM joined""")
def decision_timeline_summary(spark, sf_dir):
    return _timelines(spark, sf_dir).summary.withColumn("coverage", r9(F.col("coverage")))


# --- a tracker against accepted truth ---------------------------------------------------------------------------

_STATES = (truth.ASSOCIATED,) * 3 + (truth.MISSED, truth.WRONG, truth.UNCERTAIN, truth.OCCLUDED)
_BLOCK = 24


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a detection of one of 16 videos; its track is one of five of the video."""
    return st.boxed_events(spark, sf_dir).withColumn("video", F.col("track") % 16).withColumn("track", F.col("event_id") % 5)


def _target_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target's box in a frame: that of the least event, moved a little."""
    first = _videos(spark, sf_dir).groupBy("video", "frame").agg(F.min(F.struct("event_id", "x1", "y1", "x2", "y2")).alias("m"))
    move = (F.col("m.event_id") % 4) * 7
    return first.select("video", "frame", *((F.col(f"m.{c}") + (move if c in ("x1", "x2") else 0)).alias(c) for c in ("x1", "y1", "x2", "y2")))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for each block of frames of a video, every third one reaching into the next block."""
    f = _videos(spark, sf_dir).groupBy("video", F.floor(F.col("frame") / _BLOCK).alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("event_id") % 3 != 0, F.col("track")))).alias("ids"))
    key = F.col("video") * 7 + F.col("id") * 3
    ids = F.when(key % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.slice("ids", 1, 3))
    state = F.element_at(F.array(*map(F.lit, _STATES)), (key % len(_STATES) + 1).cast("int"))
    return f.select("video", "id", (F.col("id") * _BLOCK).alias("start"), (F.col("id") * _BLOCK + _BLOCK - 1 + F.when(F.col("id") % 3 == 0, 5).otherwise(0)).alias("stop"), state.alias("state"), ids.alias("ids"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation log of the videos: an event for each block, now and then a label that is no revision, and acceptances."""
    t = _truth(spark, sf_dir).select("video", "id")
    kind = F.when(F.col("id") % 10 == 9, "label").when((F.col("video") % 5 != 0) & (F.col("id") % 12 == 5), "accept").otherwise("add")
    return t.select("video", F.col("id").alias("pos"), kind.alias("kind"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.scored_frames(truth.truth_frames(_truth(spark, sf_dir), "video"), _target_boxes(spark, sf_dir), _videos(spark, sf_dir), "video")


_SCORED = f"""{st.BOXED}, videos AS (SELECT *, track % 16 AS video, event_id % 5 AS tid FROM boxed),
target AS (SELECT video, frame, x1 + (event_id % 4) * 7 AS x1, y1, x2 + (event_id % 4) * 7 AS x2, y2 FROM videos QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY event_id) = 1),
blocks AS (SELECT video, frame // {_BLOCK} AS id, list_slice(list_sort(coalesce(list(DISTINCT tid) FILTER (event_id % 3 <> 0), [])), 1, 3) AS ids FROM videos GROUP BY ALL),
intervals AS (SELECT video, id, id * {_BLOCK} AS start, id * {_BLOCK} + {_BLOCK - 1} + CASE WHEN id % 3 = 0 THEN 5 ELSE 0 END AS stop, {list(_STATES)}[((video * 7 + id * 3) % {len(_STATES)} + 1)::INT] AS state, CASE WHEN (video * 7 + id * 3) % 11 = 0 THEN [] ELSE ids END AS ids FROM blocks),
log AS (SELECT video, id AS pos, CASE WHEN id % 10 = 9 THEN 'label' WHEN video % 5 <> 0 AND id % 12 = 5 THEN 'accept' ELSE 'add' END AS kind FROM blocks),
accepted AS (SELECT video, count(*) FILTER (kind <> 'label') AS revision, bool_or(kind = 'accept') AS accepted, max(pos) FILTER (kind = 'accept') AS accepted_pos FROM log GROUP BY video),
framed AS (SELECT video, unnest(range(start, stop + 1)) AS frame, start, state, ids FROM intervals),
gt AS (SELECT video, frame, state, ids FROM framed QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY start DESC) = 1),
ious AS (SELECT t.video, t.frame, tid, greatest(least(t.x2, v.x2) - greatest(t.x1, v.x1), 0) * greatest(least(t.y2, v.y2) - greatest(t.y1, v.y1), 0) AS common, (t.x2 - t.x1) * (t.y2 - t.y1) + (v.x2 - v.x1) * (v.y2 - v.y1) AS areas FROM target t JOIN videos v ON v.video = t.video AND v.frame = t.frame),
best AS (SELECT video, frame, tid FROM ious WHERE common::DOUBLE / (areas - common) >= 0.5 QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY common::DOUBLE / (areas - common) DESC, tid) = 1),
scored AS (SELECT g.video, g.frame, g.state, g.ids, b.tid AS track, CASE
  WHEN state = '{truth.ASSOCIATED}' THEN CASE WHEN list_contains(ids, tid) THEN 'correct' WHEN tid IS NOT NULL AND len(ids) > 0 THEN 'false' ELSE 'missed' END
  WHEN state = '{truth.MISSED}' THEN CASE WHEN tid IS NOT NULL THEN 'false' ELSE 'missed' END
  WHEN state = '{truth.WRONG}' THEN CASE WHEN list_contains(ids, tid) THEN 'false' WHEN tid IS NOT NULL THEN 'correct' ELSE 'missed' END ELSE 'excluded' END AS outcome
  FROM gt g LEFT JOIN best b ON b.video = g.video AND b.frame = g.frame)"""


@query("O098 O066", f"WITH {_SCORED} SELECT video, frame, state, array_to_string(ids, ',') AS ids, track, outcome FROM scored")
def truth_scored_frames(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("ids", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))


@query("O209", f"WITH {_SCORED} SELECT * FROM accepted")
def truth_acceptance(spark, sf_dir):
    return truth.acceptance(_log(spark, sf_dir), "video", "pos", "kind", silent=("label",))


#: One recursive step for each frame, so that the SQL walks the frames as the rule reads.
@query("O098 O218", f"""WITH RECURSIVE {_SCORED}, seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS i FROM scored WHERE outcome <> 'excluded'),
walk AS (SELECT DISTINCT video, 0::BIGINT AS i, NULL::BIGINT AS prev, FALSE AS in_false, FALSE AS lost, NULL::BIGINT AS lost_at, 0 AS cur, 0 AS longest, 0 AS events, 0 AS losses, 0 AS switches, 0 AS recoveries, 0::BIGINT AS waited, 0::BIGINT AS most FROM scored
  UNION ALL SELECT w.video, s.i, CASE WHEN outcome = 'correct' THEN track END, CASE WHEN outcome = 'false' THEN TRUE WHEN outcome = 'missed' OR state = '{truth.WRONG}' THEN FALSE ELSE in_false END, outcome <> 'correct',
    CASE WHEN outcome = 'correct' THEN NULL WHEN lost THEN lost_at ELSE s.frame END, CASE WHEN outcome = 'correct' THEN cur + 1 ELSE 0 END, greatest(longest, CASE WHEN outcome = 'correct' THEN cur + 1 ELSE 0 END),
    events + (outcome = 'false' AND NOT in_false)::INT, losses + (outcome <> 'correct' AND NOT lost)::INT,
    switches + coalesce(outcome = 'correct' AND prev <> track AND state = '{truth.ASSOCIATED}' AND NOT list_contains(ids, prev), FALSE)::INT,
    recoveries + (outcome = 'correct' AND lost)::INT, waited + CASE WHEN outcome = 'correct' AND lost THEN s.frame - lost_at ELSE 0 END, greatest(most, CASE WHEN outcome = 'correct' AND lost THEN s.frame - lost_at ELSE 0 END)
  FROM walk w JOIN seq s ON s.video = w.video AND s.i = w.i + 1),
ended AS (SELECT * FROM walk QUALIFY i = max(i) OVER (PARTITION BY video)),
tally AS (SELECT video, count(*) FILTER (outcome <> 'excluded') AS visible_frames, count(track) FILTER (outcome <> 'excluded') AS claimed_frames, count(*) FILTER (outcome = 'correct') AS correct_frames, count(*) FILTER (outcome = 'false') AS false_frames, count(*) FILTER (outcome = 'missed') AS missed_frames,
  count(DISTINCT track) FILTER (outcome <> 'excluded') AS fragmentation, count(*) FILTER (state = '{truth.UNCERTAIN}') AS uncertain_frames, count(*) FILTER (state = '{truth.OCCLUDED}') AS occluded_frames, count(*) FILTER (state = '{truth.OUT}') AS out_of_frame_frames, max(frame) + 1 AS frames FROM scored GROUP BY video),
m AS (SELECT a.video, accepted, t.* EXCLUDE (video), e.* EXCLUDE (video), CASE WHEN claimed_frames > 0 THEN correct_frames / claimed_frames ELSE 0 END AS precision, CASE WHEN visible_frames > 0 THEN correct_frames / visible_frames ELSE 0 END AS recall FROM accepted a JOIN tally t USING (video) JOIN ended e USING (video))
SELECT video, CASE WHEN accepted THEN 'ok' ELSE '{truth.NOT_MEASURABLE}' END AS status, {', '.join(f'CASE WHEN accepted THEN {c} END AS {a}' for c, a in [
    *((c, c) for c in ('visible_frames', 'claimed_frames', 'correct_frames', 'false_frames', 'missed_frames')), ('events', 'false_assignments'), ('losses', 'losses'), ('switches', 'false_switches'), ('recoveries', 'recoveries'), ('fragmentation', 'fragmentation'),
    ('uncertain_frames', 'uncertain_frames'), ('occluded_frames', 'occluded_frames'), ('out_of_frame_frames', 'out_of_frame_frames'), ('longest', 'longest_correct'), ('round(waited / nullif(recoveries, 0) / 30, 9)', 'recovery_mean_sec'), ('CASE WHEN recoveries > 0 THEN round(most / 30, 9) END', 'recovery_max_sec'),
    ('round(precision, 9)', 'precision'), ('round(recall, 9)', 'recall'), ('round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9)', 'f1'), ('round((events + losses) / (frames / 30 / 60), 9)', 'interventions_per_minute')])} FROM m""")
def truth_target_metrics(spark, sf_dir):
    accepted = truth.acceptance(_log(spark, sf_dir), "video", "pos", "kind", silent=("label",))
    m = truth.target_metrics(_scored(spark, sf_dir), accepted, "video", st.FPS)
    return m.withColumns({c: r9(F.col(c)) for c in ("recovery_mean_sec", "recovery_max_sec", "precision", "recall", "f1", "interventions_per_minute")})


# --- overlays, components, choices ------------------------------------------------------------------------------

_KINDS = ("HUMAN_SEED_SEGMENT", "AUTO_STITCHED_TRACKLET", "DETECTOR_SNAPPED_CONTINUATION", "UNRESOLVED_GAP")


@query("O222 O225", f"""WITH {st.SESSIONS}, k AS (SELECT track % 50 AS target, {list(_KINDS)}[((track + start) % 4 + 1)::INT] AS kind, start, stop + 6 AS stop FROM sessions),
f AS (SELECT DISTINCT target, unnest(range(start, stop + 1)) AS f, list_position({list(_KINDS)}, kind) AS p FROM k), top AS (SELECT target, f, min(p) AS p FROM f GROUP BY ALL),
i AS (SELECT *, f - row_number() OVER (PARTITION BY target, p ORDER BY f) AS g FROM top) SELECT target, {list(_KINDS)}[p] AS kind, min(f) AS start, max(f) AS stop FROM i GROUP BY target, p, g""")
def interval_overlay(spark, sf_dir):
    s = st.sessions(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("track") + F.col("start")) % 4 + 1).cast("int"))
    k = s.select((F.col("track") % 50).alias("target"), kind.alias("kind"), "start", (F.col("stop") + 6).alias("stop"))
    return timelines.overlaid(k, "target", "kind", "start", "stop", list(_KINDS))


#: Ranges of a part within its brand, and exact sizes within a type: what ties rows to one component.
_RANGED = """r AS (SELECT p_partkey AS id, p_brand AS track, CASE WHEN p_size % 3 = 0 THEN p_type || p_size || (p_partkey % 9) END AS same, (p_partkey * 37) % 4000 AS start, (p_partkey * 37) % 4000 + p_size % 12 AS stop FROM part)"""


@query("O174 O173", f"""WITH RECURSIVE {_RANGED}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.track = b.track AND a.start <= b.stop AND b.start <= a.stop UNION SELECT a.id, b.id FROM r a JOIN r b ON a.same = b.same),
walk(id, other) USING KEY (id) AS (SELECT id, id FROM r UNION SELECT e.b, min(w.other) FROM walk w JOIN e ON e.a = w.id JOIN recurring.walk k ON k.id = e.b WHERE w.other < k.other GROUP BY e.b),
g AS (SELECT w.other AS component, min(start) AS s, min(stop) AS t, min(r.id) AS i, count(*) AS size FROM walk w JOIN r USING (id) GROUP BY w.other), n AS (SELECT component, size, row_number() OVER (ORDER BY s, t, i) AS number FROM g)
SELECT id, component, number, size FROM walk w JOIN n ON n.component = w.other""")
def evaluation_components_over_ranges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    same = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")))
    start = (F.col("p_partkey") * 37) % 4000
    r = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("track"), same.alias("same"), start.alias("start"), (start + F.col("p_size") % 12).alias("stop"))
    return graph.evaluation_components(r, "id", ["same"], ["track"], "start", "stop", Scratch(spark, "evaluation"))


_BUCKETS = ("early", "middle", "late")
_CHOICE = f"""{st.BOXED}, o AS (SELECT track % 60 AS grp, event_id AS id, frame, (event_id * 2654435761) & 4294967295 AS bits, (value * 1000)::BIGINT AS v, CASE WHEN frame < 200 THEN 'early' WHEN frame < 450 THEN 'middle' WHEN frame < 700 THEN 'late' ELSE 'rest' END AS bucket FROM boxed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v DESC, id) AS rank FROM o),
turns AS (SELECT *, 1 AS pass, list_position({list(_BUCKETS)}, bucket) AS place FROM ranked WHERE bucket <> 'rest' UNION ALL SELECT *, 2, coalesce(list_position({list(_BUCKETS)}, bucket), 0) FROM ranked),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pass, CASE WHEN pass = 1 THEN place END, rank) AS i FROM turns)"""


@query("O150 O149 O180", f"""WITH RECURSIVE {_CHOICE},
fold AS (SELECT DISTINCT grp, 0::BIGINT AS i, []::STRUCT(id BIGINT, frame BIGINT, bits BIGINT, place INT)[] AS chosen, []::BIGINT[] AS frames, 0 AS gaps, 0 AS dups FROM o UNION ALL
  SELECT f.grp, s.i, CASE WHEN skip OR len(clash) > 0 THEN chosen ELSE chosen || [{{'id': id, 'frame': frame, 'bits': bits, 'place': place::INT}}] END,
    CASE WHEN pass = 1 AND NOT skip AND len(clash) = 0 THEN frames || [frame] ELSE frames END,
    gaps + CASE WHEN NOT skip AND len(clash) > 0 AND abs(clash[1].frame - frame) < 12 THEN 1 ELSE 0 END, dups + CASE WHEN NOT skip AND len(clash) > 0 AND abs(clash[1].frame - frame) >= 12 THEN 1 ELSE 0 END
  FROM (SELECT f.*, s.* EXCLUDE (grp, i), s.i AS at, len(chosen) >= 8 OR (pass = 1 AND len(list_filter(chosen, lambda c: c.place = s.place)) > 0) OR (pass = 2 AND list_contains(frames, s.frame)) AS skip,
    list_filter(chosen, lambda c: abs(c.frame - s.frame) < 12 OR bit_count(xor(c.bits, s.bits)) <= 9) AS clash FROM fold f JOIN steps s ON s.grp = f.grp AND s.i = f.i + 1) f JOIN (SELECT grp, i FROM steps) s ON s.grp = f.grp AND s.i = f.at)
SELECT grp, array_to_string(list_transform(list_sort(list_transform(chosen, lambda c: {{'frame': c.frame, 'id': c.id}})), lambda c: c.id), ',') AS selected, gaps AS suppressed_gap, dups AS suppressed_duplicate FROM fold QUALIFY i = max(i) OVER (PARTITION BY grp)""")
def suppressed_choice(spark, sf_dir):
    b = st.boxed_events(spark, sf_dir)
    frame = F.col("frame")
    bucket = F.when(frame < 200, "early").when(frame < 450, "middle").when(frame < 700, "late").otherwise("rest")
    o = b.select((F.col("track") % 60).alias("grp"), F.col("event_id").alias("id"), "frame", (F.col("event_id") * 2654435761).bitwiseAND(F.lit(4294967295)).alias("bits"), F.bround(F.col("value") * 1000).cast("long").alias("v"), bucket.alias("bucket"))
    got = selection.suppressed_choice(o, "grp", "id", "bucket", list(_BUCKETS), [F.desc("v"), F.col("id")], "frame", "bits", 8, 12, 9)
    return got.withColumn("selected", F.concat_ws(",", F.transform("selected", lambda x: x.cast("string"))))


_TRACKS = f"""{st.BOXED}, o AS (SELECT track % 16 AS video, track // 16 % 12 AS track, frame, x1, y1, x2, y2 FROM boxed QUALIFY row_number() OVER (PARTITION BY track % 16, track // 16 % 12, frame ORDER BY event_id) = 1)"""


@query("O158 O142", f"""WITH {_TRACKS}, ends AS (SELECT video, track, max(frame) AS lost, arg_max((x1 + x2) / 2, frame) AS px, arg_max((y1 + y2) / 2, frame) AS py FROM o GROUP BY ALL),
seen AS (SELECT e.video, e.track, o.track AS other, min(o.frame) AS frame, arg_min(sqrt(((o.x1 + o.x2) / 2 - px) ** 2 + ((o.y1 + o.y2) / 2 - py) ** 2), o.frame) AS far FROM ends e JOIN o ON o.video = e.video AND o.track <> e.track AND o.frame BETWEEN lost + 1 AND lost + 89 GROUP BY ALL),
births AS (SELECT *, row_number() OVER (PARTITION BY video, track ORDER BY round(far, 9), frame, other) AS r FROM seen QUALIFY r < 8),
span AS (SELECT video, track, min(frame) AS a, max(frame) AS b FROM o GROUP BY ALL), grid AS (SELECT video, track, unnest(range(a, b + 1)) AS frame FROM span),
absent AS (SELECT g.*, EXISTS (SELECT 1 FROM o WHERE o.video = g.video AND o.frame = g.frame) AND NOT EXISTS (SELECT 1 FROM o WHERE o.video = g.video AND o.frame = g.frame AND o.track = g.track) AS away FROM grid g),
runs AS (SELECT video, track, frame, frame - row_number() OVER (PARTITION BY video, track ORDER BY frame) AS g FROM absent WHERE away), pockets AS (SELECT video, track, min(frame) AS a, max(frame) AS b, row_number() OVER (PARTITION BY video, track ORDER BY min(frame)) AS r FROM runs GROUP BY video, track, g HAVING count(*) >= 3),
w AS (SELECT video, track, 0 AS k, 0::BIGINT AS r, 'selected_raw_track_end' AS kind, lost AS center, NULL::BIGINT AS other FROM ends UNION ALL SELECT video, track, 1, r, 'nearby_new_track_birth', frame, other FROM births UNION ALL SELECT video, track, 2, r, 'selected_track_absence', (a + b) // 2, NULL FROM pockets),
t AS (SELECT *, row_number() OVER (PARTITION BY video, track ORDER BY k, r) AS turn FROM w), b AS (SELECT video, track, list({{'kind': kind, 'center': center, 'other': other}} ORDER BY turn) AS ws FROM t WHERE turn <= 8 GROUP BY ALL),
kept AS (SELECT video, track, list_reduce(list_prepend([ws[1]], list_transform(ws[2:], lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: abs(c.center - x[1].center) < 10)) > 0 THEN acc ELSE acc || x END) AS ws FROM b)
SELECT video, track, x.kind AS kind, x.center AS center, x.other AS other, position FROM (SELECT video, track, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS position FROM kept)""")
def failure_windows(spark, sf_dir):
    b = st.boxed_events(spark, sf_dir).withColumn("video", F.col("track") % 16).withColumn("track", F.floor(F.col("track") / 16) % 12)
    o = b.groupBy("video", "track", "frame").agg(F.min(F.struct("event_id", "x1", "y1", "x2", "y2")).alias("m")).select("video", "track", "frame", "m.x1", "m.y1", "m.x2", "m.y2")
    return selection.failure_windows(o, "video", o.select("video", "track").distinct(), 8, 89, 3, 10)


STRATA = ("low", "mid", "high")
BATCHES = [allocation.Batch(f"batch_{i}", dict(zip(STRATA, (8, 8, 8), strict=True)), first) for i, first in enumerate((10, 9, 8, 7))]
CAPS = allocation.Caps(2, 3, 24)


def allocation_items(spark, sf_dir):
    """Every event as an item: its stratum from the value, a third of them from the scarce source, groups of a few events."""
    b = st.boxed_events(spark, sf_dir)
    stratum = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "mid").otherwise("high")
    source = F.when(F.col("event_id") % 3 == 0, "recomputed").otherwise("reused")
    return b.select(F.col("event_id").alias("id"), stratum.alias("stratum"), source.alias("source"), (F.col("track") * 10 + F.floor(F.col("frame") / 100)).alias("segment"), "track", "frame", F.floor(F.col("frame") / 72).alias("bin"), F.floor(F.col("event_id") / (2 + F.col("track") % 3)).alias("grp"))


@query("O153 O162")  # each choice depends on all before it; tests hold it against a plain fold
def batch_allocation(spark, sf_dir):
    """Items of four batches by quotas of strata and sources, in the order in which they were chosen."""
    return allocation.allocate(allocation_items(spark, sf_dir), "recomputed", BATCHES, ["low", "mid", "high"], ["high", "mid", "low"], CAPS, Scratch(spark, "allocation"))


@query("O154 O121", f"""WITH {st.BOXED}, c AS (SELECT 'batch_' || (track % 4) AS batch, least(24, count(DISTINCT track // 4)) AS most FROM boxed WHERE event_id % 3 = 0 GROUP BY 1), n AS (SELECT max(most) FILTER (batch = 'batch_0') AS h1, max(most) FILTER (batch = 'batch_1') AS h2, max(most) FILTER (batch = 'batch_2') AS h3, max(most) FILTER (batch = 'batch_3') AS h4 FROM c),
v AS (SELECT n.*, a.v AS v1, b.v AS v2, d.v AS v3, least(40, h1 + h2 + h3 + h4) AS total, least(40, h1 + h2 + h3 + h4) - a.v - b.v - d.v AS v4 FROM n, (SELECT unnest(range(25)) AS v) a, (SELECT unnest(range(25)) AS v) b, (SELECT unnest(range(25)) AS v) d),
k AS (SELECT *, round(abs(v1 / h1 - 1 / 3.0::DOUBLE) + abs(v2 / h2 - 1 / 3.0::DOUBLE) + abs(v3 / h3 - 1 / 3.0::DOUBLE) + abs(v4 / h4 - 1 / 3.0::DOUBLE), 9) AS off, round(abs((v1 + v2) / (h1 + h2) - (v3 + v4) / (h3 + h4)), 9) AS half FROM v WHERE v1 BETWEEN 2 AND h1 AND v2 BETWEEN 2 AND h2 AND v3 BETWEEN 2 AND h3 AND v4 BETWEEN 2 AND h4)
SELECT v1, v2, v3, v4, total, row_number() OVER (ORDER BY off, half, v1 + v3 DESC, v1 DESC, v2 DESC, v3 DESC, v4 DESC) AS rank FROM k""")
def quota_vectors(spark, sf_dir):
    b = st.boxed_events(spark, sf_dir).where(F.col("event_id") % 3 == 0)
    most = F.least(F.lit(24), F.count_distinct(F.floor(F.col("track") / 4)))
    c = b.groupBy(F.concat(F.lit("batch_"), (F.col("track") % 4).cast("string")).alias("batch")).agg(most.alias("most")).withColumn("least", F.lit(2))
    return allocation.ranked_quota_vectors(c, "batch", "least", "most", 1 / 3, 40)


SPLIT = {f"batch_{i}": {"low": 5, "mid": 4, "high": 3} for i in range(4)}
SPLIT_LEAST = {b: 2 for b in SPLIT}
SPLIT_CAPS = allocation.Caps(1, 2, 48)


def split_inputs(spark, sf_dir):
    """Events as items, some with a shared key, and edges of near duplicates: one bit of 32 apart."""
    items = allocation_items(spark, sf_dir).drop("grp").withColumn("shot", F.when(F.col("id") % 5 == 0, F.col("track") * 1000 + F.floor(F.col("frame") / 5)))
    bits = items.select("id", (F.col("id") * 2654435761).bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits"))
    return items, joins.hamming_pairs(bits, "id", "bits", 1, 32)


@query("O238 O153 O154 O173 O121")  # tests hold it against union-find and a plain fold
def clean_split_batches(spark, sf_dir):
    """Leakage groups, the search for quotas, and four batches without a group in two of them."""
    items, edges = split_inputs(spark, sf_dir)
    return allocation.clean_split(items, edges, ["shot"], "recomputed", SPLIT, SPLIT_LEAST, ["low", "mid", "high"], ["high", "mid", "low"], SPLIT_CAPS, Scratch(spark, "split"))[0]


@query("O190", "SELECT c_custkey, printf('%.17g', c_acctbal / 7.0::DOUBLE) AS text FROM customer")
def exact_doubles(spark, sf_dir):
    """17 significant digits of computed balances, which give the very double back."""
    return table(spark, sf_dir, "customer").select("c_custkey", number.double_text(F.col("c_acctbal") / F.lit(7.0)).alias("text"))


_BRIDGE = f"""{st.BOXED}, det AS (SELECT track % 16 AS video, frame // 3 AS frame, event_id AS track, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, ['YELLOW', 'UNKNOWN', 'WHITE'][(event_id % 3 + 1)::INT] AS kit, event_id % 2 = 0 AS reliable, event_id % 29 = 0 AS excluded FROM boxed),
vf AS (SELECT DISTINCT video, frame FROM det), flow AS (SELECT video * 100 + frame // 12 AS bridge, video, frame, (video + frame) % 7 <> 0 AS reliable, (frame % 5) - 2.0 AS dx, (frame % 3) - 1.0 AS dy FROM vf),
firsts AS (SELECT bridge, any_value(video) AS video, min(frame) AS frame FROM flow GROUP BY bridge),
seeds AS (SELECT bridge, x1 - 4 AS x1, y1 + 3 AS y1, x2 - 4 AS x2, y2 + 3 AS y2, 1.5::DOUBLE AS vx, -0.5::DOUBLE AS vy FROM firsts f JOIN det d ON d.video = f.video AND d.frame = f.frame QUALIFY row_number() OVER (PARTITION BY bridge ORDER BY track) = 1),
steps AS MATERIALIZED (SELECT f.*, row_number() OVER (PARTITION BY bridge ORDER BY frame) AS i FROM flow f)"""


@query("O227 O226", f"""WITH RECURSIVE {_BRIDGE},
fold AS (SELECT bridge, 0::BIGINT AS i, x1, y1, x2, y2, vx, vy, 0 AS run, 0 AS lost, FALSE AS done, NULL::BIGINT AS frame, NULL::VARCHAR AS status, NULL::BIGINT AS track, x1 AS ox1, y1 AS oy1, x2 AS ox2, y2 AS oy2 FROM seeds UNION ALL
  SELECT bridge, i, CASE WHEN snap THEN b.x1 WHEN clear THEN kx1 ELSE px1 END, CASE WHEN snap THEN b.y1 WHEN clear THEN ky1 ELSE py1 END, CASE WHEN snap THEN b.x2 WHEN clear THEN kx2 ELSE px2 END, CASE WHEN snap THEN b.y2 WHEN clear THEN ky2 ELSE py2 END, vx, vy,
    CASE WHEN snap THEN run + 1 ELSE 0 END, lost + (NOT reliable)::INT, (snap AND run + 1 >= 3) OR lost + (NOT reliable)::INT >= 5, frame,
    CASE WHEN snap AND run + 1 >= 3 THEN 'BRIDGE_ACCEPTED' WHEN snap THEN 'DETECTOR_SNAP' WHEN clear OR reliable THEN 'TARGET_UNRESOLVED' ELSE 'BRIDGE_FLOW_UNRELIABLE' END,
    CASE WHEN snap THEN b.track END, CASE WHEN snap THEN b.x1 ELSE px1 END, CASE WHEN snap THEN b.y1 ELSE py1 END, CASE WHEN snap THEN b.x2 ELSE px2 END, CASE WHEN snap THEN b.y2 ELSE py2 END
  FROM (SELECT *, able[1] AS b, coalesce(len(able) = 1 OR (len(able) > 1 AND able[2].cost - able[1].cost >= 0.08), FALSE) AS clear, coalesce(len(able) = 1 OR (len(able) > 1 AND able[2].cost - able[1].cost >= 0.08), FALSE) AND reliable AS snap FROM (
    SELECT p.bridge, p.i, p.frame, p.reliable, p.kx1, p.ky1, p.kx2, p.ky2, p.px1, p.py1, p.px2, p.py2, p.vx, p.vy, p.run, p.lost,
      list({{'cost': -round(0.55 * iou + 0.35 * greatest(0, 1 - far / 80) + CASE kit WHEN 'YELLOW' THEN 0.08 WHEN 'UNKNOWN' THEN 0.02 ELSE 0 END, 9), 'track': d_track, 'x1': d1, 'y1': e1, 'x2': d2, 'y2': e2}} ORDER BY round(0.55 * iou + 0.35 * greatest(0, 1 - far / 80) + CASE kit WHEN 'YELLOW' THEN 0.08 WHEN 'UNKNOWN' THEN 0.02 ELSE 0 END, 9) DESC, d_track)
        FILTER (d_track IS NOT NULL AND NOT excluded AND NOT (kit = 'WHITE' AND sure) AND far <= 80 AND NOT (iou < 0.1 AND far > 40) AND ca / pa BETWEEN 0.5 AND 2 AND ca > 1) AS able
    FROM (SELECT q.*, d.track AS d_track, d.x1 AS d1, d.y1 AS e1, d.x2 AS d2, d.y2 AS e2, d.kit, d.reliable AS sure, d.excluded, (d.x2 - d.x1) * (d.y2 - d.y1) AS ca, (px2 - px1) * (py2 - py1) AS pa,
        sqrt(((px1 + px2 - d.x1 - d.x2) / 2) ** 2 + ((py1 + py2 - d.y1 - d.y2) / 2) ** 2) AS far, greatest(least(px2, d.x2) - greatest(px1, d.x1), 0) * greatest(least(py2, d.y2) - greatest(py1, d.y1), 0) / ((px2 - px1) * (py2 - py1) + (d.x2 - d.x1) * (d.y2 - d.y1) - greatest(least(px2, d.x2) - greatest(px1, d.x1), 0) * greatest(least(py2, d.y2) - greatest(py1, d.y1), 0)) AS iou
      FROM (SELECT f.bridge, s.i, s.frame, s.video, s.reliable, f.x1 AS kx1, f.y1 AS ky1, f.x2 AS kx2, f.y2 AS ky2, f.vx, f.vy, f.run, f.lost, f.x1 + CASE WHEN s.reliable THEN dx ELSE vx END AS px1, f.y1 + CASE WHEN s.reliable THEN dy ELSE vy END AS py1, f.x2 + CASE WHEN s.reliable THEN dx ELSE vx END AS px2, f.y2 + CASE WHEN s.reliable THEN dy ELSE vy END AS py2
        FROM fold f JOIN steps s ON s.bridge = f.bridge AND s.i = f.i + 1 WHERE NOT f.done) q LEFT JOIN det d ON d.video = q.video AND d.frame = q.frame) p GROUP BY ALL)))
SELECT bridge, frame, status, track, ox1 AS x1, oy1 AS y1, ox2 AS x2, oy2 AS y2 FROM fold WHERE i > 0""")
def bridge_steps(spark, sf_dir):
    """Bridges of a dozen frames in sixteen videos, seeded near a detection of their first frame."""
    b = st.boxed_events(spark, sf_dir)
    kit = F.element_at(F.array(F.lit("YELLOW"), F.lit("UNKNOWN"), F.lit("WHITE")), (F.col("event_id") % 3 + 1).cast("int"))
    box = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    det = b.select((F.col("track") % 16).alias("video"), F.floor(F.col("frame") / 3).alias("frame"), F.col("event_id").alias("track"), *box, kit.alias("kit"), (F.col("event_id") % 2 == 0).alias("reliable"), (F.col("event_id") % 29 == 0).alias("excluded"))
    bridge = F.col("video") * 100 + F.floor(F.col("frame") / 12)
    det = det.withColumn("bridge", bridge)
    flow = det.select("bridge", "video", "frame").distinct().select("bridge", "frame", ((F.col("video") + F.col("frame")) % 7 != 0).alias("reliable"), (F.col("frame") % 5 - 2.0).alias("dx"), (F.col("frame") % 3 - 1.0).alias("dy"))
    first = det.groupBy("bridge").agg(F.min(F.struct("frame", "track", "x1", "y1", "x2", "y2")).alias("m"))
    seeds = first.select("bridge", (F.col("m.x1") - 4).alias("x1"), (F.col("m.y1") + 3).alias("y1"), (F.col("m.x2") - 4).alias("x2"), (F.col("m.y2") + 3).alias("y2"), F.lit(1.5).alias("vx"), F.lit(-0.5).alias("vy"))
    return motion.carried(seeds, flow, det, "bridge")


# --- prints, ties, cross-checks ---------------------------------------------------------------------------------

_MASK = (1 << 48) - 1


def _prints(spark, sf_dir):
    """Every event as a sample of one of 40 sequences: its hashes are those of its kind and value, with a few bits changed."""
    b = st.boxed_events(spark, sf_dir)
    level = F.floor(F.col("value") / 2)
    base = (level * 2654435761 * 40503 + F.length("class_name") * 77731).bitwiseAND(F.lit(_MASK))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    bits = base.bitwiseXOR(F.when(F.col("event_id") % 3 != 0, one(F.col("event_id") % 48)).otherwise(0).cast("long"))
    edge = (level * 40503).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.when(F.col("event_id") % 2 == 0, one(F.col("event_id") % 16)).otherwise(0).cast("long"))
    gray = F.array(level, level + F.col("event_id") % 9, F.col("x1") % 12, F.col("y1") % 8)
    return b.select((F.col("track") % 40).alias("video"), F.col("event_id").alias("id"), F.md5(F.concat("class_name", level.cast("string"), (F.col("event_id") % 2).cast("string"))).alias("sha"), bits.alias("bits"), edge.alias("edge"), gray.alias("gray"))


_PRINTS = f"""{st.BOXED}, f AS (SELECT *, floor(value / 2)::BIGINT AS level FROM boxed),
prints AS (SELECT track % 40 AS video, event_id AS id, md5(class_name || level || (event_id % 2)) AS sha, xor((level * 2654435761 * 40503 + length(class_name) * 77731) & {_MASK}, CASE WHEN event_id % 3 <> 0 THEN 1::BIGINT << (event_id % 48) ELSE 0 END) AS bits,
  xor((level * 40503) & 65535, CASE WHEN event_id % 2 = 0 THEN 1::BIGINT << (event_id % 16) ELSE 0 END) AS edge, [level, level + event_id % 9, x1 % 12, y1 % 8] AS gray FROM f),
pairs AS (SELECT a.video, a.id AS a, b.id AS b, a.sha = b.sha AS exact, bit_count(xor(a.bits, b.bits))::INT AS distance, bit_count(xor(a.edge, b.edge))::INT AS edge_distance, list_sum(list_transform(range(1, 5), lambda i: abs(a.gray[i] - b.gray[i]))) / 4.0::DOUBLE AS difference FROM prints a JOIN prints b ON b.video = a.video + 1)"""


def _sides(spark, sf_dir):
    p = _prints(spark, sf_dir)
    return p, p.withColumn("video", F.col("video") - 1)


@query("O059 O180", f"WITH {_PRINTS} SELECT * FROM pairs WHERE exact OR (distance <= 2 AND edge_distance <= 1 AND difference <= 4)")
def fingerprint_matches(spark, sf_dir):
    return overlap.fingerprint_matches(*_sides(spark, sf_dir), ["video"], 48, 2, 1, 4.0)


@query("O060", f"WITH {_PRINTS} SELECT video, a, b, distance, difference, difference <= 3 AS same FROM pairs WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY video, a ORDER BY distance, b) = 1")
def nearest_prints(spark, sf_dir):
    return overlap.nearest_prints(*_sides(spark, sf_dir), ["video"], 48, 2, 3.0)


@query("O164", f"""WITH RECURSIVE {st.BOXED}, r AS (SELECT track, event_id AS id, floor(value) + (event_id % 7) * 1e-8 AS v, row_number() OVER (PARTITION BY track ORDER BY event_id) AS i FROM boxed),
walk AS (SELECT track, i, id, v FROM r WHERE i = 1 UNION ALL SELECT w.track, r.i, CASE WHEN r.v > w.v AND abs(r.v - w.v) > 1e-9 * greatest(abs(r.v), abs(w.v)) THEN r.id ELSE w.id END, CASE WHEN r.v > w.v AND abs(r.v - w.v) > 1e-9 * greatest(abs(r.v), abs(w.v)) THEN r.v ELSE w.v END FROM walk w JOIN r ON r.track = w.track AND r.i = w.i + 1)
SELECT track, id, round(v, 6) AS value FROM walk QUALIFY row_number() OVER (PARTITION BY track ORDER BY i DESC) = 1""")
def argmax_with_ties(spark, sf_dir):
    b = st.boxed_events(spark, sf_dir).select("track", "event_id", (F.floor("value") + (F.col("event_id") % 7) * F.lit(1e-8)).alias("v"))
    return metrics.argmax_with_ties(b, ["track"], "v", "event_id").withColumn("value", number.rounded("value", 6))


@query("O006 O048", "SELECT o_orderkey, l_orderkey IS NOT NULL AS found, round(abs(o_totalprice - coalesce(total, 0)), 2) AS off, coalesce(abs(o_totalprice - total) <= 1e-6 * greatest(abs(o_totalprice), abs(total)), FALSE) AS agrees FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def tolerance_cross_check(spark, sf_dir):
    """Stored totals against those recomputed from their parts, within a relative tolerance; what has no parts is named."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"))
    d = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    off = F.abs(F.col("o_totalprice") - F.col("total"))
    return d.select("o_orderkey", F.col("l_orderkey").isNotNull().alias("found"), F.round(F.abs(F.col("o_totalprice") - F.coalesce("total", F.lit(0.0))), 2).alias("off"), F.coalesce(off <= 1e-6 * F.greatest(F.abs("o_totalprice"), F.abs("total")), F.lit(False)).alias("agrees"))


_CLASSES = {"legible_exact": "quality = 1 AND toxic = 0 AND n_chars >= 1000", "legible_partial": "quality = 1 AND toxic = 0 AND n_chars < 1000", "illegible": "quality = 0 AND toxic = 0", "excluded": "toxic = 1", "unreviewed": "quality IS NULL"}


@query("O044", "WITH d AS (SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _CLASSES.items()) + " END AS class FROM d")
def manual_classes(spark, sf_dir):
    """The one class whose rule a row meets; a row that meets none or several is an error."""
    from veldra.operators.contracts import exactly_one

    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "quality", "toxic")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(y, F.col("doc_id") == F.col("_d"), "left")
    return d.select("doc_id", exactly_one({k: F.expr(c) for k, c in _CLASSES.items()}).alias("class"))


@query("O035", f"""WITH {st.BOXED}, c AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM boxed), r AS (SELECT *, floor(w / 2.0 * 0.2::DOUBLE)::BIGINT AS a1, floor(h / 2.0 * 0.15::DOUBLE)::BIGINT AS b1, ceil(w / 2.0 * 0.8::DOUBLE)::BIGINT AS a2, ceil(h / 2.0 * 0.55::DOUBLE)::BIGINT AS b2 FROM c)
SELECT event_id, greatest(x1, x1 + floor(a1 * (w / (w / 2.0::DOUBLE))))::BIGINT AS fx1, greatest(y1, y1 + floor(b1 * (h / (h / 2.0::DOUBLE))))::BIGINT AS fy1, least(x2, x1 + ceil(a2 * (w / (w / 2.0::DOUBLE))))::BIGINT AS fx2, least(y2, y1 + ceil(b2 * (h / (h / 2.0::DOUBLE))))::BIGINT AS fy2 FROM r""")
def regions_in_frame(spark, sf_dir):
    """A torso region measured in a crop of half the size, back in the frame."""
    b = st.boxed_events(spark, sf_dir)
    w, h = (F.col("x2") - F.col("x1")) / 2.0, (F.col("y2") - F.col("y1")) / 2.0
    region = geo.Box(F.floor(w * 0.2), F.floor(h * 0.15), F.ceil(w * 0.8), F.ceil(h * 0.55))
    f = geo.in_frame(region, geo.Box.of(), w, h)
    return b.select("event_id", *(c.cast("long").alias(n) for c, n in zip((f.x1, f.y1, f.x2, f.y2), ("fx1", "fy1", "fx2", "fy2"), strict=True)))


# --- provisional timelines and target states --------------------------------------------------------------------


def _reviewed(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    s = _segments(spark, sf_dir).select(F.col("segment").alias("_s"), "start", "stop")
    return d.join(s, F.col("segment") == F.col("_s"), "left").drop("_s")


_PROVISIONAL = f"""{_DECISIONS}, d AS (SELECT d.*, s.start, s.stop, discount BETWEEN 1 AND 8 AS approved FROM decisions d LEFT JOIN segments s ON s.segment = d.segment),
p AS (SELECT *, last_value(CASE WHEN action = 'CONFIRM_TARGET' AND start IS NOT NULL THEN decision END IGNORE NULLS) OVER (PARTITION BY target ORDER BY decision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM d),
provisional AS (SELECT target, 'human_' || decision AS id, CASE WHEN approved THEN 'VERIFIED' ELSE 'HUMAN VERIFIED' END AS status, decision, segment, track, start, CASE WHEN approved THEN stop ELSE start END AS stop, approved, approved AS eligible FROM d WHERE action = 'CONFIRM_TARGET' AND start IS NOT NULL
  UNION ALL SELECT target, 'continuation_' || decision, 'TRACKER CONTINUATION', decision, segment, track, start, stop, approved, approved FROM d WHERE action = 'CONFIRM_TARGET' AND stop > start
  UNION ALL SELECT p.target, 'unresolved_' || p.decision, 'UNRESOLVED', p.decision, q.segment, q.track, p.frame, p.frame, p.approved, FALSE FROM p LEFT JOIN d q ON q.decision = p.prior WHERE p.action IN ('NONE_OF_THESE', 'UNKNOWN', 'DEFER'))"""


@query("O211 O212", f"WITH {_PROVISIONAL} SELECT * FROM provisional")
def provisional_intervals(spark, sf_dir):
    d = _reviewed(spark, sf_dir)
    return review.provisional_intervals(d, d.where(F.col("discount").between(1, 8)).select("decision"))


@query("O211", f"""WITH {_PROVISIONAL}, l AS (SELECT target, arg_max(CASE WHEN start IS NOT NULL THEN track END, decision) AS track, arg_max(stop, decision) AS stop FROM d WHERE action = 'CONFIRM_TARGET' GROUP BY target),
t AS (SELECT target, bool_or(action IN ('NONE_OF_THESE', 'UNKNOWN', 'DEFER')) AS open, max(frame) AS now FROM d GROUP BY target)
SELECT t.target, CASE WHEN open AND (track IS NULL OR coalesce(now > stop, FALSE)) THEN 'UNRESOLVED' WHEN track IS NULL THEN 'REVIEW REQUIRED' WHEN coalesce(now > stop, FALSE) THEN 'LOST' ELSE 'TRACKING' END AS status FROM t LEFT JOIN l USING (target)""")
def selection_statuses(spark, sf_dir):
    d = _reviewed(spark, sf_dir)
    known = F.when((F.col("action") == review.CONFIRM) & F.col("start").isNotNull(), F.struct(F.col("decision"), "track", "stop"))
    g = d.groupBy("target").agg(F.max(known).alias("l"), F.bool_or(F.col("action").isin(*review.UNRESOLVED)).alias("open"), F.max("frame").alias("now"))
    return g.select("target", review.selection_status(F.col("l.track"), F.col("l.stop"), F.col("now"), F.col("open")).alias("status"))


_SOURCES = ("HUMAN_SEED", "AUTO_STITCHED_TRACKLET", "UNRESOLVED_GAP")
_TARGET_STATUSES = ("TARGET_TRACKING", "TARGET_REVIEW_REQUIRED", "TARGET_UNRESOLVED")
_HINTS = (*_TARGET_STATUSES, "NOTE")


@query("O221", f"""WITH {st.OBS}, o AS (SELECT track % 50 AS target, event_id, frame, {list(_SOURCES)}[(event_id % 3 + 1)::INT] AS source, CASE WHEN event_id % 3 <> 2 THEN track END AS track, {list(_HINTS)}[(event_id % 4 + 1)::INT] AS hint FROM obs)
SELECT target, event_id, last_value(track IGNORE NULLS) OVER w AS current_track, last_value(CASE WHEN hint <> 'NOTE' THEN hint END IGNORE NULLS) OVER w AS target_status FROM o WINDOW w AS (PARTITION BY target ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def target_states(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    o = o.select((F.col("track") % 50).alias("target"), "event_id", pick(_SOURCES, 3).alias("source"), F.when(F.col("event_id") % 3 != 2, F.col("track")).alias("track"), pick(_HINTS, 4).alias("hint"))
    return review.target_states(o, "target", "event_id", "source", "track", "hint", list(_SOURCES), list(_TARGET_STATUSES)).select("target", "event_id", "current_track", "target_status")


_NOT_IN = lambda acc: f"list_filter(r, lambda x: len(list_filter({acc}, lambda q: q.j = x.j)) = 0)"


@query("O149 O147", f"""WITH {st.OBS}, o AS (SELECT track % 60 AS grp, event_id AS id, frame, (x1 <= 200)::INT + (y1 <= 100)::INT AS edge, (event_id % 5) / 10.0::DOUBLE AS overlap, (x2 - x1) * (y2 - y1) AS area, value FROM obs),
k AS (SELECT grp, {{'k1': edge::BIGINT, 'k2': overlap, 'k3': -area::DOUBLE, 'k4': (area >= 2000)::INT + (area >= 6000)::INT + (area >= 15000)::INT, 'k5': -value, 'frame': frame::BIGINT, 'id': id, 'j': row_number() OVER (PARTITION BY grp ORDER BY frame, id) - 1}} AS x FROM o),
g AS (SELECT grp, list(x ORDER BY x.j) AS r, least(6, count(*)) AS k, max(x.frame) - min(x.frame) AS span, count(*) AS n FROM k GROUP BY grp),
w AS (SELECT *, greatest(1, ceil(span / (2 * k)))::BIGINT AS w, greatest(1, ceil(n / (2 * k)))::BIGINT AS iw, CASE WHEN span > 0 THEN greatest(1, floor(span / (3 * k)))::BIGINT ELSE 1 END AS gap, list_transform(range(k), lambda i: round_even(i * (n - 1) / greatest(1, k - 1)::DOUBLE, 0)::BIGINT) AS slots FROM g),
p AS (SELECT *, list_reduce(list_prepend([]::STRUCT(k1 BIGINT, k2 DOUBLE, k3 DOUBLE, k4 INT, k5 DOUBLE, frame BIGINT, id BIGINT, j BIGINT)[], list_transform(slots, lambda s: [r[s + 1]])), lambda acc, s: acc || [coalesce(
  list_sort(list_filter({_NOT_IN('acc')}, lambda x: abs(x.j - s[1].j) <= iw OR abs(x.frame - s[1].frame) <= w))[1], list_sort({_NOT_IN('acc')})[1])]) AS p FROM w),
f AS (SELECT *, list_reduce(list_transform(list_sort(list_transform(p, lambda x, i: {{'f': x.frame, 'i': i, 'x': x}})), lambda o: [o.x]), lambda acc, o: CASE WHEN abs(o[1].frame - acc[-1].frame) < gap AND o[1] < acc[-1] THEN acc[:-2] || o WHEN abs(o[1].frame - acc[-1].frame) < gap THEN acc ELSE acc || o END) AS f FROM p),
b AS (SELECT *, list_reduce(list_prepend(f, list_transform(list_sort({_NOT_IN('f')}), lambda x: [x])), lambda acc, o: CASE WHEN len(acc) >= k OR len(list_filter(acc, lambda q: abs(q.frame - o[1].frame) < gap)) > 0 THEN acc ELSE acc || o END) AS b FROM f),
c AS (SELECT *, list_reduce(list_prepend(b, list_transform(list_sort({_NOT_IN('b')}), lambda x: [x])), lambda acc, o: CASE WHEN len(acc) >= least(4, n) THEN acc ELSE acc || o END) AS c FROM b),
u AS (SELECT grp, k, unnest(c) AS x FROM c) SELECT grp, x.id AS id, x.frame AS frame, (row_number() OVER (PARTITION BY grp ORDER BY x.frame, x.id) - 1)::INT AS selection_rank FROM u QUALIFY selection_rank < k""")
def quality_temporal_choice(spark, sf_dir):
    o = st.observations(spark, sf_dir)
    edge = (F.col("x1") <= 200).cast("int") + (F.col("y1") <= 100).cast("int")
    o = o.select((F.col("track") % 60).alias("grp"), F.col("event_id").alias("id"), "frame", edge.alias("edge"), ((F.col("event_id") % 5) / 10.0).alias("overlap"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), "value")
    return selection.quality_temporal_choice(o, "grp", "id", "frame", "edge", "overlap", "area", "value", 6, 4)
