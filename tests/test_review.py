"""Decision timelines, truth metrics, overlap runs, choices and allocation on cases of a few rows and against plain folds."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veldra.operators import allocation, graph, overlap, review, selection, timelines, truth
from veldra.plans import catalog_review
from veldra.storage import Scratch

DECISION = "target string, event int, decision int, revision int, action string, segment int, track int, frame int, direct boolean, supersedes int, log_pos int"
SEGMENTS = [(1, 11, 0, 9), (2, 12, 20, 29), (3, 13, 5, 14)]


def timelines_of(spark, rows, approvals=None):
    d = spark.createDataFrame(rows, DECISION)
    s = spark.createDataFrame(SEGMENTS, "segment int, track int, start int, stop int")
    a = None if approvals is None else spark.createDataFrame(approvals, "decision int, status string, log_pos int")
    return review.timelines_from_decisions(d, s, [("FIXTURE_DEMO", "fixture", F.col("event") == 99)], a, 100)


def test_revoked_confirmation_leaves_nothing(spark):
    t = timelines_of(spark, [("a", 1, 1, 1, "CONFIRM_TARGET", 1, 11, 3, False, None, 1), ("a", 1, 2, 2, "REVOKE", None, None, None, False, 1, 2)])
    assert t.intervals.count() == 0
    assert t.summary.first().status == "NO_APPROVED_PRODUCT_DECISIONS"
    assert {r.decision: r.source_class for r in t.decisions.collect()} == {1: "REVOKED_OR_SUPERSEDED", 2: "REVOKED_OR_SUPERSEDED"}


def test_gap_between_confirmations(spark):
    t = timelines_of(spark, [("a", 1, 1, 1, "CONFIRM_TARGET", 1, 11, 3, False, None, 1), ("a", 2, 2, 1, "CONFIRM_TARGET", 2, 12, None, False, None, 2), ("a", 3, 3, 1, "DEFER", None, None, None, False, None, 3), ("a", 4, 4, 1, "INVALID_SEGMENT", 3, 13, None, False, None, 4)])
    assert sorted((r.kind, r.start, r.stop) for r in t.intervals.collect()) == [("confirmed", 0, 9), ("confirmed", 20, 29), ("gap", 10, 19), ("invalid", 0, 0), ("unresolved_event", 0, 0)]
    s = t.summary.first()
    assert (s.status, s.confirmed_frames, s.gap_frames, s.tracks, s.coverage, s.conflicts) == ("OK", 20, 10, 2, 0.2, 0)


def test_conflicts_of_overlap_and_binding(spark):
    rows = [("a", 1, 1, 1, "CONFIRM_TARGET", 1, 11, 3, False, None, 1), ("a", 2, 2, 1, "CONFIRM_TARGET", 3, 13, 6, False, None, 2), ("a", 5, 5, 1, "CONFIRM_TARGET", 1, 11, 4, False, None, 5), ("b", 3, 3, 1, "CONFIRM_TARGET", 2, 12, 21, False, None, 3), ("c", 4, 4, 1, "CONFIRM_TARGET", 2, 12, 22, False, None, 4)]
    t = timelines_of(spark, rows)
    assert sorted((r.target, r.kind, r.start, r.stop, r.n) for r in t.conflicts.collect()) == [("a", "overlap", 5, 9, 2), ("b", "binding", None, None, 2), ("c", "binding", None, None, 2)]
    assert {r.target: (r.status, r.conflicts) for r in t.summary.collect()} == {"a": ("CONFLICTED", 2), "b": ("CONFLICTED", 1), "c": ("CONFLICTED", 1)}


def test_provenance_blocks_and_approval_gates(spark):
    rows = [("a", 1, 1, 1, "CONFIRM_TARGET", 1, 12, 3, False, None, 1), ("b", 2, 2, 1, "CONFIRM_TARGET", 7, 11, 3, False, None, 2), ("c", 3, 3, 1, "CONFIRM_TARGET", 1, 11, 50, False, None, 3), ("d", 4, 4, 1, "CONFIRM_TARGET", None, None, 5, True, None, 4), ("e", 99, 5, 1, "CONFIRM_TARGET", 1, 11, 3, False, None, 5), ("f", 6, 6, 1, "CONFIRM_TARGET", None, None, None, False, None, 6)]
    t = timelines_of(spark, rows)
    assert {r.target: r.status for r in t.summary.collect()} == {"a": "BLOCKED", "b": "BLOCKED", "c": "BLOCKED", "d": "EMPTY", "e": "NO_APPROVED_PRODUCT_DECISIONS", "f": "NO_APPROVED_PRODUCT_DECISIONS"}
    assert {r.decision: r.exclusion_reason for r in t.decisions.where("decision >= 5").collect()} == {5: "fixture", 6: "confirm_missing_segment_or_direct_bbox"}
    gated = timelines_of(spark, [("a", 1, 1, 1, "CONFIRM_TARGET", 1, 11, 3, False, None, 1), ("b", 2, 2, 1, "CONFIRM_TARGET", 2, 12, 21, False, None, 2)], [(1, "APPROVED", 1), (2, "APPROVED", 2), (2, "REVOKED", 3)])
    assert {r.target: r.status for r in gated.summary.collect()} == {"a": "OK", "b": "NO_APPROVED_PRODUCT_DECISIONS"}
    assert timelines_of(spark, []).summary.count() == 0


def test_overlapping_pairs_without_pairs(spark):
    rng = random.Random(5)
    segs = [(i, i % 7, s := rng.randrange(60), s + rng.randrange(15)) for i in range(40)]
    rows = [(g, *segs[rng.randrange(40)]) for g in (1, 2, 3) for _ in range(30)]
    got = {r.g: r.pairs for r in review.overlapping_pairs(spark.createDataFrame(rows, "g int, seg int, tr int, s int, e int"), "g", "s", "e", ["seg", "tr"]).collect()}
    want = Counter()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            want[a[0]] += a[0] == b[0] and a[1:3] != b[1:3] and a[3] <= b[4] and b[3] <= a[4]
    assert got == dict(want)


def _metrics(spark, intervals, boxes, observations, accepted=True):
    t = spark.createDataFrame(intervals, "v int, id int, start int, stop int, state string, ids array<string>")
    b = spark.createDataFrame(boxes, "v int, frame int, x1 int, y1 int, x2 int, y2 int")
    o = spark.createDataFrame(observations, "v int, frame int, track string, x1 int, y1 int, x2 int, y2 int")
    acc = spark.createDataFrame([(1, accepted)], "v int, accepted boolean")
    return truth.target_metrics(truth.scored_frames(truth.truth_frames(t, "v"), b, o, "v"), acc, "v", 10.0).first()


BOX = (0, 0, 10, 10)


def test_good_and_bad_trackers(spark):
    intervals = [(1, 1, 0, 9, truth.ASSOCIATED, ["t1"]), (1, 2, 10, 14, truth.UNCERTAIN, []), (1, 3, 15, 19, truth.ASSOCIATED, ["t2"])]
    boxes = [(1, f, *BOX) for f in range(20)]
    good = [(1, f, "t1" if f < 10 else "t2", *BOX) for f in range(20)]
    m = _metrics(spark, intervals, boxes, good)
    assert (m.status, m.correct_frames, m.visible_frames, m.precision, m.recall, m.losses, m.longest_correct, m.uncertain_frames) == ("ok", 15, 15, 1.0, 1.0, 0, 15, 5)
    assert m.false_switches == 1  # t1 isn't a track of the later interval, so the truth doesn't explain the change
    bad = [(1, f, "t9" if 3 <= f < 6 else "t1", *BOX) for f in range(10)]
    m = _metrics(spark, intervals[:1], boxes, bad)
    assert (m.correct_frames, m.false_frames, m.false_assignments, m.losses, m.recoveries, m.recovery_mean_sec, m.fragmentation) == (7, 3, 1, 1, 1, 0.3, 2)
    assert m.precision == 0.7 and m.longest_correct == 4 and abs(m.interventions_per_minute - 120) < 1e-9


def test_wrong_and_missed_states(spark):
    intervals = [(1, 1, 0, 3, truth.WRONG, ["w"]), (1, 2, 4, 5, truth.MISSED, []), (1, 3, 6, 7, truth.OUT, [])]
    obs = [(1, 0, "w", *BOX), (1, 1, "ok", *BOX), (1, 2, "w", *BOX), (1, 4, "ok", *BOX)]
    m = _metrics(spark, intervals, [(1, f, *BOX) for f in range(8)], obs)
    # false, correct, false, missed | false, missed: three false events, each after a frame that ended the last one
    assert (m.correct_frames, m.false_frames, m.missed_frames, m.false_assignments, m.losses, m.recoveries, m.out_of_frame_frames) == (1, 3, 2, 3, 2, 1, 2)


def test_no_accepted_truth(spark):
    m = _metrics(spark, [(1, 1, 0, 3, truth.ASSOCIATED, ["a"])], [], [], accepted=False)
    assert m.status == truth.NOT_MEASURABLE and m.false_switches is None and m.precision is None


def test_acceptance_lasts(spark):
    log = spark.createDataFrame([(1, 1, "add"), (1, 2, "accept"), (1, 3, "add"), (1, 4, "label"), (2, 1, "label")], "v int, pos int, kind string")
    got = {r.v: (r.revision, r.accepted, r.accepted_pos) for r in truth.acceptance(log, "v", "pos", "kind", silent=("label",)).collect()}
    assert got == {1: (3, True, 2), 2: (0, False, None)}


def _longest_run(pairs, drift):
    by = defaultdict(list)
    for a, b in sorted(set(pairs)):
        by[a].append(b)
    best = []
    for a in sorted(by):
        for b in by[a]:
            run = [(a, b)]
            while nxt := next((x for x in by.get(run[-1][0] + 1, []) if x > run[-1][1] and abs(x - run[-1][0] - 1 - (b - a)) <= drift), None):
                run.append((run[-1][0] + 1, nxt))
            best = run if len(run) > len(best) else best
    return best


def test_matched_runs_keep_to_the_first_offset(spark):
    rng = random.Random(3)
    groups = {0: [(i, 2 * i) for i in range(9)], 1: [(i, i + 4) for i in range(37)], 2: [(5, 5)]}
    for g in range(3, 12):
        groups[g] = [(a, a + rng.randrange(5)) for a in range(40) for _ in range(2) if rng.random() < 0.8]
    rows = [(g, a, b) for g, ps in groups.items() for a, b in ps] + [(2, None, 5), (2, 5, None)]
    got = defaultdict(list)
    for r in overlap.matched_runs(spark.createDataFrame(rows, "g int, a long, b long"), ["g"], "a", "b", 2, Scratch(spark, "test")).orderBy("g", "step").collect():
        got[r.g].append((r.a, r.b))
        assert r.run_length == len(_longest_run(groups[r.g], 2))
    assert got == {g: _longest_run(ps, 2) for g, ps in groups.items()}
    assert len(got[0]) == 3  # offsets 0, 1, 2; the next is 3 away from the first


def test_overlay_leaves_one_kind_a_frame(spark):
    rows = [(1, "gap", 0, 20), (1, "chain", 3, 6), (1, "segment", 5, 9), (1, "chain", 7, 7), (1, "other", 0, 99), (2, "gap", 5, 4)]
    got = timelines.overlaid(spark.createDataFrame(rows, "v int, k string, a int, b int"), "v", "k", "a", "b", ["chain", "segment", "gap"])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(1, "gap", 0, 2), (1, "chain", 3, 7), (1, "segment", 8, 9), (1, "gap", 10, 20)]


def test_range_edges_equal_the_pairwise_join(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(4) or None, s := rng.randrange(120), s + rng.randrange(9), rng.randrange(30) if i % 3 == 0 else None) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, k int, s int, e int, same int")
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if (a[1] is not None and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]) or (a[4] is not None and a[4] == b[4]):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    got = {r.id: r.component for r in graph.evaluation_components(df, "id", ["same"], ["k"], "s", "e", Scratch(spark, "test")).collect()}
    assert got == {i: find(i) for i in root}
    assert graph.range_edges(df, "id", "k", "s", "e").count() < 70


def test_suppressed_choice_has_both_rules(spark):
    rows = [(1, 1, "a", 9, 0, 0b0000), (1, 2, "a", 8, 2, 0b1111), (1, 3, "b", 7, 3, 0b110000), (1, 4, "b", 6, 30, 0b0001), (1, 5, "b", 5, 40, 0b11110000), (1, 6, "c", 4, 80, 0b1111_0000_0000)]
    df = spark.createDataFrame(rows, "g int, id int, bucket string, q int, frame int, bits long")
    got = selection.suppressed_choice(df, "g", "id", "bucket", ["a", "b"], [F.desc("q")], "frame", "bits", 3, 5, 2).first()
    # 3 is too near in time and 4 too alike in the first pass; 2, 3 and 4 again in the second, until three are chosen
    assert (got.selected, got.suppressed_gap, got.suppressed_duplicate) == ([1, 5, 6], 3, 2)


def test_spaced_windows_keep_the_budget(spark):
    df = spark.createDataFrame([(1, 0, 50), (1, 1, 55), (1, 2, 62), (1, 3, 90), (1, 4, 10)], "v int, turn int, center int")
    got = selection.spaced_windows(df, "v", ["turn"], "center", 10, 3).orderBy("position").collect()
    assert [r.center for r in got] == [50, 62, 90]


def _fold(items, caps, batches, first_order, order):
    size = Counter(r["grp"] for r in items if r["source"] == "recomputed")
    owner, used, out = {}, set(), []
    for b in batches:
        seg, trk, bins, frames, left = Counter(), Counter(), Counter(), defaultdict(list), dict(b.strata)
        for first, strata, quota in ((True, first_order, b.first), (False, order, b.rest)):
            for _ in range(quota):
                for s in (s for s in strata if left[s] > 0):
                    able = [r for r in items if r["stratum"] == s and (r["source"] == "recomputed") == first and r["id"] not in used and owner.get(r["grp"], b.name) == b.name and seg[r["segment"]] < caps.per_segment and trk[r["track"]] < caps.per_track and all(abs(r["frame"] - f) >= caps.frame_gap for f in frames[r["track"]])]
                    if able:
                        break
                r = min(able, key=lambda r: (size[r["grp"]] if first else 0, bins[r["bin"]], trk[r["track"]], r["id"]))
                used.add(r["id"])
                owner[r["grp"]] = b.name
                seg[r["segment"]] += 1
                trk[r["track"]] += 1
                bins[r["bin"]] += 1
                frames[r["track"]].append(r["frame"])
                left[r["stratum"]] -= 1
                out.append((r["id"], b.name))
    return out


@pytest.mark.parametrize("n", [8, 2048])
def test_allocation_equals_a_plain_fold(spark, n):
    d = "/root/testdata/sf0.001"
    items = catalog_review.allocation_items(spark, d)
    few = [allocation.Batch(b.name, {"low": 3, "mid": 3, "high": 2}, 4) for b in catalog_review.BATCHES[:2]] if n < 100 else catalog_review.BATCHES
    orders = (["low", "mid", "high"], ["high", "mid", "low"])
    got = allocation.allocate(items, "recomputed", few, *orders, catalog_review.CAPS, Scratch(spark, "test"), n)
    rows = got.orderBy("batch", "batch_order").collect()
    assert [(r.id, r.batch) for r in rows] == _fold(items.collect(), catalog_review.CAPS, few, *orders)
    owners = got.join(items.select("id", "grp"), "id").groupBy("grp").agg(F.count_distinct("batch").alias("n"))
    assert owners.agg(F.max("n")).first()[0] == 1


def test_allocation_reports_a_shortage(spark):
    items = catalog_review.allocation_items(spark, "/root/testdata/sf0.001").where("stratum = 'low'").limit(20)
    with pytest.raises(allocation.Shortage):
        allocation.allocate(items, "recomputed", [allocation.Batch("b", {"low": 2, "mid": 2}, 1)], ["low"], ["mid", "low"], catalog_review.CAPS, Scratch(spark, "test"))


def test_choice_by_quality_and_spread(spark):
    rows = [(1, i, 10 * i, 0, 0.0, 3000, float(i % 3)) for i in range(10)] + [(2, 1, 5, 1, 0.5, 100, 1.0), (2, 2, 6, 0, 0.5, 100, 1.0), (3, 7, 0, 0, 0.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "g int, id int, f int, e int, o double, a int, s double")
    got = defaultdict(list)
    for r in selection.quality_temporal_choice(df, "g", "id", "f", "e", "o", "a", "s", 3, 2).orderBy("g", "selection_rank").collect():
        got[r.g].append(r.id)
    assert got[2] == [1, 2] and got[3] == [7]  # as many as there are, even a frame apart
    assert len(got[1]) == 3 and all(b - a >= 1 for a, b in zip(got[1], got[1][1:], strict=False)) and set(got[1]) <= {2, 5, 8}  # the sharp ones


def test_provisional_intervals_and_statuses(spark):
    log = [("t", 1, 1, 1, "CONFIRM_TARGET", 1, 11, 0, 9, 3), ("t", 2, 2, 2, "DEFER", None, None, None, None, 40), ("t", 3, 3, 3, "CONFIRM_TARGET", 2, 12, 20, 20, 20), ("u", 4, 4, 1, "UNKNOWN", None, None, None, None, 7)]
    df = spark.createDataFrame(log, "target string, event int, decision int, log_pos int, action string, segment int, track int, start int, stop int, frame int")
    got = {r.id: (r.status, r.segment, r.start, r.stop, r.eligible) for r in review.provisional_intervals(df, df.where("decision = 3").select("decision")).collect()}
    assert got == {"human_1": ("HUMAN VERIFIED", 1, 0, 0, False), "continuation_1": ("TRACKER CONTINUATION", 1, 0, 9, False), "unresolved_2": ("UNRESOLVED", 1, 40, 40, False), "human_3": ("VERIFIED", 2, 20, 20, True), "unresolved_4": ("UNRESOLVED", None, 7, 7, False)}
    s = spark.createDataFrame([(1, 9, 5, True), (1, 9, 10, True), (1, 9, 10, False), (None, None, 3, False), (None, None, 3, True), (1, None, 3, False)], "t int, e int, n int, u boolean")
    assert [r[0] for r in s.select(review.selection_status(*map(F.col, "tenu"))).collect()] == ["TRACKING", "UNRESOLVED", "LOST", "REVIEW REQUIRED", "UNRESOLVED", "TRACKING"]


def test_target_states(spark):
    df = spark.createDataFrame([(1, 1, "SEED", "7", "GOOD"), (1, 2, "GAP", None, "note"), (1, 3, "SEED", "8", None)], "v int, i int, source string, track string, hint string")
    state = lambda d: [(r.current_track, r.target_status) for r in review.target_states(d, "v", "i", "source", "track", "hint", ["SEED", "GAP"], ["GOOD"]).orderBy("i").collect()]
    assert state(df) == [("7", "GOOD"), ("7", "GOOD"), ("8", "GOOD")]
    with pytest.raises(Exception, match="unknown observation source"):
        state(df.withColumn("source", F.lit("other")))


def test_heads_are_the_effective_decisions_of_clean_sources(spark):
    rng = random.Random(3)
    actions = ["CONFIRM_TARGET", "CONFIRM_TARGET", "REVOKE", "DEFER", "INVALID_SEGMENT", None]
    rows = [(rng.choice(["a", "b", None]), i // 4, i, rng.randrange(3), rng.choice(actions), rng.choice([1, 2, None]), 11, 3, rng.choice([True, False, None]), rng.choice([None, i - 1]), i) for i in range(400)]
    d = spark.createDataFrame(rows, DECISION)
    approvals = spark.createDataFrame([(i, rng.choice(["APPROVED", "REVOKED"]), i) for i in range(0, 400, 2)], "decision int, status string, log_pos int")
    rules = [("FIXTURE_DEMO", "fixture", F.col("event") % 9 == 2)]
    for a in (approvals, None):
        full = review.classified(d, rules, a)
        heads = review.effective_heads(d, rules, a)
        want = sorted(r.decision for r in full.where("effective and source_class <> 'FIXTURE_DEMO'").collect())
        assert sorted(r.decision for r in heads.collect()) == want and want
        able = sorted(r.decision for r in full.where("timeline_eligible").collect())
        assert sorted(r.decision for r in heads.where("kind = 'c' and approved and known").collect()) == able and able
        summary = {r.target: (r.eligible, r.excluded) for r in review.timelines_from_decisions(d, spark.createDataFrame(SEGMENTS, "segment int, track int, start int, stop int"), rules, a, 100).summary.collect()}
        counts = full.groupBy("target").agg(F.count_if("timeline_eligible").alias("e"), F.count_if(F.col("source_class") != review.APPROVED).alias("x")).collect()
        assert summary == {r.target: (r.e, r.x) for r in counts}


def test_timelines_shuffle_the_whole_log_no_further(spark):
    t = catalog_review._timelines(spark, "/root/testdata/sf0.001")
    plan = t.intervals._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "l_orderkey" not in plan and "supersedes" not in plan
