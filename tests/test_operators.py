"""Edge cases on tables of a few rows, and fast joins against naive ones."""

import random

import pytest
from pyspark.sql import functions as F

from veldra.functions import geometry as geo
from veldra.functions import text as txt
from veldra.functions import vectors as vec
from veldra.operators import aggregates, contracts, eventlog, filters, graph, joins, metrics, selection, windows
from veldra.storage import Scratch


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_gap_of_spans(spark):
    df = spark.createDataFrame([(0, 4, 5, 9), (0, 4, 7, 9), (7, 9, 0, 4), (0, 6, 5, 9)], "a int, b int, c int, d int")
    assert [r[0] for r in rows(df.select(geo.temporal_gap(*map(F.col, "abcd"))))] == [0, 2, 2, 0]
    assert [r[0] for r in rows(df.select(geo.spans_overlap(*map(F.col, "abcd"))))] == [False, False, False, True]


def test_boxes(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15), (0, 0, 10, 10, 10, 0, 20, 10), (0, 0, 0, 0, 0, 0, 0, 0)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    a, b = geo.Box.of("a_"), geo.Box.of("b_")
    assert [tuple(r) for r in rows(df.select(geo.intersection(a, b), F.round(geo.iou(a, b), 6)))] == [(25, 0.142857), (0, 0.0), (0, 0.0)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = rows(df.select(vec.norm("a"), vec.unit(F.col("a")), vec.dot(F.col("a"), F.col("b")), vec.l1(F.col("a"), F.col("b")), vec.product(F.col("b"))))
    assert got == [(5.0, [0.6, 0.8], 24.0, 2.0, 12.0), (0.0, None, 0.0, 1.0, 0.0)]


def test_scalar_text(spark):
    df = spark.createDataFrame([("7",), (" 12 ",), ("123",), ("a1",), ("",), (None,)], "t string")
    d, reason = txt.digit_candidate(F.col("t"))
    assert rows(df.select(d, reason)) == [("7", None), ("12", None), (None, "too_many_digits"), (None, "not_digits"), (None, "empty"), (None, "empty")]
    rate = spark.createDataFrame([("30000/1001",), ("25",), ("1/0",), ("x",)], "t string").select(F.round(txt.frame_rate(F.col("t")), 3))
    assert [r[0] for r in rate.collect()] == [29.97, 25.0, None, None]
    zone = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-01-01T00:00:00+02:00",)], "t string").select(txt.zoned_timestamp(F.col("t")).isNotNull())
    assert [r[0] for r in zone.collect()] == [True, False, True]
    assert spark.createDataFrame([("ﬁ ",)], "t string").select(txt.nfkc("t")).first()[0] == "fi"
    paths = spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("C:x",), (None,)], "t string").select(txt.safe_relative_path(F.col("t")))
    assert [r[0] for r in paths.collect()] == [True, False, False, False, False]


def test_first_and_all_reasons(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, v int")
    rules = [("small", F.col("v") < 10), ("odd", F.col("v") % 2 == 1)]
    assert rows(df.select(filters.first_reason(rules), filters.all_reasons(rules))) == [("small", ["small", "odd"]), (None, []), (None, [])]
    assert dict(rows(filters.reason_counts(df, rules))) == {"small": 1, "kept": 2}
    ex = filters.excluded_by_keys(df, [("a", "id", spark.createDataFrame([(1,)], "k int")), ("b", "v", spark.createDataFrame([(5,), (50,)], "k int"))])
    assert rows(ex.select("id", "exclusion_reason"), "id") == [(1, "a"), (2, "b"), (3, None)]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double")
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(df, ["k"])
    with pytest.raises(Exception, match="finite"):
        contracts.require_finite(spark.createDataFrame([(1, float("nan"))], "k int, v double"), ["v"]).collect()
    nested = spark.createDataFrame([], "id int, a struct<jersey_number:int, b:array<struct<label:string>>>")
    assert contracts.forbidden_columns(nested, exact=["label"], parts=["jersey"]) == ["a.jersey_number", "a.b.label"]
    with pytest.raises(contracts.ContractError):
        contracts.blind_projection(nested, ["id", "a"], exact=["label"])
    other = spark.createDataFrame([(1, 1.0000001), (2, 5.0)], "k int, v double")
    found = contracts.mismatches(spark.createDataFrame([(1, 1.0), (2, 4.0), (3, 1.0)], "k int, v double"), other, ["k"], ["v"], 1e-6)
    assert [r[0] for r in rows(found, "k")] == [2, 3]
    one, two = contracts.fingerprint(df, ["k"], ["v"]).first(), contracts.fingerprint(df.orderBy(F.desc("v")), ["k"], ["v"]).first()
    assert one == two


def test_range_join_is_the_naive_join(spark):
    rng = random.Random(3)
    a = [(i, rng.randrange(3), s := rng.randrange(100), s + rng.randrange(30)) for i in range(80)]
    b = [(i, rng.randrange(3), s := rng.randrange(100), s + rng.randrange(30)) for i in range(80)]
    got = joins.range_join(spark.createDataFrame(a, "i int, k int, a0 int, a1 int"), spark.createDataFrame(b, "j int, k int, b0 int, b1 int"), ["k"], ("a0", "a1"), ("b0", "b1"), 10)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_hamming_pairs_are_the_naive_pairs(spark):
    rng = random.Random(5)
    v = [(i, rng.getrandbits(63)) for i in range(60)]
    v += [(100 + i, x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i, x in v[:20]]
    got = sorted(map(tuple, joins.hamming_pairs(spark.createDataFrame(v, "i long, b long"), "i", "b", 4).collect()))
    assert got == sorted((i, j, (x ^ y).bit_count()) for i, x in v for j, y in v if i < j and (x ^ y).bit_count() <= 4)


def test_look_back(spark):
    left = spark.createDataFrame([(1, 10), (1, 30)], "t int, at int")
    right = spark.createDataFrame([(1, 6, "a"), (1, 8, "b"), (1, 5, "z")], "t int, f int, v string")
    assert rows(joins.look_back(left, right, ["t"], "at", "f", 4, ["v"]), "at") == [(1, 10, 8, "b"), (1, 30, None, None)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 10, 12), ("a", 11, 11)], "k string, s long, e long")
    assert rows(windows.gaps_between(df, ["k"], "s", "e")) == [("a", 7, 9)]
    assert rows(windows.merged_intervals(df, ["k"], "s", "e"), "start") == [("a", 1, 6), ("a", 10, 12)]
    assert rows(windows.complement(df, ["k"], "s", "e", 0, 15), "start") == [("a", 0, 0), ("a", 7, 9), ("a", 13, 15)]
    runs = windows.runs(spark.createDataFrame([("a", x) for x in (1, 2, 2, 5, 9)], "k string, f long"), ["k"], "f", 3)
    assert [tuple(r)[2:] for r in runs.orderBy("start").collect()] == [(1, 5, 3), (9, 9, 1)]


def test_change_point_needs_support(spark):
    flags = [(1, True, False), (2, True, False), (3, False, True), (4, True, False), (5, True, True), (6, True, False)]
    df = spark.createDataFrame([("a", i, f, s) for i, f, s in flags], "k string, i int, f boolean, s boolean")
    assert rows(windows.change_points(df, "k", ["i"], F.col("f"), F.col("s"), 2)) == [("a", 4, 6, 3)]


def test_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0), (4, 5.0)], "id int, v double")
    assert rows(windows.rank_to_unit(df, "v", "id").select("id", "unit_rank"), "id") == [(1, 0.5), (2, None), (3, 1.0), (4, 0.0)]
    one = windows.rank_to_unit(df.where("id = 1"), "v", "id")
    assert one.first()["unit_rank"] == 1.0
    assert rows(df.select("id", aggregates.upper_median(F.array(F.lit(1), F.lit(5), F.lit(3), F.lit(9)))).limit(1))[0][1] == 5


def test_greedy_gap_and_margin(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (1, 12, 0.8), (1, 20, 0.7), (1, 27, 0.6)], "t int, f int, q double")
    got = selection.greedy_with_gap(df, "t", [F.desc("q")], "f", 2, 7, ["f"])
    assert rows(got, "selection_rank") == [(1, 1, 10), (1, 2, 20)]
    cost = spark.createDataFrame([("a", 1, 0.2), ("b", 1, 0.2), ("b", 2, 0.3), ("c", 1, 0.9)], "k string, i int, c double")
    assert [(r.k, r.margin is None, r.decision) for r in selection.best_with_margin(cost, "k", "c", "i", 0.65, 0.18).orderBy("k").collect()] == [("a", True, "accepted"), ("b", False, "review"), ("c", True, "unresolved")]


def test_medoid_definitions(spark):
    df = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [1.0, 0.0]), ("g", 3, [0.0, 1.0]), ("s", 4, [1.0, 0.0])], "g string, i int, v array<double>")
    assert rows(aggregates.medoids(df, "g", "i", "v"), "g") == [("g", 1, 0.5), ("s", 4, 0.0)]
    assert rows(aggregates.medoids(df, "g", "i", "v", include_self=True), "g") == [("g", 1, round(1 / 3, 9)), ("s", 4, 0.0)]


def test_union_coverage_is_the_pixel_count(spark):
    rng = random.Random(2)
    box = lambda: (x := rng.randrange(20), y := rng.randrange(20), x + 1 + rng.randrange(12), y + 1 + rng.randrange(12))
    data = []
    for k in range(12):
        t = box()
        data += [(k, *t, *box()) for _ in range(5)]
    df = spark.createDataFrame(data, "k int, " + ", ".join(f"{p}{c} int" for p in ("t_", "o_") for c in ("x1", "y1", "x2", "y2")))
    got = {r.k: r.covered for r in aggregates.union_coverage(df, ["k"]).collect()}
    for k in range(12):
        cover = {(x, y) for d in data if d[0] == k for x in range(max(d[1], d[5]), min(d[3], d[7])) for y in range(max(d[2], d[6]), min(d[4], d[8]))}
        assert got[k] == len(cover)


def test_auroc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "s double, p boolean")
    assert metrics.auroc(df, "s", F.col("p")).first()["auroc"] == 0.875
    assert metrics.auroc(df.where("p"), "s", F.col("p")).first()["auroc"] is None


def test_decisions(spark):
    log = spark.createDataFrame([(1, "a", 1, None, "confirm"), (2, "b", 2, "a", "correct"), (3, "c", 2, None, "defer"), (4, "d", 1, None, "confirm")], "log_pos int, d string, r int, s string, act string").withColumn("e", F.when(F.col("d") == "d", 2).otherwise(1))
    heads = eventlog.effective_decisions(log, "e", "d", "r", "s")
    assert rows(heads.select("e", "d"), "e") == [(1, "b"), (2, "d")]
    assert rows(eventlog.revision_violations(log, "e", "r").select("log_pos")) == [(3,)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges, "a", "b", Scratch(spark, "t")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100}
    assert graph.connected_components(edges.limit(0), "a", "b", Scratch(spark, "t")).count() == 0


def test_numbered_is_the_row_number_of_the_whole_table(spark):
    from veldra.operators import windows

    rows = [(i, (i * 7919) % 13, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key long, v long")
    got = windows.numbered(df, [F.desc("key"), F.asc("id")], "rank", {"upto": "v"}, "n").collect()
    upto, n = 0, 0
    for r in sorted(got, key=lambda r: (-r.key, r.id)):
        n, upto = n + 1, upto + r.v
        assert (r["rank"], r.upto, r.n) == (n, upto, 500)
    assert windows.numbered(df.limit(0), [F.asc("id")], "rank").count() == 0


def test_overlapping_boxes_are_found_once(spark):
    import random

    from veldra.operators import joins

    rng = random.Random(2)
    boxes = [(f, i, x, y, x + rng.randrange(1, 300), y + rng.randrange(1, 300)) for i, (f, x, y) in enumerate((rng.randrange(2), rng.randrange(-50, 900), rng.randrange(-50, 600)) for _ in range(80))]
    side = lambda p: spark.createDataFrame(boxes, f"frame int, {p}id int, {p}x1 int, {p}y1 int, {p}x2 int, {p}y2 int")
    got = sorted((r.a_id, r.b_id) for r in joins.box_pairs(side("a_"), side("b_"), ["frame"], "a_", "b_", 100).collect())
    want = sorted((a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5])
    assert got == want


def test_gallery_best_in_small_blocks(spark):
    import numpy as np

    from veldra.operators import joins

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(99, None, "a"), (None, [1.0] * 5, "b")], "id long, v array<double>, side string")
    got = {(r.query_id, r.side): (r.score, r.gallery_id) for r in joins.query_gallery_best(df, df, "id", "v", "id", "side", block=7, tile=11).collect()}
    s = np.round(np.clip(x @ x.T, -1, 1), 6)
    want = {(i, "ab"[k]): max((s[i, j], -j) for j in range(60) if j % 2 == k and j != i) for i in range(60) for k in (0, 1)}
    assert {k: (round(a, 6), -b) for k, (a, b) in got.items()} == {k: (round(float(a), 6), b) for k, (a, b) in want.items()}


def test_replay_and_timeline_cases(spark):
    from veldra.operators import timelines

    e = [
        (1, 1, "add", 10, 0, 9, None, None, None), (1, 2, "split", 20, None, None, 10, None, 5), (1, 3, "merge", 30, None, None, 21, 22, None),
        (2, 1, "add", 10, 0, 9, None, None, None), (2, 2, "supersede", 20, 3, 8, 10, None, None), (2, 3, "deactivate", 30, None, None, 99, None, None),
        (3, 1, "add", 10, 0, 9, None, None, None), (3, 2, "deactivate", 20, None, None, 10, None, None),
        (4, 1, "add", 10, 0, 9, None, None, None), (4, 2, "split", 20, None, None, 10, None, 0), (4, 3, "add", 30, 5, 30, None, None, None), (4, 4, "add", 40, 50, 60, None, None, None),
    ]
    df = spark.createDataFrame(e, "t long, pos long, kind string, id long, start long, stop long, ref long, ref2 long, at long")
    truth = timelines.replay_events(df, "t", "pos")
    assert sorted(map(tuple, truth.collect())) == [(1, 30, 0, 9), (2, 20, 3, 8), (4, 10, 0, 9), (4, 30, 5, 30), (4, 40, 50, 60)]
    assert [tuple(r) for r in timelines.overlapping(truth, ["t"], "id", "start", "stop").collect()] == [(4, 10, 30)]
    got = {r.t: tuple(r)[1:] for r in timelines.reconstruct(truth, "t", "start", "stop", 10).collect()}
    assert got == {1: (1, 0, 0, 0, 10, "COMPLETE"), 2: (1, 0, 0, 0, 6, "PARTIAL"), 4: (3, 1, 1, 19, 42, "CONFLICT")}
