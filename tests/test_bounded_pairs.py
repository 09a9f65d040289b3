"""Queries over pairs without the pairs: the operators against naive ones, and plans in which no pair is joined."""

import random

import pytest
from pyspark.sql import functions as F

from veldra.operators import aggregates, blocks, overlap
from veldra.plans import catalog, catalog_evidence
from veldra.storage import Scratch

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_connect_what_all_pairs_connect(spark):
    from veldra.operators import graph

    rng = random.Random(1)
    rows = [(i, i % 2, [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(60)] + [(60, 0, None), (61, 0, [1.0, None]), (62, 0, [9.0])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    dot = lambda x, y: round(sum(a * b for a, b in zip(x, y, strict=True)), 6)
    want = {(a, b) for a, p, x in rows[:60] for b, q, y in rows[:60] if a < b and p == q and dot(x, y) >= 0.35}
    for block in (7, 4096):
        links = blocks.similar_links(df, ["label"], "id", "v", 0.35, block=block)
        got = {r.a: r.k for r in links.where("b is null").groupBy("a").agg(F.sum("n").alias("k")).collect()}
        assert got == {i: sum(i in e for e in want) for i in range(60) if any(i in e for e in want)}
        edges = {(min(r.a, r.b), max(r.a, r.b)) for r in links.where("b is not null").collect()}
        assert edges <= want
        pairs = spark.createDataFrame(sorted(want), "a long, b long")
        comp = lambda e: {(r.node, r.component) for r in graph.connected_components(e, "a", "b", Scratch(spark, "t")).collect()}
        assert comp(links.where("b is not null")) == comp(pairs)


def test_cliques_are_counted_not_paired(spark):
    import inspect

    assert "a + b) % 11" not in inspect.getsource(catalog.QUERIES["clique_components"])


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_continuations_hold_the_two_cheapest(spark, seed):
    rng = random.Random(seed)
    ends = list({(t, s): (t, s, s + rng.randrange(3), rng.randrange(8), rng.randrange(8)) for t, s in ((rng.randrange(9), rng.randrange(12)) for _ in range(80))}.values())
    df = spark.createDataFrame(ends, "track long, start long, stop long, first_x long, last_x long")
    got = sorted((r.track, r.stop, r.last_x, r.next_track, r.next_start) for r in blocks.nearest_continuations(df, 3, 4).collect())
    want = []
    for t, _, stop, _, x in ends:
        for gap in range(1, 4):
            near = sorted((abs(f - x), u) for u, s, _, f, _ in ends if u != t and s == stop + gap and abs(f - x) <= 4)
            want += [(t, stop, x, u, stop + gap) for _, u in near[:2]]
    assert got == sorted(want)


def test_stitch_chain_forms_no_pairs():
    import inspect

    assert "_nearest_stitch" in inspect.getsource(catalog.QUERIES["stitch_chain"])


def _boxes(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, i * 7 % 50, x, y, x + rng.randrange(1, 300), y + rng.randrange(1, 200)) for i in range(60) for x, y in [(rng.randrange(-50, 400), rng.randrange(400))]] + [(9, 99, 1, 0, 0, 5, 5)]
    return rows, spark.createDataFrame(rows, "frame long, track long, event long, x1 long, y1 long, x2 long, y2 long")


def test_covered_by_others_counts_pixels(spark):
    rows, df = _boxes(spark)
    got = {r.track: r.covered for r in blocks.covered_by_others(df, "frame", "track", 64).collect()}
    for f, t, _, x1, y1, x2, y2 in rows:
        pixels = {(x, y) for g, u, _, a, b, c, d in rows if g == f and u != t for x in range(max(a, x1), min(c, x2)) for y in range(max(b, y1), min(d, y2))}
        assert got.get(t, 0) == len(pixels)


def test_best_boxes_are_those_of_all_pairs(spark):
    rows, df = _boxes(spark)
    got = {r.track: (r.other, round(r.score, 9)) for r in blocks.best_boxes(df, "frame", "track", "event", 0.05, 64).collect()}
    want = {}
    for f, t, _, x1, y1, x2, y2 in rows:
        some = []
        for g, u, e, a, b, c, d in rows:
            inter = max(0, min(c, x2) - max(a, x1)) * max(0, min(d, y2) - max(b, y1))
            if g == f and u != t and inter:
                some.append((-inter / ((x2 - x1) * (y2 - y1) + (c - a) * (d - b) - inter), e, u))
        if some and -min(some)[0] >= 0.05:
            want[t] = (min(some)[2], round(-min(some)[0], 9))
    assert got == want


def test_nearest_overlap_audit_joins_no_pairs(spark):
    assert "Join" not in plan(catalog_evidence.QUERIES["nearest_overlap_audit"](spark, DATA))


def test_equal_prints_are_looked_up_once(spark):
    rows = [(1, i, 5 if i < 300 else 5 << 20, [float(i % 7)]) for i in range(310)]
    df = spark.createDataFrame(rows, "video long, id long, bits long, gray array<double>")
    got = overlap.nearest_prints(df, df, ["video"], 48, 2, 3.0).collect()
    assert {(r.a, r.b, r.distance) for r in got} == {(i, 0 if i < 300 else 300, 0) for i in range(310)} and len(got) == 310
    assert "bits" in plan(overlap.print_pairs(df, df, ["video"], "bits", 48, 2)) and "HashAggregate" not in plan(overlap.print_pairs(df, df, ["video"], "bits", 48, 2))


def test_shared_entries_are_counted_by_blocks(spark):
    rng = random.Random(4)
    rows = [(i, sorted(rng.sample(range(3000), rng.randrange(1, 90)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    want = {(a, b, len(set(x) & set(y))) for a, x in rows for b, y in rows if a < b and set(x) & set(y)}
    for block in (9, 2048):
        assert {tuple(r) for r in blocks.shared_entries(df, "id", "v", block).collect()} == want
    assert "Join" not in plan(catalog.QUERIES["exact_frame_conflicts"](spark, DATA))


def test_candidate_generation_shuffles_no_pairs(spark):
    df = catalog_evidence.QUERIES["candidate_generation"](spark, DATA)
    assert plan(df).count("Join") <= 1  # tracks to their vectors


def test_all_pairs_are_ranked_without_one_task_for_all(spark):
    rows = [(i, 0, [float(i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    for block in (5, 4096):
        assert {tuple(r) for r in blocks.vector_pairs(df, ["label"], "id", "v", block=block).collect()} == {(a, b, a * b + 1.0) for a in range(12) for b in range(a + 1, 12)}
    assert "partitionBy(\"conflict\")" not in open(catalog.__file__).read()


def test_ranks_are_read_off_the_written_order(spark):
    from veldra.operators import windows

    rng = random.Random(9)
    rows = [(i, rng.choice([None, *map(float, range(40))]), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s double, n long").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = windows.numbered(df, [F.desc_nulls_last("s"), F.asc("id")], "rank", total="m")
    assert "Window [row_number" not in plan(got) and "rangepartitioning" not in plan(got)
    assert {r.id: (r.rank, r.m) for r in got.collect()} == {r[0]: (i, 3000) for i, r in enumerate(order, 1)}
    sums = {r.id: r.t for r in windows.numbered(df, [F.desc_nulls_last("s"), F.asc("id")], "rank", {"t": "n"}).collect()}
    assert all(sums[r[0]] == sum(x[2] for x in order[: i + 1]) for i, r in enumerate(order))


def test_all_pairs_are_not_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, keep=Scratch.keep: kept.append(name) or keep(self, df, name))
    assert catalog.QUERIES["all_pairs_similarity"](spark, DATA).count() > 0
    assert kept == ["ranges"]


def test_print_matches_are_not_told_apart_afterwards(spark):
    rows = [(1, i, s, b, 0, [1.0]) for i, (s, b) in enumerate([("x", 1), ("x", 1), ("y", 1), ("x", 255), (None, 1), ("x", None)])]
    df = spark.createDataFrame(rows, "video long, id long, sha string, bits long, edge long, gray array<double>")
    found = overlap.fingerprint_matches(df, df, ["video"], 48, 2, 1, 4.0)
    same = lambda p, q: p[2] is not None and p[2] == q[2]
    close = lambda p, q: None not in (p[3], q[3]) and (p[3] ^ q[3]).bit_count() <= 2
    assert sorted((r.a, r.b, r.exact) for r in found.collect()) == sorted((p[1], q[1], same(p, q)) for p in rows for q in rows if same(p, q) or close(p, q))
    assert "HashAggregate" not in plan(found)


def test_equal_prints_are_compared_once(spark):
    rng = random.Random(8)
    kinds = [(v, rng.choice([None, "x", "y"]), rng.choice([None, 1, 3, 255, 1 << 30]), rng.choice([None, 0, 3]), rng.choice([None, [1.0], [6.0]])) for v in (1, 2, None) for _ in range(12)]
    rows = [(v, None if i % 31 == 7 else i, *rest) for i, (v, *rest) in enumerate(kinds * 5)]
    df = spark.createDataFrame(rows, "video long, id long, sha string, bits long, edge long, gray array<double>")
    near = lambda x, y, most: None not in (x, y) and (x ^ y).bit_count() <= most
    same = lambda p, q: p[2] is not None and p[2] == q[2]
    close = lambda p, q: near(p[3], q[3], 2) and near(p[4], q[4], 1) and None not in (p[5], q[5]) and abs(p[5][0] - q[5][0]) <= 4
    want = sorted(repr((p[0], p[1], q[1], same(p, q))) for p in rows for q in rows if p[0] == q[0] is not None and (same(p, q) or close(p, q)))
    found = overlap.fingerprint_matches(df, df, ["video"], 48, 2, 1, 4.0)
    assert sorted(repr((r.video, r.a, r.b, r.exact)) for r in found.collect()) == want
    assert "_ids_a" in plan(found) and "ShuffledHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    assert {len(r._ids_a) for r in overlap._once(df.where("id is not null").withColumns({"bits": F.lit(1), "sha": F.lit("x"), "edge": F.lit(1), "gray": F.lit(None)}), ["video"], ("sha", "bits", "edge", "gray"), "a", 8).where("video = 1").collect()} <= set(range(1, 9))


@pytest.mark.parametrize("most, tasks", [(4_000_000, 2_000), (40, 2_000), (1, 7)])
def test_weighed_rows_meet_once_in_blocks(spark, most, tasks):
    from veldra.operators import joins

    rows = [(i, i % 3 if i < 40 else None if i > 50 else 1, 1 + i % 5) for i in range(55)]
    p, q = spark.createDataFrame(rows, "p long, k long, n long"), spark.createDataFrame(rows, "q long, k long, m long")
    got = joins.equal_in_blocks(p, q, ["k"], Scratch(spark, "test"), most, tasks, ("n", "m")).select("p", "q")
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, x, _ in rows for b, y, _ in rows if x == y is not None)


def test_products_with_a_gallery_are_bounded(spark, monkeypatch):
    import inspect

    from veldra.operators import joins

    rng = random.Random(6)
    rows = [(i, i % 2, [rng.gauss(0, 0.3) for _ in range(3)]) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, side int, v array<double>")
    got = {(r.query_id, r.side): r.gallery_id for r in joins.query_gallery_best(df.where("id < 9"), df, "id", "v", "id", "side").collect()}
    dot = lambda x, y: round(max(-1, min(1, sum(a * b for a, b in zip(x, y, strict=True)))), 6)
    assert got == {(i, str(s)): min((-dot(rows[i][2], v), j) for j, t, v in rows if t == s and j != i)[1] for i in range(9) for s in (0, 1)}
    assert "range(0, len(mine), 1024)" in inspect.getsource(joins.query_gallery_best)


def test_percentiles_by_ranks(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, *map(float, range(9))])) for g in (None, "a", "b") for _ in range(50)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    plain = df.groupBy("g").agg(*(F.percentile("v", F.lit(p)).alias(k) for k, p in points.items()))
    disc = df.groupBy("g").agg(*(F.expr(f"percentile_disc({p}) within group (order by v)").alias(k) for k, p in points.items()))
    rows_of = lambda d: sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())))
    assert rows_of(aggregates.linear_percentiles(df, "v", points, ["g"])) == rows_of(plain)
    assert rows_of(aggregates.nearest_rank_percentiles(df, "v", points, ["g"])) == rows_of(disc)
    assert aggregates.linear_percentiles(df, "v", {"m": 0.5}).count() == 1


def test_first_candidates_reach_the_driver_from_a_table():
    import inspect

    from veldra.operators import allocation

    assert ".limit(n).collect()" not in inspect.getsource(allocation)


def test_ties_of_the_highest_value_go_to_the_first(spark):
    rows = [(i % 3, i, 5.0 if i % 2 else None) for i in range(90)] + [(7, 90, None)]
    df = spark.createDataFrame(rows, "track long, event_id long, value double").repartition(9, "event_id")
    got = {r.track: r.e for r in df.groupBy("track").agg(F.max_by("event_id", catalog_evidence._first_highest("event_id")).alias("e")).collect()}
    assert got == {0: 3, 1: 1, 2: 5, 7: None}


def test_only_removals_look_up_their_runs():
    import inspect

    from veldra.llm import passages

    assert 'runs.where("own").join(shared' in inspect.getsource(passages)


def test_points_meet_spans_in_blocks(spark):
    from veldra.operators import joins

    points = [(i, i % 3, 5 if i < 60 else i % 11) for i in range(90)] + [(90, None, 5), (91, 1, None)]
    spans = [(i, i % 3, i % 9, i % 9 + i % 4 - (i == 7) * 9) for i in range(90)] + [(90, None, 4, 6), (91, 1, None, 6), (92, 1, 4, None)]
    p, s = spark.createDataFrame(points, "p long, g long, at long"), spark.createDataFrame(spans, "s long, g long, lo long, hi long")
    want = sorted((a, b) for a, g, at in points for b, h, lo, hi in spans if None not in (g, at, h, lo, hi) and g == h and lo <= at <= hi)
    for most, tasks in ((4_000_000, 2_000), (50, 2_000), (1, 7)):
        met = joins.points_in_spans(p, s, ["g"], "at", ("lo", "hi"), Scratch(spark, "test"), most, tasks).select("p", "s", "at", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.p, r.s) for r in met) == want
        assert most > 50 or len({r.task for r in met if r.at == 5}) > 3  # the pairs of one number are met in several tasks


def test_overlaps_are_met_once(spark):
    from veldra.operators import joins

    rows = [(i % 8, 10 * (i // 8) + i % 3, 10 * (i // 8) + i % 3 + i % 5) for i in range(64)] + [(1, 200, 200), (2, 200, 200), (None, 200, 200), (3, None, 9), (4, 300, 299), (5, 290, 310)]
    got = joins.overlap_pairs(spark.createDataFrame(rows, "t long, a long, b long"), "t", "a", "b", Scratch(spark, "test"))
    whole = [r for r in rows if None not in r and r[1] <= r[2]]
    want = sorted((x, y, a, b, c, d) for x, a, b in whole for y, c, d in whole if x < y and a <= d and c <= b)
    assert sorted(tuple(r) for r in got.select("a", "b", "a_start", "a_stop", "b_start", "b_stop").collect()) == want


@pytest.mark.parametrize("name", ["interval_overlap_conflicts", "stitch_candidates"])
def test_pairs_of_segments_are_met_by_a_hash_join_over_blocks(spark, name):
    p = plan(catalog.QUERIES[name](spark, DATA))
    assert "ShuffledHashJoin" in p and "_block" in p and "SortMergeJoin" not in p


def test_known_costs_are_those_of_the_rule(spark):
    c = spark.range(6 * 201).selectExpr("1L AS track", "2L AS stop", "3L AS next_track", "4L AS next_start", "id div 201 AS gap", "id % 201 AS displacement")
    want = {(r.gap, r.displacement): r.cost for r in catalog._costed(c).collect()}
    assert {(r.gap, r.displacement): r.cost for r in c.withColumn("cost", catalog._known_cost()).collect()} == want
