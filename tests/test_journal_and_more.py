"""Two logs in one commit, exact text of doubles, bridges, and the grouped split."""

import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veldra.functions import number
from veldra.operators import allocation, bridge
from veldra.operators.contracts import ContractError
from veldra.plans import catalog_review
from veldra.sources import journal
from veldra.storage import Scratch


def logs(spark, folder):
    d = journal.read(spark, folder, "decisions", journal.DECISION_ROW).orderBy("log_pos").collect()
    a = journal.read(spark, folder, "approvals", journal.APPROVAL_ROW).orderBy("log_pos").collect()
    return [r.decision_id for r in d], [r.decision_id for r in a]


def test_confirmation_and_approval_come_together(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    assert logs(spark, folder) == ([], [])
    journal.confirm_and_approve(spark, folder, "e1", "t", "s1", "7", 0, 9, 3)
    journal.confirm_and_approve(spark, folder, "e1", "t", "s2", "8", 10, 19, 12)
    journal.confirm_and_approve(spark, folder, "e2", "t", "s2", "8", 10, 19, 12)
    want = ["dec_e1_0001", "dec_e1_0002", "dec_e2_0001"]
    assert logs(spark, folder) == (want, want)
    with pytest.raises(ContractError):
        journal.confirm_and_approve(spark, folder, "e3", "t", "s2", "8", 10, 19, 22)
    assert logs(spark, folder) == (want, want)


def test_the_second_of_two_writers_loses(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    seen = journal.head(spark, folder)
    after = journal.commit(spark, folder, {"decisions": [{"decision_id": "a"}]}, seen)
    with pytest.raises(journal.LostRace):
        journal.commit(spark, folder, {"decisions": [{"decision_id": "b"}]}, seen)
    # Both have read the same head, and one file number can be created once only.
    journal.commit(spark, folder, {"decisions": [{"decision_id": "c"}]}, after)
    real, journal.head = journal.head, lambda *_: after
    try:
        with pytest.raises(journal.LostRace):
            journal.commit(spark, folder, {"decisions": [{"decision_id": "d"}]}, after)
    finally:
        journal.head = real
    assert logs(spark, folder)[0] == ["a", "c"]


def test_a_torn_write_is_passed_over(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    journal.confirm_and_approve(spark, folder, "e1", "t", "s1", "7", 0, 9, 3)
    whole = (tmp_path / "log/commits/000000000000.json").read_text()
    (tmp_path / "log/commits/000000000001.json").write_text(whole[: len(whole) // 2])
    assert logs(spark, folder) == (["dec_e1_0001"], ["dec_e1_0001"])
    journal.confirm_and_approve(spark, folder, "e1", "t", "s1", "7", 0, 9, 3)
    assert logs(spark, folder)[0] == ["dec_e1_0001", "dec_e1_0002"]
    assert journal.head(spark, folder).n == 2


def test_a_changed_commit_breaks_the_chain(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    for e in ("e1", "e2", "e3"):
        journal.confirm_and_approve(spark, folder, e, "t", "s1", "7", 0, 9, 3)
    first = tmp_path / "log/commits/000000000000.json"
    first.write_text(first.read_text().replace("e1", "e9"))
    (tmp_path / "log/commits/.000000000000.json.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="broken chain"):
        logs(spark, folder)


def test_exact_text_of_doubles(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 5e-324, 1e-320, 1.7976931348623157e308, float("inf"), float("-inf"), None, 0.1, 1e16, 1e17, 123456789012345678.0, 0.0001, 0.00001, 2.5, 9.999999999999999e22, 1e23, 0.3]
    values += [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0] for _ in range(120)] + [rng.random() * 10 ** rng.randrange(-8, 20) for _ in range(80)]
    x = F.col("x")
    got = spark.createDataFrame([(v,) for v in values], "x double").select(x, number.double_text(x).alias("t"), number.double_hex(x).alias("h")).collect()
    for r in got:
        assert r.t == (None if r.x is None else format(r.x, ".17g"))
        assert r.h == (None if r.x is None else struct.pack(">d", r.x).hex()) or r.x != r.x


SEED = [(1, 0, 0, 10, 20, 1.0, 0.0)]
DET = "v int, frame int, track int, x1 int, y1 int, x2 int, y2 int, kit string, reliable boolean, excluded boolean"


def _bridge(spark, flow, det):
    s = spark.createDataFrame(SEED, "v int, x1 int, y1 int, x2 int, y2 int, vx double, vy double")
    f = spark.createDataFrame(flow, "v int, frame int, reliable boolean, dx double, dy double")
    return [(r.frame, r.status, r.track, r.x1) for r in bridge.carried(s, f, spark.createDataFrame(det, DET), "v").orderBy("frame").collect()]


def test_a_bridge_is_accepted_after_three_picks(spark):
    flow = [(1, f, True, 5.0, 0.0) for f in range(1, 7)]
    det = [(1, f, 7, 6 * f, 0, 6 * f + 10, 20, "YELLOW", True, False) for f in range(1, 7)] + [(1, 2, 9, 12, 0, 22, 20, "WHITE", True, False)]
    assert _bridge(spark, flow, det) == [(1, "DETECTOR_SNAP", 7, 6.0), (2, "DETECTOR_SNAP", 7, 12.0), (3, "BRIDGE_ACCEPTED", 7, 18.0)]


def test_a_bridge_ends_after_five_unreliable_frames(spark):
    flow = [(1, f, f % 2 == 0, 2.0, 0.0) for f in range(1, 14)]
    got = _bridge(spark, flow, [(1, 3, 7, 3, 0, 13, 20, "YELLOW", True, False)])
    assert [g[0] for g in got] == list(range(1, 10)) and got[0][1] == "BRIDGE_FLOW_UNRELIABLE" and got[1][1] == "TARGET_UNRESOLVED"
    assert got[2] == (3, "TARGET_UNRESOLVED", None, 4.0) and got[3][3] == 5.0  # a pick without reliable flow leaves the box where it was


def test_ambiguous_and_excluded_detections(spark):
    flow = [(1, 1, True, 0.0, 0.0)]
    two = [(1, 1, t, 0, 0, 10, 20, "YELLOW", True, False) for t in (1, 2)]
    assert _bridge(spark, flow, two)[0][1:3] == ("TARGET_UNRESOLVED", None)
    assert _bridge(spark, flow, [*two[:1], (1, 1, 2, 0, 0, 10, 20, "YELLOW", True, True)])[0][1:3] == ("DETECTOR_SNAP", 1)
    assert _bridge(spark, flow, [(1, 1, 2, 0, 0, 30, 20, "YELLOW", True, False)])[0][1:3] == ("TARGET_UNRESOLVED", None)  # three times as large


def test_split_keeps_groups_whole_and_equals_plain_code(spark):
    d = "/root/testdata/sf0.001"
    items, edges = catalog_review.split_inputs(spark, d)
    # Few scarce items, so that the search has to come down from what the batches could hold.
    items = items.withColumn("source", F.when(F.col("id") % 97 == 0, "recomputed").otherwise("reused"))
    strata, least = {f"batch_{i}": {"low": 3, "mid": 2, "high": 1} for i in range(4)}, {f"batch_{i}": 1 for i in range(4)}
    caps = catalog_review.SPLIT_CAPS
    got, quotas = allocation.clean_split(items, edges, ["shot"], "recomputed", strata, least, ["low", "mid", "high"], ["high", "mid", "low"], caps, Scratch(spark, "test"))
    rows = got.orderBy("batch", "batch_order").collect()
    root = {r.id: r.id for r in items.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shots = defaultdict(list)
    for r in items.where("shot is not null").collect():
        shots[r.shot].append(r.id)
    for a, b in [*((e.a, e.b) for e in edges.collect()), *((s[0], x) for s in shots.values() for x in s)]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert all(r.grp == find(r.id) for r in rows) and 4 <= sum(quotas.values()) <= 11
    owners = defaultdict(set)
    for r in rows:
        owners[r.grp].add(r.batch)
    assert max(map(len, owners.values())) == 1
    assert {b: sum(r.batch == b and r.source == "recomputed" for r in rows) for b in strata} == quotas
    for b, want in strata.items():
        assert {s: sum(r.batch == b and r.stratum == s for r in rows) for s in want} == want
