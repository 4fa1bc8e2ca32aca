"""Operators on small hand-made tables."""

from itertools import permutations

import numpy as np
import pytest

from tessera.operators import graph, greedy, intervals, overlay, sequences, temporal_joins, tracking
from tessera.sources import read_door_log, write_export


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_interval_union_with_slack(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 12, 20), ("a", 2, 3), ("a", 30, 31), ("b", 5, 6)], "k string, s bigint, e bigint")
    assert _rows(intervals.interval_union(df, ["k"], "s", "e"), "k", "s", "e") == [("a", 0, 10), ("a", 12, 20), ("a", 30, 31), ("b", 5, 6)]
    assert _rows(intervals.interval_union(df, ["k"], "s", "e", 2), "k", "s", "e") == [("a", 0, 20), ("a", 30, 31), ("b", 5, 6)]


def test_blocks(spark):
    df = spark.createDataFrame([(0, 25), (7, 7)], "s bigint, e bigint")
    assert _rows(intervals.cut_blocks(df, "s", "e", 10), "s", "e") == [(0, 10), (7, 7), (10, 20), (20, 25)]


def test_overlap_join_finds_every_pair_once(spark):
    rng = np.random.default_rng(2)
    spans = [(int(i), int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 300, 60), rng.integers(0, 90, 60), strict=True))]
    a = spark.createDataFrame([(1, *x) for x in spans], "k int, i int, s bigint, e bigint")
    b = a.select("k", a.i.alias("j"), a.s.alias("s2"), a.e.alias("e2"))
    got = _rows(intervals.bucketed_overlap_join(a, b, ["k"], ("s", "e"), ("s2", "e2"), 25), "i", "j")
    assert got == sorted((i, j) for i, s, e in spans for j, s2, e2 in spans if s <= e2 and s2 <= e)


def test_temporal_joins(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 205), (3, "b", 50)], "id bigint, k string, t bigint")
    right = spark.createDataFrame([("a", 90, 7), ("a", 100, 8), ("a", 210, 9)], "k string, t bigint, r bigint")
    assert _rows(temporal_joins.asof_last(left, right, ["k"], "t", ["r"], 50).fillna(-1), "id", "right_t", "r") == [(1, 100, 8), (2, -1, -1), (3, -1, -1)]
    assert _rows(temporal_joins.nearest(left, right, ["k"], "t", "id", "r", 10).fillna(-1), "id", "r", "distance") == [(1, 8, 0), (2, 9, 5), (3, -1, -1)]
    assert _rows(temporal_joins.within(left, right, ["k"], "t", 5), "id") == [(1,), (2,)]
    assert _rows(temporal_joins.within(left, right, ["k"], "t", 4, "left_anti"), "id") == [(2,), (3,)]


def test_sequences(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, None, 1, -1, None, 1])], "k string, t bigint, side int")
    states = sequences.hysteresis(df, ["k"], ["t"], "side").orderBy("t").collect()
    assert [r["state"] for r in states] == [1, 1, 1, -1, -1, 1] and [r["t"] for r in states if r["crossing"]] == [3, 5]
    runs = sequences.runs(df, ["k"], ["t"], "side", df.t, df.t)
    assert _rows(runs, "run", "side", "first", "last", "n") == [(1, 1, 0, 2, 2), (2, -1, 3, 3, 1), (3, 1, 5, 5, 1)]
    med = sequences.median5(df.selectExpr("k", "t", "cast(t + 5 as double) as v"), ["k"], ["t"], "v").orderBy("t").collect()
    assert [r["median5"] for r in med] == [5.0, 6.0, 7.0, 8.0, 8.0, 8.0]
    filled = sequences.gap_fill(spark.createDataFrame([("a", 0, 0.0), ("a", 3, 6.0), ("a", 9, 1.0)], "k string, s bigint, v double"), ["k"], "s", "v", 4)
    assert _rows(filled, "s", "v", "filled") == [(0, 0.0, False), (1, 2.0, True), (2, 4.0, True), (3, 6.0, False), (9, 1.0, False)]


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (3, 5), (5, 2), (4, 4)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.integers(0, 9, shape).astype(float)
        small, wide = (cost, cost.shape[1]) if shape[0] <= shape[1] else (cost.T, cost.shape[0])
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(wide), len(small)))
        pairs = greedy.assignment(cost)
        assert len(pairs) == min(shape) and sum(cost[i, j] for i, j in pairs) == best
    assert greedy.assignment(np.empty((0, 3))) == []


def test_matching_prefers_more_pairs(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 14), ("b", 3, 0)], "k string, id bigint, t bigint")
    right = spark.createDataFrame([("a", 5, 13), ("a", 6, 19)], "k string, id bigint, t bigint")
    assert _rows(greedy.match_events(left, right, ["k"], "id", "t", 5), "left_id", "right_id", "distance") == [(1, 5, 3), (2, 6, 5)]


def test_suppression(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 2, 3, 5.0), ("a", 3, 6, 4.0), ("a", 4, 8, 2.0), ("b", 5, 0, 0.0)], "k string, id bigint, t bigint, s double")
    assert _rows(greedy.suppress(df, ["k"], "id", "t", "s", 5), "id") == [(2,), (4,), (5,)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7)], "a bigint, b bigint")
    got = dict(_rows(graph.components(edges), "node", "root"))
    assert {got[k] for k in range(21)} == {0} and {got[k] for k in (40, 45, 50)} == {40}


def test_overlay(spark):
    ops = [("c", 1, 1, "early"), ("c", 2, 0, "x"), ("c", 3, 0, "stale"), ("c", 4, 1, "y"), ("c", 5, 3, "gap"), ("d", 1, 0, "z")]
    taken = overlay.accepted(spark.createDataFrame(ops, "clip string, seq bigint, expected bigint, op string"), ["clip"])
    assert _rows(taken, "op", "revision") == [("x", 1), ("y", 2), ("z", 1)]
    pieces = spark.createDataFrame([("p", f, f"o{f}", "base") for f in range(4)], "piece string, frame bigint, observation string, value string")
    spans = spark.createDataFrame([("p", 1, 2, "old", 1), ("p", 2, 2, "new", 5)], "piece string, start bigint, stop bigint, value string, sequence bigint")
    over = spark.createDataFrame([("o2", "mine", 3), ("o3", "a", 1), ("o3", "b", 2)], "observation string, value string, sequence bigint")
    assert _rows(overlay.effective(pieces, spans, over), "observation", "value") == [("o0", "base"), ("o1", "old"), ("o2", "new"), ("o3", "b")]
    now = spark.createDataFrame([(1, "e"), (2, "f")], "id bigint, evidence string")
    made = spark.createDataFrame([(1, "e"), (2, "x"), (3, "e")], "id bigint, evidence string")
    assert _rows(overlay.pinned(made, now, "id"), "id", "applies") == [(1, True), (2, False), (3, False)]


def test_door_log_skips_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event_id": "a", "unix_ms": 1}\n{"event_id": "a", "unix_ms": 1}\n{"event_id": "b", "unix')
    assert _rows(read_door_log(spark, str(tmp_path)), "event_id") == [("a",)]


def test_tracks_of_two_crossing_walkers(spark):
    rows = [("c", 10 * t + k, float(t), float(t if k == 0 else 9 - t) * 2, float(k)) for t in range(10) for k in (0, 1)] + [("c", 999, 5.0, 500.0, 0.0)]
    df = spark.createDataFrame(rows, "clip string, id bigint, t double, x double, y double")
    got = {r["id"]: r["track"] for r in tracking.track(df, ["clip"], "id", "t", ["x", "y"], 2.5, 1.0, 2.0, 3).collect()}
    assert all(got[10 * t + k] == k for t in range(10) for k in (0, 1)) and got[999] is None


def test_exports_are_keyed_by_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id bigint, v string")
    path = write_export(df, str(tmp_path))
    assert write_export(df.repartition(3).orderBy("v"), str(tmp_path)) == path
    assert write_export(df.limit(2), str(tmp_path)) != path
    assert spark.read.json(path).count() == 3
