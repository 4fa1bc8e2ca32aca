"""Ordered greedy decisions against one pass over the pairs in their order."""

from collections import defaultdict

import numpy as np
import pytest

from tessera.operators import merging


def _graph(rng, n, m, kind):
    if kind == "hub":
        pairs = {(0, int(b)) for b in rng.integers(1, n, m)} | {tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(m // 4)}
    elif kind == "path":
        pairs = {(k, k + 1) for k in range(n - 1)}
    else:
        pairs = {tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(m)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    w = range(len(pairs)) if kind == "path" else rng.integers(0, m // 3 + 2, len(pairs))  # ties among the others
    return [(a, b, int(x)) for (a, b), x in zip(pairs, w, strict=True)]


@pytest.mark.parametrize("kind, tail", [("any", 0), ("hub", 0), ("path", 20_000), ("any", 50)])
def test_capped_pairs_equal_the_sequential_choice(spark, monkeypatch, kind, tail):
    monkeypatch.setattr(merging, "TAIL", tail)
    monkeypatch.setattr(merging, "SALTS", 4)
    rng = np.random.default_rng(3)
    rows = _graph(rng, 60, 250, kind)
    used, want = defaultdict(int), []
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if used[a] < 3 and used[b] < 3:
            want.append((a, b, w))
            used[a] += 1
            used[b] += 1
    odd = [(5, 5, 0), (None, 3, 0), rows[0]]
    got = merging.capped_pairs(spark.createDataFrame(rows + odd, "a bigint, b bigint, w int"), ["w"], 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_capped_pairs_of_whole_keys_equal_those_of_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, 100 * k + a, 100 * k + b, w) for k, m in ((0, 60), (1, 90), (2, 250)) for a, b, w in _graph(rng, 40, m, "any")]
    pairs = spark.createDataFrame(rows, "k int, a bigint, b bigint, w int")
    want = sorted(map(tuple, merging.capped_pairs(pairs.drop("k"), ["w"], 3).collect()))
    for bound in (200_000, 150):
        monkeypatch.setattr(merging, "BOUND", bound)
        assert sorted(map(tuple, merging.capped_pairs(pairs, ["w"], 3, ["k"]).collect())) == want


def _merged(rows, labels, different):
    root, fate = {}, {}
    tags = defaultdict(set)
    for n, scope, label in labels:
        tags[n].add((scope, label))
    for _, a, b in sorted((w, a, b) for a, b, w in rows):
        for x in (a, b):
            root.setdefault(x, x)
        if root[a] == root[b]:
            fate[a, b] = "inside"
            continue
        union = [x for x in root if root[x] in (root[a], root[b])]
        per = defaultdict(set)
        for x in union:
            for scope, label in tags[x]:
                per[scope].add(label)
        if any(len(v) > 1 for v in per.values()) or any(p in union and q in union for p, q in different):
            fate[a, b] = "vetoed"
            continue
        fate[a, b] = "merged"
        old, new = max(root[a], root[b]), min(root[a], root[b])
        for x in union:
            root[x] = new if root[x] == old else root[x]
    return root, fate


@pytest.mark.parametrize("kind, bound, labelled", [("any", 200_000, 30), ("any", 64, 12), ("hub", 40, 8), ("path", 16, 3), ("any", 32, 0)])
def test_merging_equals_the_sequential_result(spark, monkeypatch, kind, bound, labelled):
    monkeypatch.setattr(merging, "SALTS", 4)
    rng = np.random.default_rng(bound + labelled)
    rows = _graph(rng, 60, 70 if kind == "any" else 100, kind)
    scopes = {int(n): int(rng.integers(2)) for n in rng.choice(60, labelled, replace=False)}
    labels = [(n, s, f"P{rng.integers(3)}") for n, s in scopes.items()]
    different = [tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(labelled // 3)]
    root, fate = _merged(rows, labels, different)
    tags = merging.veto_tags(spark.createDataFrame(labels, "node bigint, scope int, label string"), spark.createDataFrame(different, "a bigint, b bigint"))
    groups, fates = merging.merge_with_vetoes(spark.createDataFrame([*rows, (7, 7, 0), (None, 1, 0)], "a bigint, b bigint, w int"), tags, ["w"], bound)
    assert {r["node"]: r["root"] for r in groups.collect()} == root
    assert {(r["a"], r["b"]): r["fate"] for r in fates.collect()} == fate
    assert labelled == 0 or "vetoed" in fate.values()


def test_a_statement_outlives_a_chain(spark):
    """Two fragments that a person called different stay apart however others tie them."""
    rows = [(1, 2, 1), (2, 3, 2), (3, 4, 3)]
    tags = merging.veto_tags(spark.createDataFrame([], "node bigint, scope int, label string"), spark.createDataFrame([(1, 4)], "a bigint, b bigint"))
    groups, fates = merging.merge_with_vetoes(spark.createDataFrame(rows, "a bigint, b bigint, w int"), tags, ["w"])
    assert {r["node"]: r["root"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {(r["a"], r["b"]) for r in fates.where("fate = 'vetoed'").collect()} == {(3, 4)}


def test_nothing_to_merge(spark):
    empty = spark.createDataFrame([], "a bigint, b bigint, w int")
    groups, fates = merging.merge_with_vetoes(empty, spark.createDataFrame([], "node bigint, tag string, value string"), ["w"])
    assert groups.count() == fates.count() == merging.capped_pairs(empty, ["w"], 3).count() == 0
