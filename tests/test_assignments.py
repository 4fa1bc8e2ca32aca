"""The ordered and optimal operators' queries against brute force on their own input."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.operators import greedy
from tessera.plans import scoring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(7)
    looks = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    rows = [(b, 100 * b + k, (looks[rng.integers(5)] + rng.normal(0, 0.12, 8)).tolist(), int(rng.integers(8))) for b in range(3) for k in range(22)]
    return rows, spark.createDataFrame(rows, "b int, i bigint, v array<double>, t int")


def _cosine(a, b):
    return 1 - float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def test_online_people_joins_the_nearest_person(people):
    rows, df = people
    got = {r["i"]: r["person"] for r in greedy.online_people(df, ["b"], "i", "v", 0.3).collect()}
    for b in range(3):
        groups: list[list] = []
        for _, i, v, _ in sorted(r for r in rows if r[0] == b):
            near = [(sum(sorted(_cosine(v, w) for w in g)[:3]) / min(3, len(g)), k) for k, g in enumerate(groups)]
            best = min(near, default=(9, -1))
            if best[0] < 0.3:
                groups[best[1]].append(v)
            else:
                groups.append([v])
            assert got[i] == (best[1] if best[0] < 0.3 else len(groups) - 1)


def _clusters(rows, gate, average):
    """Members as sets; the closest pair of clusters that may be joined, or the closest pair of members in order."""
    groups = [{i} for _, i, _, _ in rows]
    look, tag = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    may = lambda p, q: not {tag[x] for x in p} & {tag[x] for x in q}
    if average:
        while True:
            options = [(np.mean([_cosine(look[x], look[y]) for x in p for y in q]), min(p), min(q)) for p, q in combinations(groups, 2) if may(p, q)]
            best = min(options, default=(9,))
            if best[0] > gate:
                return groups
            p, q = (next(g for g in groups if min(g) == m) for m in best[1:])
            groups = [g for g in groups if g not in (p, q)] + [p | q]
    for d, x, y in sorted((_cosine(look[x], look[y]), x, y) for x, y in combinations(sorted(look), 2)):
        p, q = (next(g for g in groups if m in g) for m in (x, y))
        if d <= gate and p is not q and may(p, q):
            groups = [g for g in groups if g is not p and g is not q] + [p | q]
    return groups


@pytest.mark.parametrize("average", [False, True])
def test_clusters_with_vetoes(people, average):
    rows, df = people
    got = defaultdict(set)
    for r in greedy.cannot_link_clusters(df, ["b"], "i", "v", "t", 0.25, average).collect():
        got[r["cluster"]].add(r["i"])
    want = [g for b in range(3) for g in _clusters([r for r in rows if r[0] == b], 0.25, average)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and len(want) < len(rows)


def test_matched_events_are_as_many_and_as_close_as_can_be(spark):
    rng = np.random.default_rng(3)
    rows = lambda n, first: [(int(k % 3), first + k, int(t)) for k, t in enumerate(rng.integers(0, 300, n))]
    a, b = rows(24, 0), rows(27, 1000)
    schema = "u int, e bigint, t bigint"
    got = greedy.match_events(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["u"], "e", "t", 12).collect()
    for u in range(3):
        x, y = [r for r in a if r[0] == u], [r for r in b if r[0] == u]
        best = {frozenset(): (0, 0)}  # right ids used: most pairs, then least distance
        for _, _, t in x:
            for used, (n, d) in list(best.items()):
                for _, e, s in y:
                    if e not in used and abs(t - s) <= 12:
                        new, value = used | {e}, (n + 1, d - abs(t - s))
                        best[new] = max(best.get(new, (0, 0)), value)
        n, d = max(best.values())
        own = [r for r in got if r["left_id"] in {e for _, e, _ in x}]
        assert (len(own), -sum(r["distance"] for r in own)) == (n, d)
        assert max(Counter(r["right_id"] for r in own).values(), default=1) == 1


def test_suppression_keeps_the_best_of_close_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 2), k, int(t), float(s)) for k, (t, s) in enumerate(zip(rng.integers(0, 500, 120), rng.integers(0, 9, 120), strict=True))]
    got = {r["i"] for r in greedy.suppress(spark.createDataFrame(rows, "u int, i bigint, t bigint, s double"), ["u"], "i", "t", "s", 9).collect()}
    kept: list = []
    for u, i, t, s in sorted(rows, key=lambda r: (-r[3], r[2], r[1])):
        if all(v != u or abs(t - w) >= 9 for v, w, _ in kept):
            kept.append((u, t, i))
    assert got == {i for *_, i in kept}


def test_identity_score_takes_the_best_assignment(spark):
    table = {(r["truth"], r["found"]): r["n"] for r in scoring._contingency(spark, SF).collect()}
    truth, found = sorted({t for t, _ in table}), sorted({f for _, f in table})
    best = {0: 0}  # found identities used, as bits
    for t in truth:
        for used, n in list(best.items()):
            for k, f in enumerate(found):
                if not used >> k & 1:
                    best[used | 1 << k] = max(best.get(used | 1 << k, 0), n + table.get((t, f), 0))
    (r,) = scoring.idf1_assignment(spark, SF).collect()
    total = sum(table.values())
    assert (r["matched"], r["truth"], r["found"]) == (max(best.values()), total, total)
    assert r["idf1"] == pytest.approx(r["matched"] / total)
