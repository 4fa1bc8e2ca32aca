"""Boosted trees against a plain version that sorts rows into nodes, and on missing values."""

import numpy as np
import pytest

from tessera.operators import boosting


def _plain(x, y, edges, s):
    """Margins of the training rows, tree by tree, each grown by trying every cut of every feature on the rows themselves."""
    f = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-f))
        g, h = np.rint((p - y) * boosting.UNIT) / boosting.UNIT, np.rint(p * (1 - p) * boosting.UNIT) / boosting.UNIT
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + s.l2)  # noqa: B023, E731

        def grow(rows, depth):
            f[rows] += -s.rate * g[rows].sum() / (h[rows].sum() + s.l2) if depth == s.depth else 0  # noqa: B023
            if depth == s.depth:
                return
            best = (1e-9, None)
            for j in range(x.shape[1]):
                for missing_left in (False, True):
                    for e in [*edges[j], np.inf]:
                        left = np.array([r for r in rows if (missing_left if np.isnan(x[r, j]) else x[r, j] <= e)], dtype=int)
                        right = np.setdiff1d(rows, left)
                        if min(len(left), len(right)) >= s.least_rows:
                            gain = score(left) + score(right) - score(rows)  # noqa: B023
                            if gain > best[0] + 1e-9:
                                best = (gain, left, right)
            if best[1] is None:
                f[rows] += -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)  # noqa: B023
            else:
                grow(best[1], depth + 1)
                grow(best[2], depth + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-f))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(160, 3)), 1)
    x[rng.random(x.shape) < 0.15] = np.nan
    y = ((np.nan_to_num(x[:, 0], nan=2.0) + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(0, 0.3, 160)) > 0.8).astype(float)
    return x, y


def _rows(spark, x, y, fold="a"):
    return spark.createDataFrame([(k, [None if np.isnan(v) else float(v) for v in r], None if t is None else int(t), fold if isinstance(fold, str) else fold[k]) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id bigint, x array<double>, y int, fold string")


def test_trees_equal_a_plain_version_whatever_the_partitions(spark, data, monkeypatch):
    x, y = data
    monkeypatch.setattr(boosting, "REFRESH", 2)
    s = boosting.Settings(trees=4, depth=2, bins=6, rate=0.5, least_rows=8)
    rows = _rows(spark, x, y)
    got = []
    for parts in (1, 5):
        model = boosting.fit(rows.repartition(parts), 3, s)
        got.append([r["score"] for r in boosting.predict(rows, model, ["id"], 3).orderBy("id").collect()])
    assert got[0] == got[1]
    assert np.allclose(got[0], _plain(x, y, model.edges, s), atol=1e-9)


def test_folds_are_left_out_and_missing_values_have_a_direction(spark, data):
    x, y = data
    fold = ["a" if k % 2 else "b" for k in range(len(y))]
    s = boosting.Settings(trees=5, depth=2, bins=8, least_rows=5)
    both = boosting.fit(_rows(spark, x, y, fold), 3, s, ["a", "b"])
    again = boosting.fit(_rows(spark, x, [1 - t if f == "a" else t for t, f in zip(y, fold, strict=True)], fold), 3, s, ["a", "b"])
    for tree, other in zip(both.trees[0], again.trees[0], strict=True):  # the first model leaves "a" out, so its labels don't matter
        assert (tree.feature == other.feature).all() and np.allclose(tree.value, other.value)
    scores = {r["id"]: r["score"] for r in boosting.predict(_rows(spark, x, y, fold), both, ["id"], 3).collect()}
    p = np.array([scores[k] for k in range(len(y))])
    assert np.mean((p > 0.5) == y) > 0.8
    loss = [-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)) for q in (p, np.full(len(y), y.mean()))]
    assert loss[0] < loss[1]
    # y follows from whether the first value is there at all
    z = x.copy()
    z[:, 0] = np.where(np.arange(len(y)) % 3 == 0, np.nan, 1.0)
    t = (np.arange(len(y)) % 3 == 0).astype(float)
    told = boosting.fit(_rows(spark, z, t), 3, boosting.Settings(trees=8, depth=1, least_rows=5))
    q = [r["score"] for r in boosting.predict(_rows(spark, z, t), told, ["id"], 3).orderBy("id").collect()]
    assert np.mean((np.array(q) > 0.5) == t) == 1.0


def test_degenerate_rows(spark):
    empty = _rows(spark, np.empty((0, 2)), [])
    model = boosting.fit(empty, 2, boosting.Settings(trees=1, depth=1))
    assert boosting.predict(empty, model, ["id"], 2).count() == 0
    blank = _rows(spark, np.full((30, 2), np.nan), [k % 2 for k in range(30)])
    model = boosting.fit(blank, 2, boosting.Settings(trees=2, depth=2))
    assert {round(r["score"], 9) for r in boosting.predict(blank, model, ["id"], 2).collect()} == {0.5}


def test_quality_of_unseen_languages(spark):
    from tessera.plans import learning

    got = learning.boosted_folds(spark, "/root/testdata/sf0.01").collect()
    p, y = np.array([r["score"] for r in got]), np.array([r["y"] for r in got])
    rank = np.argsort(np.argsort(p))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(got) > 300 and auc > 0.85
    for r in learning.boosted_report(spark, "/root/testdata/sf0.01").collect():
        assert 0 < r["threshold"] < 1 and r["right"] <= min(r["told"], r["pos"]) and r["right"] > 0.6 * r["pos"]
