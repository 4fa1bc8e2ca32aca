"""Kept moments against the sequential rule."""

import numpy as np

from tessera.operators import spacing


def test_first_of_close_moments_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(t)) for k, n, span in ((1, 300, 900), (2, 40, 4000), (3, 1, 5), (4, 200, 250)) for t in rng.integers(0, span, n)] + [(5, None), (None, 7)]
    got = sorted(tuple(r) for r in spacing.first_of_close(spark.createDataFrame(rows, "k int, t bigint"), ["k"], "t", 3).collect() if r["k"] is not None)
    want = []
    for k in range(1, 5):
        last = None
        for t in sorted({t for q, t in rows if q == k}):
            if last is None or t - last > 3:
                want.append((k, t))
                last = t
    assert got == sorted(want) and len(got) < 500


def test_next_after(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 3, 4, 10)], "k int, t bigint")
    assert sorted((r["t"], r["next"]) for r in spacing.next_after(df, ["k"], "t", 3).collect()) == [(0, 4), (3, 10), (4, 10), (10, None)]
