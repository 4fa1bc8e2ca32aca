"""Gradient-boosted trees from histograms, with a direction for missing values, for several folds at once.

Features are cut into bins once. A level of all folds' trees is one pass: every partition sums gradients by tree node, feature
and bin, Spark adds the sums up, and the driver gets a table whose size follows from nodes, features and bins alone. Sums are
of whole numbers (gradients in 2^-20), so a tree doesn't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

UNIT = 1 << 20
#: After so many trees the rows are written again with their margins, which bounds the trees that a pass walks.
REFRESH = 16


@dataclass
class Settings:
    trees: int = 12
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    l2: float = 1.0
    least_rows: int = 10


@dataclass
class Tree:
    """A complete binary tree by level: node i has children 2i + 1 and 2i + 2; a node without a feature is a leaf."""

    feature: np.ndarray
    last_left: np.ndarray  # the last bin that goes left
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of ``bins`` stops (bin 0: missing)."""
        at = np.zeros(len(bins), dtype=np.int64)
        while True:
            f = self.feature[at]
            go = f >= 0
            if not go.any():
                return at
            b = bins[np.arange(len(bins)), np.maximum(f, 0)]
            left = np.where(b == 0, self.missing_left[at], b <= self.last_left[at])
            at = np.where(go, 2 * at + 2 - left, at)


@dataclass
class Model:
    """Bin edges of every feature, and for each fold left out a start and trees."""

    edges: list[np.ndarray]
    folds: list
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins from 1; 0 where a value is missing (NaN)."""
        out = np.zeros(x.shape, dtype=np.int16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], side="left"))
        return out

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        """(rows, folds): the sums of trees from ``since`` on."""
        out = np.zeros((len(bins), len(self.folds)))
        for m, trees in enumerate(self.trees):
            for t in trees[since:]:
                out[:, m] += t.value[t.node(bins)]
        return out


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(-1, width)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> tuple[float, int, int, bool]:
    """(gain, feature, last bin that goes left, missing goes left) of sums by feature and bin; gain 0 without a split."""
    total_g, total_h = g[0].sum(), h[0].sum()
    score = lambda a, b: a * a / (b + s.l2)
    best = (0.0, -1, 0, False)
    for j in range(len(g)):
        for missing_left in (False, True):
            left = [np.cumsum(v[j, 1:]) + (v[j, 0] if missing_left else 0) for v in (g, h, n)]
            gain = score(left[0], left[1]) + score(total_g - left[0], total_h - left[1]) - score(total_g, total_h)
            gain = np.where((left[2] >= s.least_rows) & (n[j].sum() - left[2] >= s.least_rows), gain, 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), j, k + 1, missing_left)
    return best


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 distinct quantiles of every feature; a feature that is always missing has none."""
    value = F.when(~F.isnan("v"), F.col("v"))
    cuts = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.percentile_approx(value, [k / bins for k in range(1, bins)], 10_000).alias("q")).collect()  # one row a feature
    found = {r["j"]: np.unique(r["q"]) if r["q"] else np.empty(0) for r in cuts}
    return [found.get(j, np.empty(0)) for j in range(width)]


def fit(rows: DataFrame, width: int, settings: Settings | None = None, folds: list | None = None) -> Model:
    """A model for each value in ``folds`` of the rows' other folds, or one model of all rows.

    ``rows``: (x array<double> of ``width`` values, y 0 or 1, fold). Null and NaN features are missing, rows without y are ignored.
    """
    s = settings or Settings()
    rows = rows.where("y is not null and x is not null").select(F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("x"), F.col("y").cast("double").alias("y"), F.col("fold").cast("string").alias("fold"))
    names = [None] if folds is None else [str(f) for f in folds]
    model = Model(bin_edges(rows, width, s.bins), names, np.zeros(len(names)), [[] for _ in names])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = model.binned(_matrix(b.column("x"), width, np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * width, type=pa.int32()), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([lists, b.column("y"), b.column("fold")], names=["b", "y", "fold"])

    sums = {r["fold"]: (r["n"], r["y"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}  # one row a fold
    for m, name in enumerate(names):
        n, y = np.sum([v for f, v in sums.items() if name is None or f != name] or [(0, 0)], axis=0)
        model.start[m] = np.log((y + 1) / (n - y + 1))
    start = F.array(*[F.lit(float(v)) for v in model.start])
    table, since = cut(rows.mapInArrow(prepare, "b array<smallint>, y double, fold string").withColumn("m", start), "boosting-rows"), 0
    size = s.bins + 1

    def margins(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bins = _matrix(b.column("b"), width, np.int64)
        return bins, _matrix(b.column("m"), len(names), np.float64) + model.margins(bins, since)

    def refreshed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, f = margins(b)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * len(names), type=pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("b"), b.column("y"), b.column("fold"), lists], names=["b", "y", "fold", "m"])

    for t in range(s.trees):
        if t and t % REFRESH == 0:
            table, since = cut(table.mapInArrow(refreshed, "b array<smallint>, y double, fold string, m array<double>"), "boosting-rows"), t
        grown = [Tree.empty(s.depth) for _ in names]
        for level in range(s.depth + 1):
            first, count = 2**level - 1, 2**level

            def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((3, len(names) * count * width * size))
                for b in batches:
                    bins, f = margins(b)
                    y, own = b.column("y").to_numpy(), np.array(b.column("fold").to_pylist(), dtype=object)
                    for m, name in enumerate(names):
                        p = 1 / (1 + np.exp(-f[:, m]))
                        at = grown[m].node(bins)  # noqa: B023
                        on = (own != name if name is not None else np.ones(len(y), dtype=bool)) & (at >= first)  # noqa: B023
                        g, h = np.rint((p - y)[on] * UNIT), np.rint((p * (1 - p))[on] * UNIT)
                        cell = ((m * count + at[on] - first)[:, None] * width + np.arange(width)) * size + bins[on]  # noqa: B023
                        for q, w in enumerate((g, h, np.ones(len(g)))):
                            total[q] += np.bincount(cell.ravel(), weights=np.repeat(w, width), minlength=total.shape[1])
                k = np.flatnonzero(total[2])
                yield pa.RecordBatch.from_arrays([pa.array(k), *[pa.array(v[k].astype(np.int64)) for v in total]], names=["k", "g", "h", "n"])

            parts = table.mapInArrow(sums_of, "k bigint, g bigint, h bigint, n bigint").groupBy("k").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect()  # folds x nodes x features x bins rows
            total = np.zeros((3, len(names) * count * width * size))
            for r in parts:
                total[:, r["k"]] = r["g"] / UNIT, r["h"] / UNIT, r["n"]
            total = total.reshape(3, len(names), count, width, size)
            for m, tree in enumerate(grown):
                for k in range(count):
                    g, h, n = total[:, m, k]
                    if not n[0].sum():
                        continue
                    tree.value[first + k] = -s.rate * g[0].sum() / (h[0].sum() + s.l2)
                    if level < s.depth:
                        gain, j, last, missing_left = best_split(g, h, n, s)
                        if gain > 0:
                            tree.feature[first + k], tree.last_left[first + k], tree.missing_left[first + k] = j, last, missing_left
        for m, tree in enumerate(grown):
            model.trees[m].append(tree)
    return model


def predict(rows: DataFrame, model: Model, keep: list[str], width: int) -> DataFrame:
    """(``keep``, score): the probability of 1, by the model that left the row's fold out, or by the only one; null where there is none."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = model.binned(_matrix(b.column("_x"), width, np.float64)).astype(np.int64)
            f = model.start + model.margins(bins)
            which = [0 if model.folds == [None] else model.folds.index(v) if v in model.folds else -1 for v in b.column("_fold").to_pylist()]
            p = 1 / (1 + np.exp(-f[np.arange(len(f)), which]))
            score = pa.array(p, mask=np.array(which, dtype=int) < 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), score], names=[*keep, "score"])

    x = F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    return rows.where("x is not null").select(*keep, x.alias("_x"), F.col("fold").cast("string").alias("_fold")).mapInArrow(run, schema)
