"""All vectors against all by blocks: matrix products in tasks, a bounded number of best ones leaves each block pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block at most; a task holds two blocks. Every vector is copied once or twice for each block, so blocks are as large as memory allows.
BLOCK = 32768
#: Small tables are dealt to PARTS blocks, of SMALL vectors at least, to occupy more tasks.
PARTS, SMALL = 8, 2048
#: Products that a task holds at a time.
CELLS = 1 << 22
#: Distances in 1e-6 lie between 0 and this but for rounding.
TOP = 2_000_000


def _block_pairs(vectors: DataFrame, ident: str, vector: str, carry: str, once: bool) -> DataFrame:
    """(x, y, side, ident, vector, carry): every block x met with every block y, with ``once`` only for x <= y; a task takes a few of the pairs."""
    rows = vectors.count()
    n = max(1, -(-rows // BLOCK), min(PARTS, -(-rows // SMALL)))
    dealt = vectors.select(F.pmod(F.xxhash64(ident), F.lit(n)).cast("int").alias("own"), ident, vector, carry)
    every = lambda low, high: F.explode(F.sequence(low, high))
    own, zero, last = F.col("own"), F.lit(0), F.lit(n - 1)
    left = dealt.withColumn("y", every(own if once else zero, last)).select(own.alias("x"), "y", F.lit(0).alias("side"), ident, vector, carry)
    right = dealt.withColumn("x", every(zero, own if once else last)).select("x", own.alias("y"), F.lit(1).alias("side"), ident, vector, carry)
    return left.union(right).repartition(2 * n * n, "x", "y")  # by size alone, a few tasks would get all the products


def nearest_vectors(vectors: DataFrame, ident: str, vector: str, carry: str, k: int) -> DataFrame:
    """(ident, other, carry of the other, d, place): the k nearest others by cosine distance in 1e-6, ties by id.

    Vectors needn't be of length 1. The work is quadratic, as the question is, but spread over block pairs, and no pair of
    vectors leaves a task that isn't among a block's k best of its row.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["side"] == 0], f[f["side"] == 1]
        empty = pd.DataFrame({"id": [], "other": [], "note": [], "d": []}).astype({"id": "int64", "other": "int64", "note": "int64", "d": "int64"})
        if a.empty or b.empty:
            return empty
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        va, vb = (unit(np.stack(x[vector].to_numpy()).astype(np.float64)) for x in (a, b))
        ia, ib, note = a[ident].to_numpy(), b[ident].to_numpy(), b[carry].to_numpy()
        out = []
        step = max(1, CELLS // len(ib))
        for at in range(0, len(ia), step):
            d = np.floor((1 - va[at : at + step] @ vb.T) * 1e6 + 0.5).astype(np.int64)
            d[ia[at : at + step, None] == ib[None, :]] = 1 << 40
            kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            i, j = np.nonzero((d <= kth[:, None]) & (d < 1 << 40))
            out.append(pd.DataFrame({"id": ia[at + i], "other": ib[j], "note": note[j], "d": d[i, j]}))
        return pd.concat(out, ignore_index=True)

    found = _block_pairs(vectors, ident, vector, carry, False).groupBy("x", "y").applyInPandas(run, "id bigint, other bigint, note bigint, d bigint")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k).select(F.col("id").alias(ident), "other", F.col("note").alias(carry), "d", "place")


def distance_histogram(vectors: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """(same, d, n): how many pairs of vectors with equal and with different labels lie at each cosine distance in 1e-6."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["side"] == 0], f[f["side"] == 1]
        counts, odd = np.zeros(2 * (TOP + 1), dtype=np.int64), []
        if not (a.empty or b.empty):
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            va, vb = (unit(np.stack(x[vector].to_numpy()).astype(np.float64)) for x in (a, b))
            ia, ib, la, lb = a[ident].to_numpy(), b[ident].to_numpy(), a[label].to_numpy(), b[label].to_numpy()
            own, step = f["x"].iloc[0] == f["y"].iloc[0], max(1, CELLS // len(ib))
            for at in range(0, len(ia), step):
                s = slice(at, at + step)
                d = np.floor((1 - va[s] @ vb.T) * 1e6 + 0.5).astype(np.int64)
                same = la[s, None] == lb[None, :]
                if own:  # equal ids are in one block
                    first = ia[s, None] < ib[None, :]
                    d, same = d[first], same[first]
                far = (d < 0) | (d > TOP)
                if far.any():
                    odd += zip(same[far].tolist(), d[far].tolist(), strict=True)
                    d, same = d[~far], same[~far]
                d += same * (TOP + 1)
                counts += np.bincount(d.ravel(), minlength=len(counts))
        at = np.flatnonzero(counts)
        rows = pd.DataFrame({"same": at > TOP, "d": at % (TOP + 1), "n": counts[at]})
        more = pd.DataFrame(odd, columns=["same", "d"]).assign(n=1).astype(rows.dtypes.to_dict())
        return pd.concat([rows, more], ignore_index=True) if odd else rows

    pairs = _block_pairs(vectors, ident, vector, label, True).groupBy("x", "y").applyInPandas(run, "same boolean, d bigint, n bigint")
    return pairs.groupBy("same", "d").agg(F.sum("n").alias("n"))
