"""Nearest and counted neighbours in time, found in sorted buckets without making the pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .greedy import per_group


class WaveletRanks:
    """Whole numbers below ``len(ranks)`` in a row: counts and order statistics of any stretch of them, in logarithmic steps."""

    def __init__(self, ranks: np.ndarray):
        self.bits = range(max(1, int(len(ranks)).bit_length()) - 1, -1, -1)
        self.zeros = []
        for bit in self.bits:
            low = (ranks >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            ranks = np.concatenate([ranks[low], ranks[~low]])

    def below(self, begin: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of the numbers from ``begin`` to before ``end`` are less than ``limit``."""
        n = np.zeros(len(begin), dtype=np.int64)
        for bit, z in zip(self.bits, self.zeros, strict=True):
            b, e, one = z[begin], z[end], (limit >> bit) & 1 == 1
            n += np.where(one, e - b, 0)
            begin, end = np.where(one, z[-1] + begin - b, b), np.where(one, z[-1] + end - e, e)
        return n

    def smallest(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of the numbers from ``begin`` to before ``end``, which are more than ``k``."""
        found, k = np.zeros(len(begin), dtype=np.int64), k.copy()
        for bit, z in zip(self.bits, self.zeros, strict=True):
            b, e = z[begin], z[end]
            one = k >= e - b
            found |= np.where(one, 1 << bit, 0)
            k -= np.where(one, e - b, 0)
            begin, end = np.where(one, z[-1] + begin - b, b), np.where(one, z[-1] + end - e, e)
        return found


def _bucketed(points: DataFrame, asks: DataFrame, width: int) -> DataFrame:
    """Both sides (p: true for points; t) by buckets of ``width``: asks in their own, points in theirs and the next."""
    at = points.withColumn("bucket", F.explode(F.expr(f"array(floor(t / {width}), floor(t / {width}) + 1)"))).withColumn("p", F.lit(True))
    return at.unionByName(asks.withColumn("bucket", F.expr(f"floor(t / {width})")).withColumn("p", F.lit(False)), allowMissingColumns=True)


def last_alike(points: DataFrame, asks: DataFrame, width: int, reach: int) -> DataFrame:
    """(key, start, before, stop, n): for each ask (who, t, x) the last point (who, t, x) in the ``width`` before t whose x
    differs by ``reach`` at most, the greatest ``who`` among equal times; and how many such points there are (asks without any are left out)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        p = f[f["p"]].sort_values(["t", "who"])
        q = f[~f["p"]]
        t, x, who = (p[c].to_numpy(dtype=np.int64) for c in ["t", "x", "who"])
        qt, qx = q["t"].to_numpy(dtype=np.int64), q["x"].to_numpy(dtype=np.int64)
        by_x = np.argsort(x, kind="stable")
        tree, x = WaveletRanks(by_x), x[by_x]
        begin, end = np.searchsorted(x, qx - reach, "left"), np.searchsorted(x, qx + reach, "right")
        upto = tree.below(begin, end, np.searchsorted(t, qt, "left"))
        n = upto - tree.below(begin, end, np.searchsorted(t, qt - width, "left"))
        some = n > 0
        last = tree.smallest(begin[some], end[some], upto[some] - 1)
        return pd.DataFrame({"key": q["who"].to_numpy(dtype=np.int64)[some], "start": qt[some], "before": who[last], "stop": t[last], "n": n[some]})

    known = "who is not null and t is not null and x is not null"
    rows = _bucketed(points.select("who", "t", "x").where(known), asks.select("who", "t", "x").where(known), width)
    return per_group(rows, ["bucket"], [], run, "key bigint, start bigint, before bigint, stop bigint, n bigint")


def nearest_before(points: DataFrame, asks: DataFrame, width: int, most: int, own: int) -> DataFrame:
    """(key, ask, rank, other, gap, all): for each ask (who, ask, t) the ``most`` nearest points (who, t, tie) of others in the ``width``
    before t, by gap, who and tie, and how many there are. A key has ``own`` points at most in any such stretch."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        p = f[f["p"]].sort_values(["t", "who", "tie"], ascending=[True, False, False])
        q = f[~f["p"]]
        t, who = p["t"].to_numpy(dtype=np.int64), p["who"].to_numpy(dtype=np.int64)
        qt, key, ask = (q[c].to_numpy(dtype=np.int64) for c in ["t", "who", "ask"])
        begin, end = np.searchsorted(t, qt - width, "left"), np.searchsorted(t, qt, "left")
        # a key's own points: stretches of the points sorted by key, with positions in time below ``limit``
        by_who = np.argsort(who, kind="stable")
        tree, w = WaveletRanks(by_who), who[by_who]
        a, b = np.searchsorted(w, key, "left"), np.searchsorted(w, key, "right")
        total = end - begin - (tree.below(a, b, end) - tree.below(a, b, begin))
        at = end[:, None] - 1 - np.arange(most + own)
        other = who[np.maximum(at, 0)] if len(who) else np.zeros_like(at)
        good = (at >= begin[:, None]) & (other != key[:, None])
        rank = np.cumsum(good, axis=1)
        i, j = np.nonzero(good & (rank <= most))
        return pd.DataFrame({"key": key[i], "ask": ask[i], "rank": rank[i, j].astype(np.int32), "other": other[i, j], "gap": qt[i] - t[at[i, j]], "all": total[i]})

    rows = _bucketed(points.select("who", "t", "tie").where("who is not null and t is not null"), asks.select("who", "t", "ask").where("who is not null and t is not null"), width)
    return per_group(rows, ["bucket"], [], run, "key bigint, ask bigint, rank int, other bigint, gap bigint, all bigint")
