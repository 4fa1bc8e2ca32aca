"""Inherently ordered operators: assignment, suppression, clustering. Each runs in groups that time or keys bound."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands

#: Cells of a cost matrix up to which an assignment is made on lists.
SMALL = 400


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost one-to-one assignment of rows to columns (shortest augmenting paths)."""
    cost = np.asarray(cost, dtype=float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    if m > 2 * n:  # some optimal assignment gives every row one of its n cheapest columns
        near = np.unique(np.argpartition(cost, n - 1, axis=1)[:, :n])
        if len(near) < m:
            return [(i, int(near[j])) for i, j in assignment(cost[:, near])] if n > 1 else [(0, int(np.argmin(cost[0])))]
    if n * m <= SMALL:
        return _small_assignment(cost.tolist(), n, m)
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j, low, via, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j]:
            used[j] = True
            free = ~used
            free[0] = False
            reduced = np.full(m + 1, np.inf)
            reduced[1:] = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = free & (reduced < low)
            low[better], via[better] = reduced[better], j
            nxt = int(np.argmin(np.where(free, low, np.inf)))
            step = low[nxt]
            u[match[used]] += step
            v[used] -= step
            low[free] -= step
            j = nxt
        while j:
            match[j] = match[via[j]]
            j = via[j]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def _small_assignment(cost: list[list[float]], n: int, m: int) -> list[tuple[int, int]]:
    """The same steps on lists: in a small matrix numpy's calls take longer than the numbers."""
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j, low, via, used = i, 0, [np.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j]:
            used[j] = True
            row, own, nxt, step = cost[match[j] - 1], u[match[j]], 0, np.inf
            for c in range(1, m + 1):
                if used[c]:
                    continue
                reduced = row[c - 1] - own - v[c]
                if reduced < low[c]:
                    low[c], via[c] = reduced, j
                if low[c] < step:
                    nxt, step = c, low[c]
            for c in range(m + 1):
                if used[c]:
                    u[match[c]] += step
                    v[c] -= step
                else:
                    low[c] -= step
            j = nxt
        while j:
            match[j] = match[via[j]]
            j = via[j]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def per_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on stretches of rows that hold whole groups of ``keys`` in order, with each row's group number in the stretch.

    Groups are small and many: what is done for all rows of a stretch at once costs a fraction of a call for every group.
    The number of tasks is fixed: chosen by size alone, a few tasks would get all the groups, which are small but slow.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            before = f[keys].shift()
            new = ((f[keys] != before) & ~(f[keys].isna() & before.isna())).any(axis=1).to_numpy()  # nulls are one key
            new[0] = True
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield fn(f.iloc[:last], np.cumsum(new[:last]) - 1)
            held = f.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield fn(held, np.zeros(len(held), dtype=np.int64))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def per_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on every group of ``keys``; many small groups share a task and are streamed through it in order."""

    def each(f: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        at = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(f))
        return pd.concat([fn(f.iloc[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], ignore_index=True)

    return per_groups(df, keys, order, each, schema)


def match_events(left: DataFrame, right: DataFrame, keys: list[str], ident: str, time: str, tolerance: int) -> DataFrame:
    """One-to-one pairs of two event tables within ``tolerance``: as many as possible, then the closest.

    Events of a key are first cut into stretches that no pair can span, so a task sees one stretch and not a whole key.
    """
    both = left.select(*keys, F.col(ident).alias("id"), F.col(time).alias("t"), F.lit(0).alias("side")).unionByName(right.select(*keys, F.col(ident).alias("id"), F.col(time).alias("t"), F.lit(1).alias("side")))
    cut = islands(both.withColumn("t2", F.col("t")), keys, "t", "t2", tolerance, ["side", "id"])
    whole = Window.partitionBy(*keys, "island")
    cut = cut.withColumn("lo", F.min("side").over(whole)).withColumn("hi", F.max("side").over(whole)).where("lo < hi")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["t", "id"])
        a, b = f[f["side"] == 0], f[f["side"] == 1]
        d = np.abs(a["t"].to_numpy()[:, None] - b["t"].to_numpy()[None, :]).astype(float)
        far = 1e6 * max(1, tolerance)  # out-of-tolerance pairs cost more than any number of good ones
        pairs = [(i, j) for i, j in assignment(np.where(d <= tolerance, d, far)) if d[i, j] <= tolerance]
        return pd.DataFrame({"left_id": [a["id"].iloc[i] for i, _ in pairs], "right_id": [b["id"].iloc[j] for _, j in pairs], "distance": [int(d[i, j]) for i, j in pairs]})

    return per_group(cut.select(*keys, "island", "id", "t", "side"), [*keys, "island"], ["t", "id"], run, "left_id bigint, right_id bigint, distance bigint")


def suppress(df: DataFrame, keys: list[str], ident: str, time: str, score: str, spacing: int) -> DataFrame:
    """Greedy non-maximum suppression: the best score stays, others less than ``spacing`` from a kept one go."""
    cut = islands(df.select(*keys, ident, time, score).withColumn("_t2", F.col(time)), keys, time, "_t2", spacing, [ident])

    def run(f: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        f = f.assign(_group=group).sort_values(["_group", score, time, ident], ascending=[True, False, True, True])
        kept: list[int] = []  # of one group, in order of time: only the two around a moment can be too near
        keep, at = [], -1
        for g, t in zip(f["_group"].tolist(), f[time].tolist(), strict=True):
            if g != at:
                kept, at = [], g
            k = bisect_left(kept, t)
            ok = (k == 0 or t - kept[k - 1] >= spacing) and (k == len(kept) or kept[k] - t >= spacing)
            keep.append(ok)
            if ok:
                kept.insert(k, t)
        return f.loc[keep, [*keys, ident, time, score]]

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, ident, time, score])
    return per_groups(cut.select(*keys, "island", ident, time, score), [*keys, "island"], [time, ident], run, fields)


def online_people(df: DataFrame, keys: list[str], ident: str, vector: str, gate: float, nearest: int = 3) -> DataFrame:
    """Online clustering in id order: a vector joins the person whose ``nearest`` closest members are on average within ``gate``, else starts one."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(ident)
        people: list[list[np.ndarray]] = []
        out = []
        for v in f[vector]:
            v = np.asarray(v, dtype=float)
            v = v / (np.linalg.norm(v) or 1.0)
            d = [float(np.mean(np.sort(1 - np.stack(p) @ v)[:nearest])) for p in people]
            best = int(np.argmin(d)) if d else -1
            if d and d[best] < gate:
                people[best].append(v)
            else:
                people.append([v])
                best = len(people) - 1
            out.append(best)
        return f[keys].assign(**{ident: f[ident], "person": out})

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, ident])
    return df.select(*keys, ident, vector).groupBy(*keys).applyInPandas(run, f"{fields}, person int")


def cannot_link_clusters(df: DataFrame, keys: list[str], ident: str, vector: str, veto: str, gate: float, average: bool = False) -> DataFrame:
    """Agglomeration inside each key: cheapest pairs first up to ``gate``; two members with equal ``veto`` never share a cluster.

    ``average`` recomputes mean distances after each merge (average linkage); else pairs are taken in order of their own distance.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(ident).reset_index(drop=True)
        x = np.stack([np.asarray(v, dtype=float) for v in f[vector]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d, label, tags = 1 - x @ x.T, np.arange(len(f)), [{t} for t in f[veto]]
        if average:
            groups = {i: [i] for i in range(len(f))}
            while True:
                options = [(d[np.ix_(a, b)].mean(), i, j) for i, a in groups.items() for j, b in groups.items() if i < j and not tags[i] & tags[j]]
                best = min(options, default=None)
                if best is None or best[0] > gate:
                    break
                _, i, j = best
                groups[i] += groups.pop(j)
                tags[i] |= tags[j]
            for i, members in groups.items():
                label[members] = i
        else:
            i, j = np.triu_indices(len(f), 1)
            near = d[i, j] <= gate
            for _, a, b in sorted(zip(d[i, j][near], i[near], j[near], strict=True)):
                p, q = sorted((label[a], label[b]))
                if p != q and not tags[p] & tags[q]:
                    label[label == q] = p
                    tags[p] |= tags[q]
        return f[keys].assign(**{ident: f[ident], "cluster": f[ident].to_numpy()[label]})

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, ident])
    return df.select(*keys, ident, vector, veto).groupBy(*keys).applyInPandas(run, f"{fields}, cluster bigint")
