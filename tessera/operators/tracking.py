"""Tracks from detections: constant-velocity prediction, a gate that grows with the gap, optimal assignment at every instant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .greedy import assignment, per_group

FAR = 1e6


def track(df: DataFrame, keys: list[str], ident: str, time: str, at: list[str], gate: float, growth: float, max_gap: float, min_length: int, momentum: float = 0.7) -> DataFrame:
    """(keys, ident, track): detections of each key (a clip and camera) joined into tracks; ``track`` is its first detection's id.

    At each instant the tracks seen within ``max_gap`` are predicted by their smoothed velocity and matched one to one to the
    detections no farther than ``gate + growth * gap`` (nearest in sum); other detections start tracks. Tracks of fewer than
    ``min_length`` detections get null. Keys bound the state: a task streams through its keys one after another.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names = np.full(len(f), -1, dtype=np.int64)
        pos, when, ids = f[at].to_numpy(dtype=float), f[time].to_numpy(dtype=float), f[ident].to_numpy()
        where, speed, last, name = np.empty((0, len(at))), np.empty((0, len(at))), np.empty(0), np.empty(0, dtype=np.int64)
        order = np.argsort(when, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(when[order])) + 1):
            t = when[rows[0]]
            fresh = t - last <= max_gap
            if not fresh.all():
                where, speed, last, name = where[fresh], speed[fresh], last[fresh], name[fresh]
            free = np.ones(len(rows), dtype=bool)
            if len(last):
                gap = t - last
                ahead = where + speed * gap[:, None]
                d = np.sqrt(sum((ahead[:, None, k] - pos[None, rows, k]) ** 2 for k in range(len(at))))
                ok = d <= (gate + growth * gap)[:, None]
                near = np.flatnonzero(ok.any(axis=1))
                for k, j in assignment(np.where(ok[near], d[near], FAR)):
                    i = near[k]
                    if ok[i, j]:
                        p = pos[rows[j]]
                        speed[i] = momentum * speed[i] + (1 - momentum) * (p - where[i]) / max(t - last[i], 1e-9)
                        where[i], last[i], names[rows[j]], free[j] = p, t, name[i], False
            new = rows[free]
            if len(new):
                names[new] = ids[new]
                where, speed = np.concatenate([where, pos[new]]), np.concatenate([speed, np.zeros((len(new), len(at)))])
                last, name = np.append(last, np.full(len(new), t)), np.append(name, ids[new])
        _, back, count = np.unique(names, return_inverse=True, return_counts=True)
        short = count[back] < min_length
        return f[[*keys, ident]].assign(track=pd.arrays.IntegerArray(names, short))

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, ident])
    return per_group(df.select(*keys, ident, time, *at), keys, [time, ident], run, f"{fields}, track bigint")
