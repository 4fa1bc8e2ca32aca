"""Boxes and bit-packed masks: candidates by a grid, overlap by bits, first-comes-first-kept suppression, one-to-one assignment.

A mask is the ``binary`` of its box's pixels row by row, eight to a byte, the first in the highest bit. Boxes are whole pixels,
x1 and y1 not included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .greedy import assignment, per_group, per_groups
from .scratch import cut

BOX = ("x0", "y0", "x1", "y1")
#: ``keep_first``: rounds of joins at least; after them a rest of at most TAIL conflicts ends in one task.
ROUNDS, TAIL = 3, 20_000
#: Pairs of masks laid out at a time.
PAIRS = 2048


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask.astype(bool).ravel()).tobytes()


def unpack(data: bytes, width: int, height: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=width * height).reshape(height, width)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Pairs of boxes of equal ``keys`` with a common pixel; the right side's other columns must have names of their own and its box x0r, y0r, x1r, y1r.

    Both sides are dealt to the grid cells that they touch; a pair is emitted in the cell of its common part's corner alone, so a
    key with many boxes is spread over its cells.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    deal = lambda df, s: df.where(f"x0{s} < x1{s} and y0{s} < y1{s}").withColumn("_cx", F.explode(span(f"x0{s}", f"x1{s}"))).withColumn("_cy", F.explode(span(f"y0{s}", f"y1{s}")))
    met = deal(left, "").join(deal(right, "r"), [*keys, "_cx", "_cy"])
    corner = (F.floor(F.greatest("x0", "x0r") / cell) == F.col("_cx")) & (F.floor(F.greatest("y0", "y0r") / cell) == F.col("_cy"))
    return met.where(corner & F.expr("x0 < x1r and x0r < x1 and y0 < y1r and y0r < y1")).drop("_cx", "_cy")


def other(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` as the right side of ``overlapping``: all columns but ``keys`` with an r behind their names."""
    return df.select(*keys, *[F.col(c).alias(f"{c}r") for c in df.columns if c not in keys])


def common_area() -> Column:
    """Pixels in both boxes of a pair."""
    return (F.least("x1", "x1r") - F.greatest("x0", "x0r")) * (F.least("y1", "y1r") - F.greatest("y0", "y0r"))


def box_iou() -> Column:
    area = lambda s: (F.col(f"x1{s}") - F.col(f"x0{s}")) * (F.col(f"y1{s}") - F.col(f"y0{s}"))
    return common_area() / (area("") + area("r") - common_area())


def mask_overlap(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``, inter, area, arear): pixels in both masks and in each, for pairs of boxes with ``mask`` and ``maskr``. Null masks are empty."""

    def bits(data: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All masks' bits in one row, ``n`` of each and up to a whole byte, and where each begins."""
        size = -(-n // 8)
        held = [(x or b"")[:k].ljust(k, b"\0") for x, k in zip(data.to_pylist(), size.tolist(), strict=True)]
        return np.unpackbits(np.frombuffer(b"".join(held), dtype=np.uint8)), 8 * (np.cumsum(size) - size)

    def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        end = np.cumsum(n)
        return total[end] - total[end - n]

    def stretch(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` numbers from each ``begin``."""
        return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (b.slice(at, PAIRS) for b in batches for at in range(0, b.num_rows, PAIRS))
        for b in whole:
            ax, ay, bx, by, cx, cy, dx, dy = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*BOX, *[f"{c}r" for c in BOX]))
            x, y, w, h = np.maximum(ax, cx), np.maximum(ay, cy), np.minimum(bx, dx) - np.maximum(ax, cx), np.minimum(by, dy) - np.maximum(ay, cy)
            row = stretch(np.zeros(len(h), np.int64), h)  # of the common part
            seen, areas = [], []
            for mask, left, top, right, bottom in (("mask", ax, ay, bx, by), ("maskr", cx, cy, dx, dy)):
                n = (right - left) * (bottom - top)
                flat, begin = bits(b.column(mask), n)
                areas.append(sums(flat[stretch(begin, n)], n))
                first = np.repeat(begin + (y - top) * (right - left) + x - left, h) + row * np.repeat(right - left, h)
                seen.append(flat[stretch(first, np.repeat(w, h))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, [sums(seen[0] & seen[1], w * h), *areas])], names=[*keep, "inter", "area", "arear"])

    fields = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)
    ints = [F.col(f"{c}{s}").cast("int").alias(f"{c}{s}") for s in ("", "r") for c in BOX]
    return pairs.select(*keep, *ints, "mask", "maskr").mapInArrow(run, f"{fields}, inter bigint, area bigint, arear bigint")


def keep_first(conflicts: DataFrame) -> DataFrame:
    """(node) of those that go if nodes are taken in order and each stays that conflicts with no earlier one that stayed.

    ``conflicts``: (early, late), the earlier node first. A round keeps the nodes that no live conflict makes late, and drops
    whatever conflicts with them. In the worst case, a chain, a round settles two nodes, so a small rest ends in one task.
    """
    live, gone, k = cut(conflicts.select("early", "late").where("early <> late").distinct(), "keep-live"), [], 0
    while (left := live.count()) and (k < ROUNDS or left > TAIL):
        k += 1
        stay = live.join(live.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        drop = cut(stay.select(F.col("late").alias("node")).distinct(), "keep-gone")
        gone.append(drop)
        for side in ("early", "late"):
            live = live.join(drop.select(F.col("node").alias(side)), side, "left_anti")
        live = cut(live.select("early", "late"), "keep-live")

    def rest(f: pd.DataFrame) -> pd.DataFrame:
        before: dict = {}
        for a, b in zip(f["early"], f["late"], strict=True):
            before.setdefault(a, [])
            before.setdefault(b, []).append(a)
        state: dict = {}
        stack = list(before)
        while stack:  # a node is settled once all before it are
            x = stack[-1]
            open_ = [p for p in before[x] if p not in state]
            if x in state or not open_:
                stack.pop()
                state.setdefault(x, not any(state[p] for p in before[x]))
            else:
                stack += open_
        return pd.DataFrame({"node": [x for x, kept in state.items() if not kept]})

    kind = live.schema["late"].dataType.simpleString()
    if left:
        gone.append(per_group(live.withColumn("one", F.lit(0)), ["one"], ["early", "late"], rest, f"node {kind}"))
    return reduce(DataFrame.unionByName, gone, live.select(F.col("late").alias("node")).where("false"))


def assign_pairs(pairs: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """(``keys``, a, b, ``weight``) of the one-to-one pairs of every key with the largest sum of weights.

    Only pairs with a weight above zero are given; a key's pairs fall into connected parts, each of which is solved on its own.
    So no matrix is larger than a part, and a key with few overlaps costs what its overlaps do.
    """

    def coded(group: np.ndarray, ends: pd.Series) -> np.ndarray:
        own, kinds = pd.factorize(ends, sort=True)
        return np.unique(group * (len(kinds) + 1) + own, return_inverse=True)[1]

    def run(f: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        w, i, j = f[weight].to_numpy(dtype=float), coded(group, f["a"]), coded(group, f["b"])
        left = i.max() + 1
        label = np.arange(left + j.max() + 1)
        while True:  # smallest label of either end
            low = label.copy()
            np.minimum.at(low, i, label[left + j])
            np.minimum.at(low, left + j, label[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
        order = np.argsort(label[i], kind="stable")
        begin = np.flatnonzero(np.diff(label[i][order], prepend=-1))
        end = np.append(begin[1:], len(order))
        keep = order[begin[end - begin == 1]].tolist()
        for x, y in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
            own = order[x:y]
            ri, ci = i[own].tolist(), j[own].tolist()
            r, c = ({k: at for at, k in enumerate(sorted(set(side)))} for side in (ri, ci))
            gain, at = [[-0.0] * len(c) for _ in r], {}
            for k, p, q, g in zip(own.tolist(), ri, ci, w[own].tolist(), strict=True):
                gain[r[p]][c[q]], at[r[p], c[q]] = -g, k
            keep += [at[pair] for pair in assignment(gain) if pair in at]
        return f.iloc[sorted(keep)][[*keys, "a", "b", weight]]

    rows = pairs.select(*keys, "a", "b", F.col(weight).cast("double").alias(weight)).where(F.col(weight) > 0)
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "a", "b", weight])
    return per_groups(rows, keys, ["a", "b"], run, fields)


def transfer_labels(detections: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.5, cell: int = 64) -> DataFrame:
    """(``keys``, det, label, iou): labels carried from ``truth`` (``keys``, truth, label, box) to ``detections`` (``keys``, det, box).

    Boxes of one key are assigned one to one by the largest sum of overlaps; of those, overlaps above ``least`` count. A null label carries nothing.
    """
    met = overlapping(detections.select(*keys, F.col("det").alias("a"), *BOX), other(truth.where("label is not null").select(*keys, "truth", "label", *BOX), keys), keys, cell)
    pairs = cut(met.select(*keys, "a", F.col("truthr").alias("b"), F.col("labelr").alias("label"), box_iou().alias("weight")), "transfer-pairs")
    best = assign_pairs(pairs, keys).where(F.col("weight") > least)
    return best.join(pairs.select(*keys, "a", "b", "label"), [*keys, "a", "b"]).select(*keys, F.col("a").alias("det"), "label", F.col("weight").alias("iou"))


def link_chunks(rows: DataFrame, keys: list[str], least: float = 0.3, cell: int = 64) -> tuple[DataFrame, DataFrame]:
    """Pieces through overlapping chunks: (``keys``, chunk, local, piece) and the rows that stay, (``keys``, chunk, frame, local, piece).

    ``rows``: (``keys``, chunk, frame, local, box, mask), chunk a number, local an id within a chunk. Two local ids of neighbouring
    chunks have the mean of their masks' IoU over the frames that show both; the one-to-one links with the largest sum, of at
    least ``least`` each, join pieces, named by the smallest "chunk:local". Of a frame that two chunks show the earlier one's rows stay.
    """
    # what a frame's chunks are is told once: only rows of frames that a neighbouring chunk shows, too, are compared
    chunks = F.collect_set("chunk").over(Window.partitionBy(*keys, "frame"))
    rows = rows.select(*keys, "chunk", "frame", "local", *BOX, "mask", chunks.alias("_chunks"))
    on = [F.expr(f"coalesce(array_contains(_chunks, chunk {step} 1), false)").alias(name) for step, name in (("+", "_later"), ("-", "_earlier"))]
    rows = cut(rows.select(*rows.columns, *on, (F.array_min("_chunks") == F.col("chunk")).alias("_first")).drop("_chunks"), "chunk-rows")
    plain = rows.columns[:-3]
    early = rows.where("_later").select(*plain)
    nxt = other(rows.where("_earlier").select(*plain), [*keys, "frame"]).withColumn("chunk", F.col("chunkr") - 1)
    seen = early.select(*keys, "chunk", "frame", "local").join(nxt.select(*keys, "chunk", "frame", "localr"), [*keys, "chunk", "frame"]).groupBy(*keys, "chunk", "local", "localr").agg(F.count("*").alias("n"))
    met = mask_overlap(overlapping(early, nxt, [*keys, "chunk", "frame"], cell), [*keys, "chunk", "local", "localr"])
    total = met.where("inter > 0").groupBy(*keys, "chunk", "local", "localr").agg(F.sum(F.col("inter") / (F.col("area") + F.col("arear") - F.col("inter"))).alias("s"))
    mean = total.join(seen, [*keys, "chunk", "local", "localr"]).select(*keys, "chunk", F.col("local").alias("a"), F.col("localr").alias("b"), (F.col("s") / F.col("n")).alias("weight"))
    links = cut(assign_pairs(mean, [*keys, "chunk"]).where(F.col("weight") >= least), "chunk-links")
    name = lambda chunk, local: F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.concat(F.lpad(chunk.cast("string"), 12, "0"), F.lit(":"), local.cast("string")))
    roots = components(links.select(name(F.col("chunk"), F.col("a")).alias("a"), name(F.col("chunk") + 1, F.col("b")).alias("b"))).withColumnRenamed("node", "_name")
    ids = rows.select(*keys, "chunk", "local").distinct().withColumn("_name", name(F.col("chunk"), F.col("local")))
    pieces = cut(ids.join(roots, "_name", "left").select(*keys, "chunk", "local", F.coalesce("root", "_name").alias("piece")), "chunk-pieces")
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in [*keys, "frame"]])
    owned = rows.where(F.col("_first") & known).select(*keys, "chunk", "frame", "local").join(pieces, [*keys, "chunk", "local"]).select(*keys, "chunk", "frame", "local", "piece")
    return pieces, owned
