"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

cos(Wx + b) with normal W approximates a Gaussian kernel on standardised statistics. Every partition sums its share of the
normal equations; Spark adds them up, and only the (FEATURES + 1)^2 sums reach the driver. Ridge scores of a part of the
learning rows that the fit didn't see are counted in fixed bins and made monotone by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .text_stats import NAMES, text_stats

FEATURES = 128
RIDGE = 1e-3
WIDTH = 3.0
BINS = 1024
SEED = 11


def stats_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``x``, the statistics of every whole text (null: zeros)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = [text_stats(t) for t in b.column("text").to_pylist()]
            flat = pa.array(np.concatenate(x) if x else np.empty(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), type=pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, "x"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{fields}, x array<double>")


class Fourier:
    """Standardise, then FEATURES random cosines and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].to_numpy()) if len(frame) else np.empty((0, len(NAMES)))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every statistic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(len(NAMES)), np.zeros(len(NAMES))
        for f in frames:
            x = _matrix(f)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pd.DataFrame({"k": np.arange(len(NAMES)), "n": n, "s": s, "q": q})

    sums = rows.select("x").mapInPandas(run, "k int, n bigint, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").toPandas()
    n = np.maximum(sums["n"].to_numpy(), 1)
    mean = sums["s"].to_numpy() / n
    return mean, np.sqrt(np.maximum(sums["q"].to_numpy() / n - mean**2, 1e-6))


def fit_ridge(rows: DataFrame, fourier: Fourier) -> np.ndarray:
    """Weights from the normal equations of rows (x, y)."""
    d = FEATURES + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d + 1))
        for f in frames:
            if len(f):
                z = fourier(_matrix(f))
                total += z.T @ np.hstack([z, f[["y"]].to_numpy()])
        i, j = np.divmod(np.arange(d * (d + 1)), d + 1)
        yield pd.DataFrame({"i": i, "j": j, "v": total.ravel()})

    sums = rows.select("x", "y").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((d, d + 1))
    total[sums["i"], sums["j"]] = sums["v"]
    n = max(total[d - 1, d - 1], 1.0)
    return np.linalg.solve(total[:, :d] / n + RIDGE * np.eye(d), total[:, d] / n)


def pool_adjacent_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to y in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([float(value), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)  # raw scores lie about 0 to 1


def fit_calibration(rows: DataFrame, fourier: Fourier, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and their calibrated probabilities, from rows (x, y)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(BINS), np.zeros(BINS)
        for f in frames:
            if len(f):
                k = _bin(fourier(_matrix(f)) @ weights)
                n += np.bincount(k, minlength=BINS)
                s += np.bincount(k, weights=f["y"].to_numpy(), minlength=BINS)
        on = np.flatnonzero(n)
        yield pd.DataFrame({"k": on, "n": n[on], "s": s[on]})

    sums = rows.select("x", "y").mapInPandas(run, "k int, n double, s double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").toPandas()
    rate = (sums["s"] + 0.5 * 1e-6) / (sums["n"] + 1e-6)
    return sums["k"].to_numpy(), pool_adjacent_violators(rate.to_numpy(), sums["n"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted.

    Labels of rows whose crc32(doc_id) mod 4 is 2 are never read; of the others, remainders 0 and 1 fit the ridge and 3 the
    calibration. Null labels are ignored, several labels of a document are averaged, a null doc_id has no label and isn't
    held out. Without learning rows every score is 0.5. Null and empty texts are scored from zero statistics.
    """
    spark = docs.sparkSession
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    stats = cut(stats_of(docs, ["doc_id"]), "op2-stats")
    known = labels.where("quality is not null and doc_id is not null").where(part != 2).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = cut(stats.join(known, "doc_id").select("x", "y", part.alias("part")), "op2-rows")
    fit_rows, spare = rows.where("part <> 3"), rows.where("part = 3")
    model = None
    if not fit_rows.isEmpty():
        fourier = Fourier(*moments(fit_rows))
        weights = fit_ridge(fit_rows, fourier)
        model = fourier, weights, *fit_calibration(spare if not spare.isEmpty() else fit_rows, fourier, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            if model is None or not b.num_rows:
                score = np.full(b.num_rows, 0.5)
            else:
                fourier, weights, at, value = model
                x = b.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
                score = np.clip(np.interp(_bin(fourier(x) @ weights), at, value), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
