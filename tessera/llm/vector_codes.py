"""Vector codes: product quantisation on exact integers, whose assignments are found by exponion search.

A vector is cut into parts; a code names the nearest entry of each part's codebook. An entry that is at least as near as the
previous one, at distance d, lies within 2d of it (triangle inequality). So a search starts at the previous entry, takes that
entry's list of the others sorted by distance, and scans it while the squared distance is at most four times d²; equal
distances go to the lower index. All distances are squares of integers, so nothing is lost to rounding.

A round is one pass that returns partial sums for each part and entry, combined by Spark; only codebooks reach the driver.
Codes of earlier rounds are not stored: a task derives them again from the earlier codebooks, each search starting at the one
before it. Nothing but the input is read and nothing but the result written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, skewed_join
from .common import cut, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors that a task takes at a time.
ROWS = 50_000


def limit(width: int) -> int:
    """The largest component held; with it no error of ``width`` components leaves 64 bits."""
    return isqrt((2**63 - 1) // max(1, width)) // 2


def components(vectors: pa.Array, width: int) -> np.ndarray:
    """(rows, ``width``) integers floor(SCALE * x); shorter vectors end with zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    if not len(vectors):
        return out
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    top = limit(width)
    sizes = np.diff(vectors.offsets.to_numpy())
    rows = np.repeat(np.arange(len(vectors)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(flat, -top, top).astype(np.int64)
    return out


class Codebook:
    """The entries of one part, with every entry's list of the others sorted by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.radius = np.take_along_axis(apart, self.order, axis=1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of ``x``: the nearest entry, its squared distance; and the distances computed, all starting at ``start``."""
        first = ((x - self.entries[start]) ** 2).sum(axis=1)
        best, where, n = first.copy(), start.copy(), len(x)
        for s in np.unique(start):
            rows = np.flatnonzero(start == s)
            reach = np.searchsorted(self.radius[s], 4 * first[rows], side="right")
            turn = np.argsort(-reach, kind="stable")  # rows that reach furthest come first
            rows, reach = rows[turn], reach[turn]
            own, low, at = np.ascontiguousarray(x[rows].T), first[rows], start[rows]
            for k in range(int(reach[0])):
                e = self.order[s, k]
                if e == s:
                    continue
                m = np.searchsorted(-reach, -k, side="left")  # rows whose radius holds the list's k-th
                d = ((own[:, :m] - self.entries[e][:, None]) ** 2).sum(axis=0)
                n += m
                better = (d < low[:m]) | ((d == low[:m]) & (e < at[:m]))
                low[:m], at[:m] = np.where(better, d, low[:m]), np.where(better, e, at[:m])
            best[rows], where[rows] = low, at
        return where, best, n


def large_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows, so that a search has many rows for each entry it starts at."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def assign(x: np.ndarray, history: list[list[Codebook]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, PARTS) entries and squared distances under the last of the codebooks in ``history``."""
    step = x.shape[1] // PARTS
    codes, errors = np.zeros((len(x), PARTS), dtype=np.int64), np.zeros((len(x), PARTS), dtype=np.int64)
    for p in range(PARTS):
        for books in history:
            codes[:, p], errors[:, p], _ = books[p].search(x[:, p * step : (p + 1) * step], codes[:, p])
    return codes, errors


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector isn't null and holds neither nulls nor components that aren't finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull()).where(F.coalesce(finite, F.lit(False)))


def _next_books(kept: DataFrame, width: int, history: list[list[Codebook]]) -> list[Codebook]:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    step = width // PARTS
    count = len(history[-1][0].entries)
    cells = PARTS * count * (step + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, count, step + 1), dtype=np.int64)
        for b in large_batches(batches):
            x = components(b.column("v"), width)
            codes, _ = assign(x, history)
            for p in range(PARTS):
                np.add.at(total[p, :, :step], codes[:, p], x[:, p * step : (p + 1) * step])
                total[p, :, step] += np.bincount(codes[:, p], minlength=count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total.ravel())], names=["k", "s"])

    sums = kept.select("v").mapInArrow(run, "k bigint, s bigint").groupBy("k").agg(F.sum("s").alias("s")).collect()  # ``cells`` rows
    total = np.zeros(cells, dtype=np.int64)
    for r in sums:
        total[r["k"]] = r["s"]
    total = total.reshape(PARTS, count, step + 1)
    out = []
    for p, book in enumerate(history[-1]):
        n = total[p, :, step]
        means = total[p, :, :step] // np.maximum(n, 1)[:, None]
        out.append(Codebook(np.where(n[:, None] > 0, means, book.entries)))
    return out


def fit_codebooks(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[int, list[list[Codebook]]]:
    """The vectors' width and the codebooks of every round, the final ones last; no codebooks without usable rows."""
    kept = usable(vectors, vector).select(F.col(key).alias("i"), F.col(vector).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return 0, []
    width = -(-longest // PARTS) * PARTS
    first = kept.orderBy(F.col("i").asc_nulls_last(), "v").limit(ENTRIES).toArrow().column("v").combine_chunks()
    start, step = components(first, width), width // PARTS
    history = [[Codebook(start[:, p * step : (p + 1) * step]) for p in range(PARTS)]]
    for _ in range(ROUNDS):
        history.append(_next_books(kept, width, history))
    return width, history


def books_digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b.entries.tolist() for x in e).encode()).hexdigest()


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per usable row: vec_id, label, code (array of entries, by part), error, codebooks_sha256.

    Rows whose vector is null or holds a null or a component that isn't finite are dropped. The longest vector, filled up to
    a multiple of PARTS, gives the width; shorter ones count as filled up with zeros (of empty vectors all errors are 0).
    Repeated rows each count; null ids come last when the first entries are taken, rows of one id by their vectors. Fewer
    than ENTRIES rows give as many entries. Components beyond ``limit`` are held at it. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = usable(vectors, vector).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    schema = f"vec_id {vectors.schema[key].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, code array<int>, error bigint"
    width, history = fit_codebooks(vectors, key, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in large_batches(batches):
            codes, errors = assign(components(b.column("v"), width), history)
            flat = pa.array(codes.astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * PARTS, type=pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists, pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    coded = rows.mapInArrow(run, schema) if history else rows.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error"))
    return coded.withColumn("codebooks_sha256", F.lit(books_digest(history[-1]) if history else None).cast("string"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: errors summed over equal labels, nulls together (null if the sum leaves 64 bits)."""
    coded = cut(coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))), "op13-codes")
    sums = cut(coded.groupBy("_label").agg(F.try_sum("error").alias("label_error")), "op13-labels")
    return skewed_join(coded, sums, "_label", heavy_keys(coded, "_label")).drop("_label")


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_label_errors(encode(table(spark, sf_dir, "embeddings")))
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def oracle_sql() -> str:
    """Every part against every entry, round by round."""
    nearest = "SELECT vec_id, p, min({'d': d, 'e': e}) AS best FROM (SELECT x.vec_id, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts x JOIN c%d c USING (p)) GROUP BY vec_id, p"
    rounds = []
    for r in range(ROUNDS):
        rounds.append(f"""a{r} AS ({nearest % r}),
m{r} AS (SELECT x.p, a.best.e AS e, k, sum(x.v[k])::BIGINT AS s, count(*) AS n FROM parts x JOIN a{r} a USING (vec_id, p), LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS k) GROUP BY ALL),
c{r + 1} AS (SELECT c.p, c.e, coalesce(l.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT p, e, list((s - (((s % n) + n) % n)) // n ORDER BY k) AS v FROM m{r} GROUP BY p, e) l USING (p, e))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(p)),
c0 AS (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES}),
{", ".join(rounds)},
last AS ({nearest % ROUNDS}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha"""
