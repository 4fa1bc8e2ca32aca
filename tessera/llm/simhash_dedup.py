"""SimHash near-duplicates found with pivot distance tables.

Fingerprints are 64-bit SimHashes of 3-word shingles. ``REFERENCES`` of the data's own fingerprints serve as pivots. Every
fingerprint's Hamming distances to all of them are precomputed, over the whole width and restricted to one of six bit
blocks. By the triangle inequality no coordinate of two fingerprints at distance d differs by more than d. Three differing
bits touch at most three blocks, so in at least three of the six blocks all restricted distances of a pair are equal: the
pair meets in one of twenty tables keyed by the restricted distances of three blocks. (Distances over the whole width all
lie near 32: as keys they would leave most pairs together. Those of two of five blocks left 256,000 cells of a table's
fingerprints: strangers met in most of them.) Pairs that meet are discarded when the largest difference of their
whole-width coordinates exceeds 3, and the survivors are verified bit by bit.

A table cell is never expanded into all its pairs: every member is compared with the cell's leader, then only members
still in different groups are compared, in pairs of chunks of about ``CHUNK``; a spanning forest of the links leaves a task.

The pipeline stage has another threshold: Jaccard similarity 0.8 of the sets of 5-word shingles. It takes the SimHashes of
those sets and links them by the same pivot tables first. At the threshold two 64-bit SimHashes differ in about 10 bits and
in up to 20, where no bit blocks are left to meet by: what the fingerprints can't reach meets in bands of shingle minima.
Every candidate of either kind is verified by the exact similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_of, cut, row_key, small_batches, table
from ..operators.graph import components
from ..operators.skew import heavy_keys, skewed_join

BITS = 64
BLOCKS = (11, 11, 11, 11, 10, 10)
MAX_DISTANCE = 3
#: Blocks that a pair within MAX_DISTANCE agrees in at least.
AGREE = len(BLOCKS) - MAX_DISTANCE
#: Fingerprints that serve as pivots, drawn by hash from the data; each block uses its own BLOCK_PIVOTS of them.
REFERENCES = 32
BLOCK_PIVOTS = 5
CHUNK = 512
#: The pipeline stage: two texts are near copies if their sets of STAGE_WORDS-word shingles have this Jaccard similarity.
STAGE_WORDS = 5
STAGE_SIMILARITY = 0.8
#: A pair at the threshold has no band in common with a probability of (1 - 0.8^4)^27 < 1e-6.
BANDS, BAND_ROWS = 27, 4
#: Bits of a set's parities: each says whether an odd number of the set's shingles fall into its part of the hashes.
PARITIES = 1024
#: Sets whose texts must be fetched, up to which their keys are broadcast (about 100 bytes each); beyond, the texts shuffle.
BROADCAST_ROWS = 300_000
_SLICE = 65536
_RADIX = np.uint64(max(BLOCKS) + 1)


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """SimHash of one text; 0 for null or without words. A bit is set if it is set in over half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(norm, 42)], dtype=np.uint64)
        n, counts = 1, np.unpackbits(hashes.view(np.uint8), bitorder="little").astype(np.int64)
        return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    digest = xxhash.xxh64_intdigest
    n, counts = len(words) - shingle_words + 1, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _SLICE):
        s, e = starts[at : min(n, at + _SLICE)].tolist(), ends[at + shingle_words - 1 : min(n, at + _SLICE) + shingle_words - 1].tolist()
        hashes = np.array([digest(norm[i:j], 42) for i, j in zip(s, e, strict=True)], dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``fp`` (a signed long with the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            cols = [b.column(c) for c in keep] + [pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "fp"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, fp bigint")


def _masks() -> list[int]:
    out, at = [], 0
    for w in BLOCKS:
        out.append(((1 << w) - 1) << at)
        at += w
    return out


def references(distinct_fp: DataFrame) -> np.ndarray:
    """REFERENCES fingerprints of ``distinct_fp`` (fp) as uint64, the first by hash; filled up from a fixed seed where there are fewer."""
    drawn = [r["fp"] for r in distinct_fp.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(REFERENCES).collect()]  # bounded
    rest = np.random.default_rng(7).integers(0, 2**64, size=REFERENCES - len(drawn), dtype=np.uint64)
    return np.concatenate([np.array(drawn, dtype=np.int64).view(np.uint64), rest])


def block_coordinates(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For uint64 fingerprints a number for each block: its BLOCK_PIVOTS restricted distances as digits."""
    coords = np.zeros((len(fp), len(BLOCKS)), dtype=np.uint64)
    for k, mask in enumerate(_masks()):
        for j in range(BLOCK_PIVOTS):
            d = np.bitwise_count((fp ^ pivots[k * BLOCK_PIVOTS + j]) & np.uint64(mask)).astype(np.uint64)
            coords[:, k] = coords[:, k] * _RADIX + d
    return coords


def wide_coordinates(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The whole-width distance of each fingerprint to each pivot, (fingerprints, pivots)."""
    return np.stack([np.bitwise_count(fp ^ p) for p in pivots], axis=1).astype(np.int8)


def _cells(pivots: np.ndarray):
    """One row for each fingerprint and table: ``cell`` is the table's number and the coordinates of its AGREE blocks."""
    width = _RADIX ** np.uint64(BLOCK_PIVOTS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64).view(np.uint64)
            coords = block_coordinates(fp, pivots)
            for t, blocks in enumerate(combinations(range(len(BLOCKS)), AGREE)):
                cell = np.full(len(fp), t, dtype=np.uint64)
                for k in blocks:
                    cell = cell * width + coords[:, k]
                yield pd.DataFrame({"cell": cell.view(np.int64), "fp": fp.view(np.int64)})

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable row for each of n rows, given links i-j."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]  # roots: only these are hooked, so that a new label carries its whole tree
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        live = label[i] != label[j]
        i, j = i[live], j[live]
    return label


def link_sorted_cells(pivots: np.ndarray):
    """From rows sorted by (cell, x, y): links ``(a, b)`` that span the components inside every chunk pair."""

    def done(f: pd.DataFrame) -> pd.DataFrame:
        cell, x, y = (f[c].to_numpy() for c in ("cell", "x", "y"))
        fp = f["fp"].to_numpy(np.int64).view(np.uint64)
        new = np.ones(len(f), dtype=bool)
        new[1:] = (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        start = np.flatnonzero(new)
        last = np.repeat(np.append(start[1:], len(f)), np.diff(np.append(start, len(f))))
        far = wide_coordinates(fp, pivots)
        idx, lag, left, right = np.arange(len(f)), 0, [], []
        while True:
            lag += 1
            idx = idx[idx + lag < last[idx]]
            if not len(idx):
                break
            near = idx
            for k in range(0, far.shape[1], 8):  # most pairs go by the first few pivots
                near = near[np.abs(far[near, k : k + 8] - far[near + lag, k : k + 8]).max(axis=1) <= MAX_DISTANCE]
            hit = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= MAX_DISTANCE]
            left.append(hit)
            right.append(hit + lag)
        empty = np.empty(0, dtype=np.int64)
        root = _forest(len(f), np.concatenate(left) if left else empty, np.concatenate(right) if right else empty)
        moved = np.flatnonzero(root != np.arange(len(f)))
        return pd.DataFrame({"a": fp[root[moved]].view(np.int64), "b": fp[moved].view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            tail = (f["cell"] == f["cell"].iloc[-1]) & (f["x"] == f["x"].iloc[-1]) & (f["y"] == f["y"].iloc[-1]) if len(f) else None
            if tail is None:
                continue
            held, ready = f[tail].reset_index(drop=True), f[~tail].reset_index(drop=True)
            if len(ready):
                yield done(ready)
        if held is not None and len(held):
            yield done(held)

    return run


def near_roots(distinct_fp: DataFrame) -> DataFrame:
    """(node, root) for the fingerprints of ``distinct_fp`` (fp, each once) that are linked to others at distance <= 3."""
    pivots = references(distinct_fp)
    cells = cut(distinct_fp.select("fp").mapInPandas(_cells(pivots), "cell bigint, fp bigint"), "op1-cells")
    heavy = heavy_keys(cells, "cell")
    full = cells.groupBy("cell").agg(F.count("*").alias("size"), F.min("fp").alias("lead")).where("size > 1")
    met = cut(skewed_join(cells, full, "cell", heavy), "op1-met")
    star = met.where((F.col("fp") != F.col("lead")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= MAX_DISTANCE)).select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct()
    star = cut(star, "op1-star")
    joined = components(star)
    crowd = met.where("size > 2").join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("cell", "fp", F.coalesce("root", "fp").alias("root"))
    crowd = cut(crowd, "op1-crowd")
    mixed = crowd.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / CHUNK).cast("int").alias("n")).where("low <> high").select("cell", "n")
    dealt = (
        skewed_join(crowd.select("cell", "fp"), cut(mixed, "op1-mixed"), "cell", heavy)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )
    more = cut(dealt.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "fp").mapInPandas(link_sorted_cells(pivots), "a bigint, b bigint").distinct(), "op1-more")
    return joined if more.isEmpty() else components(star.union(more))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text`` that are asked for by the query: doc_id, fingerprint, component_id.

    Documents whose fingerprints differ in 3 or fewer bits are linked; ``component_id`` is the smallest doc_id reachable.
    Null and empty texts have fingerprint 0 and are linked like any other; null doc_ids are returned but never a
    component_id (a group of only such rows gets null). Repeated rows stay repeated. Extra columns are ignored.
    """
    return _grouped(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, keep: list[str]) -> DataFrame:
    fps = cut(fingerprints(docs, keep), "op1-fps")
    distinct_fp = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "op1-distinct")
    known = distinct_fp.join(near_roots(distinct_fp).select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = cut(known, "op1-known")
    lows = cut(known.groupBy("root").agg(F.min("low").alias("component_id")), "op1-lows")
    known = skewed_join(known.select("fp", "root"), lows, "root", heavy_keys(known, "root"))
    return skewed_join(fps, cut(known, "op1-rooted"), "fp", heavy_keys(fps, "fp"))


def shingles(text: str | None, width: int = STAGE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one for all words if there are no more than ``width``, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    norm, digest = b" ".join(words), xxhash.xxh64_intdigest
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    n, width = max(1, len(words) - width + 1), min(width, len(words))
    s, e = (ends - lens)[:n].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.fromiter((digest(norm[i:j], 42) for i, j in zip(s, e, strict=True)), dtype=np.uint64, count=n))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a shingle set as a signed number, 0 if it is empty."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        counts += np.unpackbits(hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _bands(hashes: np.ndarray) -> np.ndarray:
    """For sorted shingle hashes, BANDS keys of BAND_ROWS minima each."""
    mul = np.random.default_rng(13).integers(0, 2**63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(len(mul), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[at : at + 4096, None] * mul).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in low.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits of a set of shingle hashes in signed longs. A shingle that only one of two sets holds turns one bit: sets
    whose bits differ in d places differ in d shingles or more."""
    odd = np.bincount((hashes >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, row, set, n, fp, odd, bands): a 128-bit hash of each text's shingle set, its size, SimHash, parities and band keys; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            ids = [xxhash.xxh3_128_hexdigest(x.tobytes(), 42) for x in sets]
            bands = pa.array([_bands(x) if len(x) else [] for x in sets], type=pa.list_(pa.int64()))
            fps = pa.array([set_fingerprint(x) for x in sets], type=pa.int64())
            odd = pa.array([parities(x) for x in sets], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(ids), pa.array([len(x) for x in sets], type=pa.int64()), fps, odd, bands], names=["doc_id", "row", "set", "n", "fp", "odd", "bands"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row string, set string, n bigint, fp bigint, odd array<bigint>, bands array<bigint>")


def _shingle_arrays(texts: DataFrame) -> DataFrame:
    """(set, sh): the shingle hashes themselves, for ``texts`` (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sh = pa.array([shingles(t).view(np.int64) for t in b.column("text").to_pylist()], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("set"), sh], names=["set", "sh"])

    return texts.select("set", "text").mapInArrow(run, "set bigint, sh array<bigint>")


def _alike(a: str, b: str) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(a, b) >= F.lit(STAGE_SIMILARITY) * F.greatest(a, b) - 1e-9


def _may_be_alike(a: str, b: str, odd_a: str, odd_b: str) -> Column:
    """Whether sizes and parities of two sets allow the similarity: sets at J differ in (1 - J) / (1 + J) of both sizes' sum."""
    differ = " + ".join(f"bit_count(get({odd_a}, {k}) ^ get({odd_b}, {k}))" for k in range(PARITIES // 64))
    return _alike(a, b) & (F.expr(differ) <= (F.col(a) + F.col(b)) * ((1 - STAGE_SIMILARITY) / (1 + STAGE_SIMILARITY)) + 1e-6)


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is high enough."""
    side = lambda c: arrays.select(F.col("set").alias(c), F.col("sh").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("k", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("k") >= F.lit(STAGE_SIMILARITY) * (F.size("sa") + F.size("sb") - F.col("k")) - 1e-9).select("a", "b")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): every set of ``sets`` (set, n, n_copies, fp) with the most frequent one of those that its SimHash is linked to by 3 bits."""
    fps = cut(sets.where("n > 0").select("fp").distinct(), "near-fps")
    linked = cut(fps.join(near_roots(fps).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group")), "near-fp-roots")
    grouped = cut(skewed_join(sets.where("n > 0").select("set", "n", "n_copies", "fp"), linked, "fp", heavy_keys(sets, "fp")), "near-fp-sets")
    lead = grouped.groupBy("group").agg(F.max(F.struct("n_copies", "set", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1")
    lead = cut(lead.select("group", F.col("lead.set").alias("lead"), F.col("lead.n").alias("lead_n")), "near-fp-leads")
    met = skewed_join(grouped.select("group", "set", "n"), lead, "group", heavy_keys(grouped, "group"))
    return met.where((F.col("set") != F.col("lead")) & _alike("n", "lead_n")).select(F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row, root) for every row of ``docs`` (doc_id, row, text); near copies, also by way of others, share a root.

    Sets linked by their SimHashes are compared with one of them. Those that share a band's cell are compared with the cell's
    leader: the member that meets most others in all its cells, so that a text's variants, which are less like each other than
    like it, are joined by way of it. Then only members still in different groups are compared with each other, in pairs of
    chunks. Texts without words are copies of each other.
    """
    sets = cut(shingle_sets(docs), "near-sets")
    numbered = sets.groupBy("set").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("odd").alias("odd"), F.first("bands").alias("bands"), F.count("*").alias("n_copies"))
    numbered = cut(numbered.withColumnRenamed("set", "key").withColumn("set", F.monotonically_increasing_id()), "near-distinct")
    distinct = numbered.drop("key")
    cells = distinct.select(F.explode("bands").alias("cell"), "set", "n", "n_copies")
    heavy = heavy_keys(cells, "cell")
    full = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    met = cut(skewed_join(cells, full, "cell", heavy), "near-met")
    busy = met.groupBy("set").agg(F.sum("size").alias("others"))
    lead = met.join(busy, "set").groupBy("cell").agg(F.max(F.struct("others", "n_copies", "set", "n")).alias("lead"))
    met = skewed_join(met, cut(lead.select("cell", F.col("lead.set").alias("lead"), F.col("lead.n").alias("lead_n")), "near-lead"), "cell", heavy)
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    by_bits = cut(fingerprint_pairs(distinct), "near-by-bits")
    star = cut(by_bits.union(met.where((F.col("set") != F.col("lead")) & _alike("n", "lead_n")).select(*pair("set", "lead"))).distinct(), "near-star")
    needed = cut(distinct.join(met.select("set").union(by_bits.select("a")).union(by_bits.select("b")).distinct(), "set").select("set", "row"), "near-needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    arrays = cut(_shingle_arrays(docs.select("row", "text").join(needed, "row").dropDuplicates(["set"])), "near-arrays")
    links = cut(_verified(star, arrays), "near-links")
    joined = components(links)
    rooted = met.where("size > 2").select("cell", "set", "n").join(joined.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).where("low <> high").select("cell", "parts")
    crowd = skewed_join(rooted, cut(mixed, "near-mixed"), "cell", heavy).withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    crowd = cut(crowd.join(distinct.select("set", "odd"), "set"), "near-crowd")
    left = crowd.select("cell", F.col("own").alias("x"), F.explode(F.sequence(F.col("own"), F.col("parts") - 1)).alias("y"), "set", "n", "root", "odd")
    right = crowd.select("cell", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("x"), F.col("own").alias("y"), F.col("set").alias("set2"), F.col("n").alias("n2"), F.col("root").alias("root2"), F.col("odd").alias("odd2"))
    apart = (F.col("root") < F.col("root2")) | ((F.col("x") < F.col("y")) & (F.col("root") > F.col("root2")))  # inside a chunk both orders stand
    cross = left.join(right, ["cell", "x", "y"]).where(apart & _may_be_alike("n", "n2", "odd", "odd2")).select(*pair("set", "set2")).distinct()
    more = cut(_verified(cross, arrays), "near-more")
    roots = joined if more.isEmpty() else components(links.union(more))
    known = numbered.select("key", "set").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select(F.col("key").alias("set"), F.coalesce("root", "set").alias("root"))
    return skewed_join(sets.select("doc_id", "row", "set"), cut(known, "near-known"), "set", heavy_keys(sets, "set")).select("doc_id", "row", "root")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the document with the smallest doc_id of every group stays, with all its columns.

    Ties (one doc_id on several rows) go to the row with the smallest row hash, null doc_ids last; of wholly equal rows one
    stays. Null and empty texts, and those without words, are copies of each other; an empty table stays empty.
    """
    keyed, key = row_key(docs)
    grouped = cut(near_copies(keyed.select("doc_id", "text", F.col(key).alias("row"))), "op1-grouped")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    best = grouped.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    judged = skewed_join(grouped, cut(best, "op1-best"), "root", heavy_keys(grouped, "root")).select("row", (F.col("best.row") == F.col("row")).alias("wins"))
    verdict = cut(judged.groupBy("row").agg(F.max("wins").alias("wins"), F.count("*").alias("n")), "op1-verdict")
    lost = verdict.where("not wins").select(F.col("row").alias(key))
    twice = verdict.where("wins and n > 1").select(F.col("row").alias(key))
    alive = keyed.join(lost, key, "left_anti")
    if twice.isEmpty():
        return alive.select(*all_of(docs))
    once = alive.join(twice, key, "left_anti")
    return once.unionByName(alive.join(twice, key, "left_semi").dropDuplicates([key])).select(*all_of(docs))


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
