"""Merkle dataset manifest: a tree of arity 8 over the rows of every language, one over the languages, a proof for every row.

Nodes of a tree carry their position. Positions are cut into aligned blocks of ``ARITY ** LEVELS`` nodes; a task walks a block
in postorder: the call for a subtree returns its digest, and while the calls unwind, each appends its siblings to the nodes
below it. The blocks' digests are the nodes of the next table, which the same traversal takes, until one node of each tree is
left; their number shrinks 512-fold a round. On the way back every block is given its own path to the root, which its nodes'
paths end with. No task holds more than a block, whatever share of the rows a language has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

ARITY = 8
#: Levels of a block; a task holds ARITY ** LEVELS nodes at a time.
LEVELS = 3
BLOCK = ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The leaf of a row of documents that holds ``text``."""
    return F.sha2(F.concat(*[_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]), 256)


def positions(nodes: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``nodes`` with ``pos``, their place within ``tree`` by ``order``, and ``n``, the nodes of the tree.

    One range sort; then only the counts of each partition and tree are added up (as many rows as partitions and trees).
    Rows equal in ``order`` may stand in any order. A last column keeps equal rows from filling one partition.
    """
    spread = F.monotonically_increasing_id()
    nodes = cut(nodes.withColumn("_r", spread), "op12-nodes")
    ranged = nodes.repartitionByRange(tree, *order, "_r").sortWithinPartitions(tree, *order, "_r").drop("_r")
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "op12-sorted")
    parts = ranged.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(tree, "_part", "_first", before.alias("_before"), F.sum("_n").over(w).alias("n"))
    return ranged.join(parts, [tree, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def _walk(nodes: list[str], paths: list[list], at: int, height: int) -> str:
    """Postorder: the digest of the subtree of ``height`` whose leaves begin at ``at``. Appends to ``paths`` of its leaves what stands left and right of them in its own run."""
    if height == 0:
        return nodes[at]
    size = ARITY ** (height - 1)
    starts = range(at, min(at + ARITY * size, len(nodes)), size)
    run = "".join([_walk(nodes, paths, s, height - 1) for s in starts])
    for k, s in enumerate(starts):
        step = {"left": run[: 64 * k], "right": run[64 * (k + 1) :]}
        for p in paths[s : s + size]:
            p.append(step)
    return digest(run)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of one block each, from rows sorted by tree and block; a block may run over several batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        trees, blocks = b.column("tree").to_pylist(), b.column("block").to_pylist()
        at = 0
        for k in range(b.num_rows):
            if (trees[k], blocks[k]) != key:
                if k > at:
                    held.append(b.slice(at, k - at))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, at, key = [], k, (trees[k], blocks[k])
        if b.num_rows > at:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def block_roots(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest): the nodes of the next table from (tree, pos, n, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in _blocks(batches):
            below, n = b.column("digest").to_pylist(), b.column("n")[0].as_py()
            top = _walk(below, [[] for _ in below], 0, min(LEVELS, _height(n)))
            out.append((b.column("tree")[0].as_py(), b.column("block")[0].as_py(), -(-n // BLOCK), top))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["tree", "pos", "n", "digest"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["tree", "pos", "n", "digest"])

    blocks = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest")
    return _by_block(blocks).mapInArrow(run, "tree string, pos bigint, n bigint, digest string")


def node_paths(nodes: DataFrame, upper: DataFrame, keep: list[str]) -> DataFrame:
    """(tree, pos, ``keep``, path): every node's siblings from its run up to the root, from ``upper``: (tree, pos, path) of its block.

    A block's path travels as a row of its own in front of the block's nodes, not as a copy with each of them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(["tree string", "pos bigint", *[f"`{c}` {kinds[c]}" for c in keep], f"path {PATH}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            above, b = b.column("path")[0].as_py(), b.slice(1)
            below, n = b.column("digest").to_pylist(), b.column("n")[0].as_py()
            paths: list[list] = [[] for _ in below]
            _walk(below, paths, 0, min(LEVELS, _height(n)))
            yield pa.RecordBatch.from_arrays(
                [b.column("tree"), b.column("pos"), *[b.column(c) for c in keep], pa.array([p + above for p in paths], type=_PATH_ARROW)], names=["tree", "pos", *keep, "path"]
            )

    rows = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest", *[c for c in keep if c != "digest"], F.lit(None).cast(PATH).alias("path"))
    heads = upper.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "path")
    return _by_block(rows.unionByName(heads, allowMissingColumns=True)).mapInArrow(run, schema)


class _Forest:
    """The tables of nodes of one or many trees, up to their roots."""

    def __init__(self, nodes: DataFrame):
        """``nodes``: (tree, pos, n, digest) and more; already written."""
        self.tables = [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            self.tables.append(cut(block_roots(self.tables[-1]), "op12-blocks"))
            most = -(-most // BLOCK)

    def roots(self) -> DataFrame:
        """(tree, digest)."""
        return self.tables[-1].select("tree", "digest")

    def paths(self, above: DataFrame, keep: list[str]) -> DataFrame:
        """(tree, pos, ``keep``, path) of the first table's nodes; ``above``: (tree, path), what follows a tree's root."""
        upper = above.select("tree", F.lit(0).cast("bigint").alias("pos"), "path")
        for k in range(len(self.tables) - 2, -1, -1):
            nodes = self.tables[k]
            upper = node_paths(nodes, upper, keep if k == 0 else [])
            upper = cut(upper, "op12-paths") if k else upper
        return upper if len(self.tables) > 1 else self.tables[0].join(upper, ["tree", "pos"]).select("tree", "pos", *keep, "path")


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``path``."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, lang, text_leaf (leaf), seen (the leaf of the row as it stands after tampering, null: unchanged),
    subroot, root, path (siblings left and right of it, level by level).

    Rows of a language ascend by doc_id, nulls first; rows of one doc_id by their leaves. Equal rows have equal leaves and
    each its own proof. A null language comes first and is a tree of its own. An empty table gives an empty result. A tree
    of one leaf has that leaf as its root. Columns besides doc_id, source, lang, n_chars and text are not read.
    """
    text = F.col("text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"), leaf_digest(text).alias("digest"), F.when(hit, leaf_digest(F.translate(text, UPPER, LOWER))).alias("seen")
    )  # "-" sorts before "="
    leaves = cut(positions(leaves, "tree", [F.col("doc_id"), F.col("digest")]), "op12-leaves")
    rows = _Forest(leaves)
    langs = positions(rows.roots().select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest"), "tree", [F.col("lang_tree")])
    langs = _Forest(cut(langs, "op12-langs"))
    root = langs.roots().first()  # one digest
    nothing = docs.sparkSession.createDataFrame([("", [])], f"tree string, path {PATH}")
    above = cut(langs.paths(nothing, ["lang_tree", "digest"]), "op12-lang-paths")
    out = rows.paths(above.select(F.col("lang_tree").alias("tree"), "path"), ["doc_id", "digest", "seen"])
    depth = above.agg(F.max(F.size("path"))).first()[0] or 0
    own = F.slice("path", 1, F.size("path") - depth)  # up to the subroot
    return out.select("doc_id", F.col("digest").alias("leaf"), "seen", fold(F.col("digest"), own).alias("subroot"), F.lit(root["digest"] if root else None).cast("string").alias("root"), "path")


def proofs(docs: DataFrame) -> DataFrame:
    """The manifest with each proof's digest, the root folded from the row as it stands, and whether that is the root."""
    out = manifest(docs).withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_block_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """Levels by recursion over runs; proofs and foldings by recursion over levels; crc32 bit by bit."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}), 4294967295::BIGINT)"
    tree = lambda name, start: f"""{name} AS (  -- tree, level, pos, n, digest
  SELECT tree, 0 AS level, pos, n, digest FROM {start}
  UNION ALL SELECT tree, level + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {ARITY}, n)"""  # noqa: E731
    beside = lambda name: f"""SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // {ARITY} = b.pos // {ARITY} WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos"""  # noqa: E731
    return f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS seen FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM rows_),
{tree('nodes', 'leaves')},
subroots AS (SELECT tree AS lang_tree, digest, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, (SELECT max(level) FROM nodes x WHERE x.tree = nodes.tree) AS height FROM nodes WHERE n = 1),
{tree('tops', 'subroots')},
beside AS ({beside('nodes')}), beside_top AS ({beside('tops')}),
steps AS (  -- every sibling list of a leaf
  SELECT f.doc_id, f.tree, f.pos, s.level, s.l, s.r FROM leaves f JOIN beside s ON s.tree = f.tree AND s.pos = f.pos // ({ARITY} ** s.level)::BIGINT
  UNION ALL SELECT f.doc_id, f.tree, f.pos, u.height + s.level, s.l, s.r FROM leaves f JOIN subroots u ON u.lang_tree = f.tree JOIN beside_top s ON s.pos = u.pos // ({ARITY} ** s.level)::BIGINT),
folded AS (SELECT tree, pos, 0 AS level, seen AS digest FROM leaves
  UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(s.l || f.digest || s.r) FROM folded f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level),
ends AS (SELECT tree, pos, max_by(digest, level) AS folded_root FROM folded GROUP BY tree, pos),
proof AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY level) AS p FROM steps GROUP BY tree, pos)
SELECT f.doc_id, f.leaf, u.digest AS subroot, t.digest AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM leaves f JOIN subroots u ON u.lang_tree = f.tree JOIN (SELECT digest FROM tops WHERE n = 1) t ON true JOIN ends e ON e.tree = f.tree AND e.pos = f.pos
LEFT JOIN proof p ON p.tree = f.tree AND p.pos = f.pos"""
