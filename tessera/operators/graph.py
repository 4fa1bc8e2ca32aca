"""Connected components of an edge table by repeated contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def _smallest_root(edges: DataFrame) -> DataFrame:
    """(node, root) where root is the smallest neighbour if that is smaller than the node itself, flattened to the tops."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "graph-hook")
    while True:
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = cut(hook.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "graph-jump")
        hook = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return hook


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for edges (a, b); root is the smallest node of the component. Loops and nulls are ignored.

    A round hooks every node to its smallest neighbour, flattens the forest by pointer jumping and contracts the edges to
    the roots, so that later rounds shuffle fewer of them: every component's nodes at least halve. Roots only ever go down
    and the smallest node of a component is never hooked, so the last root is the smallest node. Every round is written to
    the shared folder; an empty table gives an empty result.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, rounds = cut(live, "graph-edges"), []
    while not live.isEmpty():
        roots = _smallest_root(live)
        rounds.append(roots)
        to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        live = cut(live.join(to("a"), "a").join(to("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "graph-edges")
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(out, "graph-roots") if len(rounds) > 1 else out
