"""Ordered greedy decisions over pairs, taken in parallel wherever their order cannot matter.

``capped_pairs`` and ``merge_with_vetoes`` give what one pass over all pairs in their order would give, without that pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .greedy import per_group, per_groups
from .scratch import cut

#: Parts that the pairs of a busy endpoint or component are dealt to when their first ones are found.
SALTS = 64
#: ``capped_pairs``: rounds of joins at least; after them a rest of at most TAIL pairs ends in one task.
ROUNDS, TAIL = 4, 20_000
#: ``merge_with_vetoes``: pairs of a component that a task takes at a time.
BOUND = 200_000


def _total(order: list[str]) -> Column:
    return F.struct(*order, "a", "b")


def split_keys(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``pairs`` of keys with BOUND of them at most, which a task may take whole, and the rest."""
    large = cut(pairs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > BOUND).select(*[F.col(k).alias(f"_{k}") for k in keys]), "keys-large")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return pairs.join(F.broadcast(large), same, "left_anti"), pairs.join(F.broadcast(large), same, "left_semi")


def capped_pairs(pairs: DataFrame, order: list[str], capacity: int, keys: list[str] | None = None) -> DataFrame:
    """The pairs (a, b, ``order``) that are taken if each, smallest ``order`` first (ties by a, b), is taken while both ends have fewer than ``capacity``.

    A round takes every open pair that stands among the first open ones of both its ends, as many as those have room for: no
    pair before it can use that room up. Pairs with a full end go. A busy end's first pairs are found in parts. In the worst
    order (a path of rising pairs) a round takes one pair of a path, so a small rest is finished in one task. Pairs of a node
    with itself and pairs with nulls are ignored, repeated ones count once.

    If ``keys`` of the pairs are given, pairs of different keys share no node and a pair isn't repeated; then tasks take the
    pairs of whole keys in order, but for keys with more than BOUND, which take rounds.
    """
    if keys:
        few, many = split_keys(cut(pairs.where("a <> b").select(*keys, "a", "b", *order), "capped-pairs"), keys)

        def whole(f: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
            ends, kept = {}, []
            for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
                na, nb = ends.get(a, 0), ends.get(b, 0)
                kept.append(na < capacity and nb < capacity)
                if kept[-1]:
                    ends[a], ends[b] = na + 1, nb + 1
            return f.loc[kept, ["a", "b", *order]]

        taken = per_groups(few, keys, [*order, "a", "b"], whole, ", ".join(f"{c} {few.schema[c].dataType.simpleString()}" for c in ["a", "b", *order]))
        return taken if many.isEmpty() else taken.unionByName(capped_pairs(many, order, capacity))
    live = pairs.select("a", "b", *order).where("a <> b").dropDuplicates(["a", "b"]).select("*", F.lit(capacity).alias("ra"), F.lit(capacity).alias("rb"))
    live, taken, k = cut(live, "capped-open"), [], 0
    while (left := live.count()) and (k < ROUNDS or left > TAIL):
        k += 1
        ends = live.select(F.col("a").alias("end"), F.col("ra").alias("room"), "a", "b", *order).unionByName(live.select(F.col("b").alias("end"), F.col("rb").alias("room"), "a", "b", *order))
        ends = ends.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
        for by in (["end", "salt"], ["end"]):
            ends = ends.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(_total(order)))).where("at <= room")
        won = cut(ends.groupBy("a", "b", *order).agg(F.count("*").alias("votes")).where("votes = 2").drop("votes"), "capped-won")
        taken.append(won)
        used = won.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").cast("int").alias("n"))
        live = live.join(won.select("a", "b"), ["a", "b"], "left_anti")
        for side in ("a", "b"):
            live = live.join(used.select(F.col("end").alias(side), F.col("n").alias("_n")), side, "left").withColumn(f"r{side}", F.col(f"r{side}") - F.coalesce("_n", F.lit(0))).drop("_n").where(f"r{side} > 0")
        live = cut(live.select("a", "b", *order, "ra", "rb"), "capped-open")

    def rest(f: pd.DataFrame) -> pd.DataFrame:
        room: dict = {}
        keep = []
        for a, b, ra, rb in zip(f["a"], f["b"], f["ra"], f["rb"], strict=True):
            na, nb = room.setdefault(a, ra), room.setdefault(b, rb)
            keep.append(na > 0 and nb > 0)
            if keep[-1]:
                room[a], room[b] = na - 1, nb - 1
        return f[keep][["a", "b", *order]]

    if left:
        fields = ", ".join(f"{c} {live.schema[c].dataType.simpleString()}" for c in ["a", "b", *order])
        taken.append(per_group(live.withColumn("one", F.lit(0)), ["one"], [*order, "a", "b"], rest, fields))
    return reduce(DataFrame.unionByName, taken) if taken else live.select("a", "b", *order)


def veto_tags(labels: DataFrame, different: DataFrame) -> DataFrame:
    """(node, tag, value) of what must not meet: two labels (node, scope, label) of one scope, the two ends of a statement (a, b)."""
    own = labels.select("node", F.concat(F.lit("l"), F.col("scope").cast("string")).alias("tag"), F.col("label").cast("string").alias("value"))
    name = F.concat_ws("|", F.lit("d"), F.least("a", "b"), F.greatest("a", "b"))
    ends = different.where("a <> b").select(F.explode(F.array("a", "b")).alias("node"), name.alias("tag"))
    return own.where("tag is not null and value is not null").unionByName(ends.select("node", "tag", F.col("node").cast("string").alias("value"))).distinct()


def _decide(f: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
    """Components in order, one after the other: a component's tags first, then its pairs. Returns the fate of each pair and the root of each node.

    Components share no node, so they needn't be told apart."""
    parent: dict = {}
    tags: dict = {}
    out = []

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, a0, b0, tag, value in zip(f["a"], f["b"], f["a0"], f["b0"], f["tag"], f["value"], strict=True):
        if tag is not None:
            tags.setdefault(a, {})[tag] = value
            continue
        x, y = sorted((find(a), find(b)))
        if x == y:
            out.append((a0, b0, "inside"))
            continue
        p, q = tags.get(x, {}), tags.get(y, {})
        small, large = (p, q) if len(p) < len(q) else (q, p)
        if any(large.get(t, v) != v for t, v in small.items()):
            out.append((a0, b0, "vetoed"))
            continue
        parent[y] = x
        large.update(small)
        tags[x] = large
        tags.pop(y, None)
        out.append((a0, b0, "merged"))
    out += [(x, find(x), "root") for x in list(parent)]
    return pd.DataFrame(out, columns=["a", "b", "fate"])


def _moved(pairs: DataFrame, moved: DataFrame, order: list[str]) -> DataFrame:
    """``pairs`` between the roots that ``moved`` (root, top) gives their ends."""
    for side in ("a", "b"):
        pairs = pairs.join(moved.select(F.col("root").alias(side), F.col("top").alias(f"top_{side}")), side, "left").withColumn(side, F.coalesce(f"top_{side}", side)).drop(f"top_{side}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *order, "a0", "b0")


def spanning_forest(pairs: DataFrame, order: list[str]) -> DataFrame:
    """(a0, b0) of the pairs (a, b, ``order``, a0, b0) that, smallest first, tie two groups: each group's first pair, round by round."""
    live, total, chosen = pairs, F.struct(*order, "a0", "b0"), []
    while not live.isEmpty():
        first = live.select(F.explode(F.array("a", "b")).alias("end"), total.alias("o")).groupBy("end").agg(F.min("o").alias("o"))
        pick = cut(first.select("o.a0", "o.b0").distinct(), "forest-first")
        chosen.append(pick)
        moved = components(live.join(pick, ["a0", "b0"])).select(F.col("node").alias("root"), F.col("root").alias("top"))
        live = cut(_moved(live, moved, order).where("a <> b"), "forest-pairs")
    return reduce(DataFrame.unionByName, chosen, pairs.select("a0", "b0").where("false"))


def merge_with_vetoes(pairs: DataFrame, tags: DataFrame, order: list[str], bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """Groups and fates if each pair (a, b, ``order``), smallest first (ties by a, b), merges its two groups unless the union would hold two values of one tag.

    Returns (node, root) for all nodes of ``pairs``, root being a group's smallest node, and (a, b, fate): merged, vetoed, or
    inside (joined before). ``tags``: (node, tag, value), see ``veto_tags``; a node has one value a tag. Pairs of a node with
    itself and pairs with nulls are ignored, repeated ones count once.

    Components of up to ``bound`` pairs are decided in order by a task each. Larger ones merge whole if no tag has two values in
    them; their fates follow from the spanning forest. If one has, a task takes its first pairs, ``bound`` at most, and those
    tags alone that have two values in it; later pairs wait, are then restated between the groups found, and mostly fall into
    smaller components or inside a group.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("a", *order)}
    live = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *order).groupBy("a", "b").agg(F.min(F.struct(*order)).alias("o")).select("a", "b", "o.*")
    live = cut(live.select("a", "b", *order, F.col("a").alias("a0"), F.col("b").alias("b0")), "veto-pairs")
    tags = cut(tags.select("node", "tag", "value").distinct(), "veto-tags")
    total = F.struct(*order, "a0", "b0")
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    groups, fates = nodes.select("node", F.col("node").alias("root")), []
    while not live.isEmpty():
        comp = cut(components(live), "veto-components").select(F.col("node").alias("a"), F.col("root").alias("comp"))
        inside = cut(live.join(comp, "a"), "veto-inside")
        own = tags.withColumnRenamed("node", "a").join(comp, "a")
        torn = cut(own.groupBy("comp", "tag").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("comp", "tag"), "veto-torn")
        large = inside.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > bound)
        free = cut(large.join(torn.select("comp").distinct(), "comp", "left_anti").select("comp"), "veto-free")
        whole = cut(inside.join(free, "comp", "left_semi"), "veto-whole")
        open_ = inside.join(free, "comp", "left_anti").withColumn("salt", F.pmod(F.xxhash64("a0", "b0"), F.lit(SALTS)))
        part = max(1, bound // SALTS)
        ranked = cut(open_.withColumn("at", F.row_number().over(Window.partitionBy("comp", "salt").orderBy(total))), "veto-ranked")
        until = ranked.where(F.col("at") == part).groupBy("comp").agg(F.min(total).alias("until"))  # no more than ``bound`` come before it
        ranked = ranked.join(until, "comp", "left")
        now, later = ranked.where(F.col("until").isNull() | (total <= F.col("until"))), ranked.where(total > F.col("until"))
        none = F.lit(None).cast("string")
        rows = now.select("comp", F.lit(1).alias("kind"), *order, "a0", "b0", "a", "b", none.alias("tag"), none.alias("value"))
        heads = own.join(torn, ["comp", "tag"]).select("comp", F.lit(0).alias("kind"), "a", "tag", "value")
        done = per_groups(heads.unionByName(rows, allowMissingColumns=True), ["comp"], ["kind", *order, "a0", "b0"], _decide, f"a {kinds['a']}, b {kinds['a']}, fate string")
        done = cut(done, "veto-done")
        fates.append(done.where("fate <> 'root'"))
        forest = spanning_forest(whole.select("a", "b", *order, "a0", "b0"), order).withColumn("fate", F.lit("merged"))
        fates.append(whole.join(forest, ["a0", "b0"], "left").select(F.col("a0").alias("a"), F.col("b0").alias("b"), F.coalesce("fate", F.lit("inside")).alias("fate")))
        moved = done.where("fate = 'root'").select(F.col("a").alias("root"), F.col("b").alias("top")).unionByName(comp.join(free, "comp", "left_semi").select(F.col("a").alias("root"), F.col("comp").alias("top")))
        moved = cut(moved, "veto-moved")
        groups = cut(groups.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "veto-groups")
        tags = cut(tags.withColumnRenamed("node", "root").join(moved, "root", "left").select(F.coalesce("top", "root").alias("node"), "tag", "value").distinct(), "veto-tags")
        later = cut(_moved(later, moved, order), "veto-pairs")
        fates.append(later.where("a = b").select(F.col("a0").alias("a"), F.col("b0").alias("b"), F.lit("inside").alias("fate")))
        live = later.where("a <> b")
    empty = live.select("a", "b", F.lit("").alias("fate")).where("false")
    return groups, reduce(DataFrame.unionByName, fates, empty)
