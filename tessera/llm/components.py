"""Connected components of a graph given as rows, by contraction to smallest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def components(links: DataFrame, *, rounds: int = 64) -> DataFrame:
    """links: columns a, b (any type with an order). Gives node, root (the smallest node reachable)
    for every node that has a link.

    Each round points every node to the smallest of itself and its neighbours, follows these pointers
    to their ends, and puts the ends in place of the nodes. Links within one end are dropped, so a
    round's joins see what the rounds before have left: a star is gone after two. The smallest node
    of a component never moves, so it is the last end. Minima are partial before each shuffle; a
    hub's links are joined by a shuffled join, which Spark may split.
    """
    left = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    for _ in range(rounds):
        levels.append(_ends(left))
        ends = levels[-1].select("node", "root")
        moved = left.join(ends.toDF("a", "ra"), "a").join(ends.toDF("b", "rb"), "b").where("ra <> rb")
        nxt = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        drop(left)
        left = nxt
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = reduce(lambda upper, lower: relabel(lower, upper), reversed([x.select("node", "root") for x in levels]))
    if len(levels) > 1:
        out = cut(out)
        drop(*levels)
    drop(left)
    return out


def _ends(links: DataFrame) -> DataFrame:
    """node, was, root: where the way from each node over smallest neighbours ends."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:  # a pass leaves a quarter of the longest way, and tells by its last step whether that is all
        ways = ends.select("node", "root")
        once = ways.join(ways.toDF("root", "next"), "root").select("node", F.col("next").alias("root"))
        twice = once.join(ways.toDF("root", "next"), "root").select("node", F.col("root").alias("was"), F.col("next").alias("root"))
        nxt = cut(twice)
        drop(ends)
        ends = nxt
        if nxt.where("was <> root").isEmpty():
            return nxt


def relabel(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes(node, root) with each root replaced by its root in roots, where it has one."""
    to = roots.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return nodes.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
