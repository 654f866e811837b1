"""Property graphs as two tables: nodes(id, label, name) and edges(src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def valid_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, and distinct edges with both ends."""
    n = nodes.dropDuplicates(["id"])
    ids = n.select("id")
    e = edges.dropDuplicates(["src", "type", "dst"])
    return n, e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, *, filters: dict[str, list[str]] | None = None) -> DataFrame:
    """id, hop: the nodes within ``hops`` (1 to 4) undirected steps of seeds(id), and the least number
    of steps. ``filters``: values that an edge's columns must have. Edges are written once, both ways,
    and each hop's new nodes too, so a hop reads two tables, however many came before."""
    for column, values in (filters or {}).items():
        edges = edges.where(F.col(column).isin(values))
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = front = stored(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, max(1, min(hops, 4)) + 1):
        step = front.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct()
        front = stored(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def interleave(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two ranked lists (key, rank) as one: source (both, graph for the first, vector for the second)
    and best, the rank in the first list that has the key."""
    j = first.withColumnRenamed("rank", "ra").join(second.withColumnRenamed("rank", "rb"), key, "full")
    source = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), "both").when(F.col("ra").isNotNull(), "graph").otherwise("vector")
    return j.select(key, source.alias("source"), F.coalesce("ra", "rb").alias("best"))
