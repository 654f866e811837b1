"""Graph queries: regions, nations, customers, suppliers and orders as nodes, their keys as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import sampling as S
from .registry import query

_EDGES = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'LIVES_IN' AS type FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LIVES_IN' FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation UNION SELECT 'o' || o_orderkey, 'c' || o_custkey, 'PLACED_BY' FROM orders)"""


def _edges(t):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = lambda name, a, b, kind: t(name).select(s(*a).alias("src"), s(*b).alias("dst"), F.lit(kind).alias("type"))
    e = one("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "LIVES_IN").union(one("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "LIVES_IN"))
    return e.union(one("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "PART_OF")).union(one("orders", ("o", "o_orderkey"), ("c", "o_custkey"), "PLACED_BY")).distinct()


@query("graph_edges", f"WITH {_EDGES} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY 1")
def graph_edges(t, spark):
    return _edges(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("graph_degrees", f"WITH {_EDGES}, d AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) SELECT id, count(*) AS degree FROM d GROUP BY 1")
def graph_degrees(t, spark):
    return G.degrees(_edges(t))


@query("khop_expand", f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k(id, hop) AS (SELECT 'r0', 0 UNION SELECT b.dst, hop + 1 FROM k JOIN b ON b.src = k.id WHERE hop < 3) SELECT id, min(hop) AS hop FROM k GROUP BY 1""")
def khop_expand(t, spark):
    """Everything within three steps of the first region."""
    seeds = t("region").where("r_regionkey = 0").select(F.lit("r0").alias("id"))
    return G.k_hop(_edges(t), seeds, 3)


@query("regulated_by", "SELECT s_nationkey AS nation, p_brand AS brand, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 5")
def regulated_by(t, spark):
    l = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    j = l.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    return j.groupBy("nation", "brand").agg(F.countDistinct("l_partkey").alias("n")).where("n >= 5")


@query("whitelist_chain", "SELECT DISTINCT r_name, n_name, s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE contains(r_name, 'A') AND s_acctbal > 5000")
def whitelist_chain(t, spark):
    """Two steps from a named seed to what it allows."""
    r = t("region").where(F.contains("r_name", F.lit("A"))).select("r_name", F.col("r_regionkey").alias("n_regionkey"))
    n = t("nation").join(r, "n_regionkey").select("r_name", "n_name", F.col("n_nationkey").alias("s_nationkey"))
    return t("supplier").where("s_acctbal > 5000").join(n, "s_nationkey").select("r_name", "n_name", "s_suppkey").distinct()


@query("graph_vector_merge", """WITH a AS (SELECT p_partkey AS k, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INT) AS ra FROM part WHERE p_size > 10), b AS (SELECT p_partkey AS k, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS INT) AS rb FROM part WHERE p_size < 45),
j AS (SELECT coalesce(a.k, b.k) AS k, ra, rb, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 'both' WHEN ra IS NOT NULL THEN 'graph' ELSE 'vector' END AS source FROM a FULL JOIN b ON a.k = b.k),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(ra, rb), k) AS n FROM j) SELECT k, source, CAST(row_number() OVER (ORDER BY source <> 'both', CASE WHEN source = 'both' THEN 0 ELSE n END, CASE WHEN source = 'both' THEN n ELSE 0 END, source, k) AS BIGINT) AS place FROM n""")
def graph_vector_merge(t, spark):
    """Two ranked lists as one: what both have comes first, then they take turns, the graph's first."""
    graph = S.numbered(t("part").where("p_size > 10").select("p_partkey", (-F.col("p_retailprice")).alias("o"), "p_partkey").toDF("k", "o", "k2").select("k", F.struct("o", "k2").alias("o")), "o")
    vector = S.numbered(t("part").where("p_size < 45").select(F.col("p_partkey").alias("k"), F.struct((-F.col("p_size")).alias("o"), F.col("p_partkey").alias("k2")).alias("o")), "o")
    j = G.interleave(graph.select("k", F.col("i").alias("rank")), vector.select("k", F.col("i").alias("rank")), "k")
    first = F.col("source") == "both"
    turn = S.numbered(j.select("k", "source", F.struct("best", "k").alias("o")), "o", "source")
    order = F.struct((~first).alias("a"), F.when(first, 0).otherwise(F.col("i")).alias("b"), F.when(first, F.col("i")).otherwise(0).alias("c"), "source", "k")
    return S.numbered(turn.select("k", "source", order.alias("o")), "o").select("k", "source", (F.col("i") + 1).alias("place"))


@query("graph_load_checks", "WITH e AS (SELECT o_orderkey, o_custkey FROM orders) SELECT count(*) AS n, count(c_custkey) AS with_both_ends, count(DISTINCT o_custkey) AS targets FROM e LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def graph_load_checks(t, spark):
    """Edges of which both ends exist."""
    c = t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("has"))
    return t("orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("with_both_ends"), F.countDistinct("o_custkey").alias("targets"))


@query("code_prefix_join", "WITH k AS (SELECT DISTINCT p_brand FROM part) SELECT a.p_brand AS shorter, b.p_brand AS longer FROM k a JOIN k b ON starts_with(b.p_brand, a.p_brand) AND a.p_brand <> b.p_brand")
def code_prefix_join(t, spark):
    """Codes that start with another code: each code's prefixes are looked up by equality."""
    k = t("part").select("p_brand").distinct()
    pre = k.select(F.col("p_brand").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.length("p_brand") - 1), lambda i: F.expr("p_brand").substr(F.lit(1), i))).alias("p_brand"))
    return pre.join(k, "p_brand").select(F.col("p_brand").alias("shorter"), "longer")
