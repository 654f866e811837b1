"""Queries that design samples and test cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import designs as D
from ..operators.sampling import hash_order
from .registry import query

_TIERS = """c AS (SELECT source, count(*) FILTER (WHERE n_chars <= 1500) AS e FROM documents GROUP BY 1), cold AS (SELECT source FROM c WHERE e < 0.9 * (SELECT avg(e) FROM c)),
d AS (SELECT doc_id, source, n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, source IN (SELECT source FROM cold) AS is_cold, md5(CAST(doc_id AS VARCHAR) || '|tiers') AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, n_chars <= 1500 ORDER BY h) AS rn FROM d),
t AS (SELECT *, CASE WHEN n_chars > 6000 THEN 'appendix' WHEN n_chars > 1500 THEN NULL WHEN is_cold AND rn <= 2 THEN 'floor' WHEN is_cold THEN 'cold' WHEN digits >= 6 THEN 'fuzzy' WHEN n_chars BETWEEN 200 AND 600 THEN 'pair' ELSE 'plain' END AS tier FROM r),
n AS (SELECT count(*) FILTER (WHERE tier = 'appendix') AS na, count(*) FILTER (WHERE tier = 'floor') AS nf, count(*) FILTER (WHERE tier = 'cold') AS nc, count(*) FILTER (WHERE tier = 'plain') AS np, count(*) FILTER (WHERE tier = 'fuzzy') AS nz, count(*) FILTER (WHERE tier = 'pair') AS nq, count(*) // 4 AS total FROM t),
q AS (SELECT *, CAST(floor(0.4 * total) AS BIGINT) AS tail, CAST(floor(0.3 * total) AS BIGINT) AS fuzzy FROM n), a1 AS (SELECT *, least(na, CAST(floor(0.4 * tail) AS BIGINT)) AS aa FROM q), a2 AS (SELECT *, least(nc, greatest(0, tail - aa - nf)) AS ac FROM a1),
a3 AS (SELECT *, least(np, greatest(0, tail - aa - nf) - ac) AS ap FROM a2), a4 AS (SELECT *, greatest(0, tail - aa - nf) - ac - ap AS room FROM a3), a5 AS (SELECT *, least(nz, fuzzy + room) AS az, fuzzy + room - least(nz, fuzzy + room) AS room2 FROM a4),
a6 AS (SELECT *, least(nq, total - tail - fuzzy + room2) AS aq, total - tail - fuzzy + room2 - least(nq, total - tail - fuzzy + room2) AS room3 FROM a5)
"""


@query("tier_quota", f"""WITH {_TIERS} SELECT doc_id, source, tier FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY h) AS place FROM t WHERE tier IS NOT NULL), a6
WHERE place <= CASE tier WHEN 'appendix' THEN aa WHEN 'floor' THEN nf WHEN 'cold' THEN ac WHEN 'plain' THEN ap + least(np - ap, room3) WHEN 'fuzzy' THEN az ELSE aq END""")
def tier_quota(t, spark):
    """A quarter of all documents in three tiers: every cold source has its two, appendices at most their share."""
    d = t("documents").select("doc_id", "source", "n_chars", F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"))
    short = F.col("n_chars") <= 1500
    per = d.groupBy("source").agg(F.count_if(short).alias("e"))
    cold = per.crossJoin(F.broadcast(per.agg(F.avg("e").alias("mean")))).where("e < 0.9 * mean").select("source", F.lit(True).alias("is_cold"))  # one row
    own = d.join(cold, "source", "left").withColumn("is_cold", F.coalesce("is_cold", F.lit(False)))
    # cold sources have few short documents, so their window is small; others aren't ranked
    few = own.where(F.col("is_cold") & short).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(hash_order(F.col("doc_id"), "tiers"))))
    floor = few.select("doc_id", "source", F.when(F.col("rn") <= 2, "floor").otherwise("cold").alias("tier"))
    kind = F.when(F.col("n_chars") > 6000, "appendix").when(~short, None).when(F.col("digits") >= 6, "fuzzy").when(F.col("n_chars").between(200, 600), "pair").otherwise("plain")
    rows = floor.unionByName(own.where(~(F.col("is_cold") & short)).select("doc_id", "source", kind.alias("tier")))
    total = d.count() // 4
    return D.tiered(rows, "tier", "doc_id", "tiers", lambda counts: D.tier_allocation(counts, total)).select("doc_id", "source", "tier")


@query("brand_triples", "WITH b AS (SELECT DISTINCT p_brand AS x FROM part) SELECT a.x AS first, b.x AS second, c.x AS third, 'What do ' || a.x || ', ' || b.x || ' and ' || c.x || ' share?' AS text FROM b a JOIN b ON a.x < b.x JOIN b c ON b.x < c.x")
def brand_triples(t, spark):
    """Every three brands in a question."""
    c = D.combinations_of(t("part"), "p_brand", 3)
    return c.withColumn("text", F.format_string("What do %s, %s and %s share?", "first", "second", "third"))


@query("supplier_pairs", "SELECT a.s_suppkey AS first, b.s_suppkey AS second FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def supplier_pairs(t, spark):
    """Every two suppliers, from the pairs' numbers."""
    return D.combinations_of(t("supplier"), "s_suppkey", 2)


_ASKED, _SCENES = ["Is %s allowed for %s?", "May %s be used with %s?", "Check %s against %s."], ["site", "plan"]


@query("value_grid", "WITH s AS (SELECT p_type, CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part GROUP BY 1), v AS (SELECT p_type, round(lo + (hi - lo) * k / 4, 4) AS value FROM s, range(5) r(k)) SELECT p_type, value, asked, scene, replace(regexp_replace(asked, '%s', CAST(round(value) AS BIGINT)::VARCHAR), '%s', p_type) AS text FROM v, (VALUES " + ", ".join(f"('{a}')" for a in _ASKED) + ") a(asked), (VALUES " + ", ".join(f"('{x}')" for x in _SCENES) + ") x(scene)")
def value_grid(t, spark):
    """Questions about each kind of part: five sizes between its least and largest, three phrasings, two scenes."""
    span = t("part").groupBy("p_type").agg(F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    g = D.grid_of(span, F.col("lo"), F.col("hi"), 5, {"asked": _ASKED, "scene": _SCENES})
    parts = F.split("asked", "%s")
    text = F.concat(F.get(parts, F.lit(0)), F.round("value").cast("long").cast("string"), F.get(parts, F.lit(1)), F.col("p_type"), F.get(parts, F.lit(2)))
    return g.select("p_type", "value", "asked", "scene", text.alias("text"))
