"""Hybrid search: BM25 and hashed vectors of whole texts, fused in a grid of settings, by scenario."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from .measures import _GRID, _GRID_SQL
from .registry import query
from .retrieval import _BOUNDS, BM25, _bounds, _gold, _lexical

_VECTOR = """SELECT id, b, sum(w) AS w FROM (
    SELECT id, unnest(list_transform(c, lambda x: ((177573 + ord(x)) % 4294967296) % 256)) AS b, 0.5::DOUBLE AS w FROM {0}
    UNION ALL SELECT id, unnest(list_transform(range(1, len(c) + 1), lambda i: (CASE WHEN i < len(c) THEN ((177573 + ord(c[i])) * 33 + ord(c[i + 1])) % 4294967296 ELSE (177573 + ord(c[i])) % 4294967296 END) % 256)), 1.0::DOUBLE FROM {0}) GROUP BY 1, 2"""
_DENSE = f"""dc AS (SELECT doc_id AS id, string_split(text, '') AS c FROM documents WHERE length(text) > 0), qc AS (SELECT item_id AS id, string_split(text, '') AS c FROM benchmark WHERE length(text) > 0),
dv AS ({_VECTOR.format("dc")}), qv AS ({_VECTOR.format("qc")}), dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1), qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1),
ds AS (SELECT qv.id AS item_id, dv.id AS doc_id, round(sum(dv.w * qv.w) / max(dn.n * qn.n), 6) AS score FROM qv JOIN dv USING (b) JOIN dn ON dn.id = dv.id JOIN qn ON qn.id = qv.id GROUP BY 1, 2),
dns AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM ds WHERE score > 0) WHERE rank <= 10)"""


def _dense(t, k=10):
    return R.dense_ranked(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", "text"), "doc_id", "item_id", k)


@query("hash_dense_topk", f"WITH {_DENSE} SELECT item_id, doc_id, score, rank FROM dns")
def hash_dense_topk(t, spark):
    """The documents whose hashed vectors are most like each passage's."""
    return _dense(t)


#: A passage's scenario: by its length.
_SCENARIO = "CASE WHEN length(text) > 300 THEN 'long' WHEN length(text) > 180 THEN 'middle' ELSE 'short' END"
_HYBRID = f"""{BM25}, {_BOUNDS}, {_DENSE}, {_GRID_SQL}, l AS (SELECT item_id, doc_id, rank AS ra, score AS xa, CASE WHEN hi <= lo THEN 0.0 ELSE (least(greatest(score, lo), hi) - lo) / (hi - lo) END AS sa FROM lex, b), c AS (SELECT item_id, doc_id, rank AS rb, score AS xb, (least(greatest(score, -1.0), 1.0) + 1.0) / 2.0 AS sb FROM dns),
j AS (SELECT coalesce(l.item_id, c.item_id) AS item_id, coalesce(l.doc_id, c.doc_id) AS doc_id, ra, rb, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb, round(coalesce(xa, 0) + coalesce(xb, 0), 6) AS raw FROM l FULL JOIN c ON l.item_id = c.item_id AND l.doc_id = c.doc_id),
s AS (SELECT ord, kind, p, item_id, doc_id, raw, round(CASE kind WHEN 'bm25' THEN 1.0 / ra WHEN 'coverage' THEN 1.0 / rb WHEN 'rrf' THEN coalesce(1.0 / (p + ra), 0) + coalesce(1.0 / (p + rb), 0) ELSE p * sa + (1 - p) * sb END, 9) AS score FROM j, grid),
r AS (SELECT *, row_number() OVER (PARTITION BY ord, item_id ORDER BY score DESC, raw DESC, doc_id) AS rank FROM s WHERE score IS NOT NULL)"""


def _settings(t, spark):
    """ord, kind, p, item_id, doc_id, rank of the first five of each setting. Both lists hold at most ten documents of
    a passage, so that their join and the grid are small against the search."""
    lexical, dense = _lexical(t), _dense(t)
    a = lexical.crossJoin(F.broadcast(_bounds(lexical))).select("item_id", "doc_id", F.col("rank").alias("ra"), F.col("score").alias("xa"), R.winsor_minmax(F.col("score"), F.col("lo"), F.col("hi")).alias("sa"))
    b = dense.select("item_id", "doc_id", F.col("rank").alias("rb"), F.col("score").alias("xb"), R.winsor_minmax(F.col("score"), F.lit(-1.0), F.lit(1.0)).alias("sb"))
    j = a.join(b, ["item_id", "doc_id"], "full").fillna(0.0, ["sa", "sb", "xa", "xb"]).withColumn("raw", F.round(F.col("xa") + F.col("xb"), 6))
    grid = F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(kind).alias("kind"), F.lit(p).alias("p")) for o, kind, p in _GRID)))
    s = j.select("*", grid.alias("g")).select("item_id", "doc_id", "ra", "rb", "sa", "sb", "raw", "g.*")
    zero, p = F.lit(0.0), F.col("p")
    score = F.when(F.col("kind") == "bm25", 1 / F.col("ra")).when(F.col("kind") == "coverage", 1 / F.col("rb")).when(F.col("kind") == "rrf", F.coalesce(1 / (p + F.col("ra")), zero) + F.coalesce(1 / (p + F.col("rb")), zero)).otherwise(p * F.col("sa") + (1 - p) * F.col("sb"))
    rank = F.row_number().over(Window.partitionBy("ord", "item_id").orderBy(F.desc("score"), F.desc("raw"), "doc_id"))
    return s.withColumn("score", F.round(score, 9)).where("score IS NOT NULL").withColumn("rank", rank).where("rank <= 5").select("ord", "kind", "p", "item_id", "doc_id", "rank")


@query("hybrid_grid", f"""WITH {_HYBRID}, scn AS (SELECT item_id, unnest(['all', {_SCENARIO}]) AS scenario FROM benchmark WHERE item_id IN (SELECT item_id FROM gold)),
g AS (SELECT item_id, count(DISTINCT doc_id) AS n_gold FROM gold GROUP BY 1),
f AS (SELECT ord, item_id, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN (SELECT DISTINCT * FROM gold) USING (item_id, doc_id) WHERE rank <= 5 GROUP BY 1, 2),
m AS (SELECT grid.ord, kind, p, scenario, count(*) AS n, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CAST(first IS NOT NULL AS INT)), 6) AS hit5, round(avg(coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda x: 1 / log2(x + 1))), 0)), 6) AS ndcg5
FROM grid CROSS JOIN scn JOIN g USING (item_id) LEFT JOIN f ON f.ord = grid.ord AND f.item_id = scn.item_id GROUP BY 1, 2, 3, 4)
SELECT CAST(ord AS INT) AS ord, kind, p, scenario, n, mrr, hit5, ndcg5, row_number() OVER (PARTITION BY scenario, kind ORDER BY mrr DESC, ord) = 1 AS best FROM m""")
def hybrid_grid(t, spark):
    """Both lists alone, four constants of rank fusion and eleven weights, over all passages and by scenario; the
    first of the best settings of each kind is marked."""
    gold = _gold(t).distinct()
    n_gold = gold.groupBy("item_id").agg(F.count("*").alias("n_gold"))
    own = t("benchmark").select("item_id", F.explode(F.array(F.lit("all"), F.expr(_SCENARIO))).alias("scenario")).join(n_gold, "item_id")
    hits = _settings(t, spark).join(gold, ["item_id", "doc_id"]).groupBy("ord", "item_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    settings = F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(kind).alias("kind"), F.lit(p).alias("p")) for o, kind, p in _GRID)))
    every = own.select("*", settings.alias("g")).select("item_id", "scenario", "n_gold", "g.*").join(hits, ["ord", "item_id"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(5)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    mean = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(name)
    m = every.groupBy("ord", "kind", "p", "scenario").agg(F.count("*").alias("n"), mean(1 / F.col("first"), "mrr"), mean(F.col("first").isNotNull().cast("double"), "hit5"), mean(F.col("dcg") / ideal, "ndcg5"))
    best = F.row_number().over(Window.partitionBy("scenario", "kind").orderBy(F.desc("mrr"), "ord")) == 1  # 17 settings
    return m.withColumn("best", best)
