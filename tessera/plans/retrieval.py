"""Retrieval queries: benchmark passages as questions over documents, and vectors over vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import retrieval as R
from .registry import query

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
BM25 = f"""w AS (SELECT doc_id, {_TOK} AS words FROM documents), qw AS (SELECT DISTINCT item_id, unnest({_TOK}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(greatest(len(words), 1)) AS avgdl FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, greatest(len(words), 1) AS dl, unnest(words) AS term FROM w) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qw JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
cov AS (SELECT item_id, doc_id, round(count(*) / CAST(any_value(nq) AS DOUBLE), 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS nq FROM qw) q JOIN (SELECT doc_id, term FROM tf) t USING (term) GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc) WHERE rank <= 10),
cvr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM cov) WHERE rank <= 10),
gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _lists(t, k=10, measures=("bm25", "coverage")):
    """The best k documents of each benchmark passage by BM25 and by the share of its words they have."""
    texts = t("documents").select("doc_id", F.array(T.tokens(F.coalesce("text", F.lit("")))).alias("units"))
    return R.ranked(texts, R.tokenised(t("benchmark"), "item_id"), "doc_id", "item_id", k, measures=measures)


def _of(lists, name):
    return lists.where(F.col("list") == name).select("item_id", "doc_id", "score", "rank")


def _lexical(t, k=10):
    return _of(_lists(t, k, ("bm25",)), "bm25")


def _both(t, k=10):
    lists = _lists(t, k)
    return _of(lists, "bm25"), _of(lists, "coverage")


def _gold(t):
    """Documents that hold the passage."""
    return R.holders(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", "text"), "doc_id", "item_id")


@query("term_stats", f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def term_stats(t, spark):
    words = R.tokenised(t("documents"), "doc_id")
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(R.corpus_stats(words))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("corpus_stats", f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM tf) AS n_postings FROM st")
def corpus_stats(t, spark):
    words = R.tokenised(t("documents"), "doc_id").withColumn("n_distinct", F.size(F.array_distinct("words")))
    return words.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("n_distinct").alias("n_postings"))


@query("bm25_topk", f"WITH {BM25} SELECT item_id, rank, doc_id, score FROM lex WHERE rank <= 5")
def bm25_topk(t, spark):
    return _lexical(t, 5).select("item_id", "rank", "doc_id", "score")


_UNITS = r"""n AS (SELECT doc_id, text AS full_text, length(text) AS n FROM documents),
s AS (SELECT *, unnest(CASE WHEN n <= 1200 THEN [0] ELSE range(0, greatest(1, n - 100), 600) END) AS start FROM n),
u AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS k, CASE WHEN n <= 1200 THEN full_text ELSE substr(full_text, start + 1, 700) END AS text FROM s)"""


_PARENTS = f"""{_UNITS}, w AS (SELECT doc_id, k, {_TOK} AS words FROM u), qw AS (SELECT DISTINCT item_id, unnest({_TOK}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(greatest(len(words), 1)) AS avgdl FROM w),
tf AS (SELECT doc_id, k, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, k, greatest(len(words), 1) AS dl, unnest(words) AS term FROM w) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT item_id, doc_id, k, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qw JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2, 3),
p AS (SELECT item_id, doc_id, max(score) AS score, arg_max(k, (score, -k)) AS k, count(*) - 1 AS collapsed FROM sc GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM p)"""


@query("bm25_parent_agg", f"WITH {_PARENTS} SELECT item_id, rank, doc_id, k, score, collapsed FROM r WHERE rank <= 5")
def bm25_parent_agg(t, spark):
    """Chunks are searched, their documents are ranked by the best chunk."""
    return _parents(t).select("item_id", "rank", "doc_id", "k", "score", "collapsed")


def _parents(t, k=5):
    starts, width = chunking.strides(F.col("text"))
    units = F.transform(starts, lambda s: T.tokens(F.substring("text", s + 1, width)))
    texts = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", units.alias("units"))
    return R.ranked(texts, R.tokenised(t("benchmark"), "item_id"), "doc_id", "item_id", k)


@query("expand_parent", f"""WITH {_PARENTS}, h AS (SELECT r.*, d.text, length(d.text) AS n, CASE WHEN length(d.text) <= 1200 THEN 0 ELSE 600 * k END AS s FROM r JOIN documents d USING (doc_id) WHERE rank <= 5),
m AS (SELECT *, least(n, s + 700) AS e FROM h), c AS (SELECT *, greatest(0, least(s - (1500 - (e - s)) // 2, n - 1500)) AS lo FROM m)
SELECT item_id, rank, doc_id, k, CASE WHEN n <= 1200 THEN 'full' ELSE 'window' END AS kind, CAST(CASE WHEN n <= 1200 THEN n ELSE least(1500, n) END AS BIGINT) AS n_chars, md5(CASE WHEN n <= 1200 THEN text ELSE substr(text, CAST(lo + 1 AS BIGINT), 1500) END) AS digest FROM c""")
def expand_parent(t, spark):
    """The document of each hit: whole if short, else a window around the chunk that was hit."""
    hits = _parents(t).join(t("documents").select("doc_id", "text"), "doc_id")
    n, whole = F.length("text"), F.length("text") <= 1200
    start = F.when(whole, 0).otherwise(600 * F.col("k"))
    lo, hi = chunking.window_around(start, F.least(n, start + 700), n, 1500)
    text = F.when(whole, F.col("text")).otherwise(F.substring("text", lo + 1, hi - lo))
    return hits.select("item_id", "rank", "doc_id", "k", F.when(whole, "full").otherwise("window").alias("kind"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


@query("dense_topk", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.id AS q, v.id, round(list_dot_product(q.v, v.v), 6) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM s)
SELECT q, id, score, rank FROM r WHERE rank <= 10""")
def dense_topk(t, spark):
    """Every vector whose id is divisible by 20 against all, by exact inner products in blocks."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.blocked_top_k(v, v.where("id % 20 = 0"), 10).select("q", "id", "score", "rank")


@query("dense_label_metrics", """WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.id AS q, q.label, v.label AS other, v.id, round(list_dot_product(q.v, v.v), 6) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)
SELECT label, count(DISTINCT q) AS n, round(avg(CAST(label = other AS INT)), 6) AS precision FROM r WHERE rank <= 10 GROUP BY 1""")
def dense_label_metrics(t, spark):
    e = t("embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    top = R.blocked_top_k(v, v.where("id % 20 = 0"), 10)
    named = top.join(e.select(F.col("vec_id").alias("q"), "label"), "q").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("other")), "id")
    return named.groupBy("label").agg(F.countDistinct("q").alias("n"), F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("precision"))


@query("l2_normalise", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, len(embedding) AS dim FROM embeddings")
def l2_normalise(t, spark):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return t("embeddings").select("vec_id", F.round(F.sqrt(square), 5).alias("norm"), F.size("embedding").cast("long").alias("dim"))


@query("rrf_fuse", f"""WITH {BM25}, f AS (SELECT item_id, doc_id, round(sum(f), 9) AS fused, round(sum(score), 6) AS tiebreak FROM (SELECT item_id, doc_id, 1.0 / (60 + rank) AS f, score FROM lex UNION ALL SELECT item_id, doc_id, 1.0 / (60 + rank), score FROM cvr) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, tiebreak DESC, doc_id) AS INT) AS rank FROM f) SELECT item_id, rank, doc_id, round(fused, 6) AS fused FROM r WHERE rank <= 5""")
def rrf_fuse(t, spark):
    fused = R.rrf(_both(t), "item_id", "doc_id", 60)
    return R.top_k(fused, "item_id", [F.desc("fused"), F.desc("tiebreak"), "doc_id"], 5).select("item_id", "rank", "doc_id", F.round("fused", 6).alias("fused"))


_BOUNDS = """b AS (SELECT max(score) FILTER (WHERE rn = round_even(0.01 * (n - 1), 0) + 1) AS lo, max(score) FILTER (WHERE rn = round_even(0.99 * (n - 1), 0) + 1) AS hi FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM lex))"""


def _bounds(lexical):
    """The first and the 99th percentile of the hits' scores, by rounded place, from counts of the distinct scores."""
    counts = lexical.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("score")
    placed = counts.select("score", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    place = lambda p: F.bround(F.lit(p) * (F.col("n") - 1)) + 1
    return placed.agg(F.min(F.when(F.col("upto") >= place(0.01), F.col("score"))).alias("lo"), F.min(F.when(F.col("upto") >= place(0.99), F.col("score"))).alias("hi"))


@query("winsor_bounds", f"WITH {BM25}, {_BOUNDS} SELECT lo, hi FROM b")
def winsor_bounds(t, spark):
    return _bounds(_lexical(t))


@query("convex_fuse", f"""WITH {BM25}, {_BOUNDS}, f AS (SELECT item_id, doc_id, round(sum(f), 6) AS fused FROM (
SELECT item_id, doc_id, 0.9 * CASE WHEN hi <= lo THEN 0.0 ELSE (least(greatest(score, lo), hi) - lo) / (hi - lo) END AS f FROM lex, b UNION ALL SELECT item_id, doc_id, 0.1 * (least(greatest(score, -1.0), 1.0) + 1.0) / 2.0 FROM cvr) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS INT) AS rank FROM f) SELECT item_id, rank, doc_id, fused FROM r WHERE rank <= 5""")
def convex_fuse(t, spark):
    lexical, coverage = _both(t)
    a = lexical.crossJoin(F.broadcast(_bounds(lexical))).select("item_id", "doc_id", (0.9 * R.winsor_minmax(F.col("score"), F.col("lo"), F.col("hi"))).alias("f"))  # bounds: one row
    c = coverage.select("item_id", "doc_id", (0.1 * R.winsor_minmax(F.col("score"), F.lit(-1.0), F.lit(1.0))).alias("f"))
    fused = a.unionByName(c).groupBy("item_id", "doc_id").agg(F.round(F.sum("f"), 6).alias("fused"))
    return R.top_k(fused, "item_id", [F.desc("fused"), "doc_id"], 5).select("item_id", "rank", "doc_id", "fused")


_METRIC = """m AS (SELECT g.item_id, n_gold, coalesce(any_value(n), 0) AS n, any_value(first) AS first, any_value(dcg) AS dcg FROM (SELECT item_id, count(DISTINCT doc_id) AS n_gold FROM gold GROUP BY 1) g
LEFT JOIN (SELECT item_id, count(*) AS n, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM lex JOIN gold USING (item_id, doc_id) WHERE rank <= 5 GROUP BY 1) h USING (item_id) GROUP BY 1, 2),
mm AS (SELECT item_id, CAST(n > 0 AS INT) AS hit, n / CAST(n_gold AS DOUBLE) AS recall, coalesce(1.0 / first, 0) AS mrr, coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda r: 1 / log2(r + 1))), 0) AS ndcg FROM m)"""


@query("retrieval_metrics", f"WITH {BM25}, {_METRIC} SELECT count(*) AS n, round(avg(hit), 6) AS hit5, round(avg(recall), 6) AS recall5, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg5 FROM mm")
def retrieval_metrics(t, spark):
    m = R.metrics(_lexical(t), _gold(t), "item_id", "doc_id", 5)
    return m.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(a), 6).alias(b) for a, b in (("hit", "hit5"), ("recall", "recall5"), ("mrr", "mrr"), ("ndcg", "ndcg5"))))


@query("metrics_by_lang", f"""WITH {BM25}, {_METRIC}, l AS (SELECT item_id, min(lang) AS lang FROM gold JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, count(*) AS n, round(avg(hit), 6) AS hit5, round(avg(mrr), 6) AS mrr FROM mm JOIN l USING (item_id) GROUP BY 1""")
def metrics_by_lang(t, spark):
    gold = _gold(t)
    lang = gold.join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("item_id").agg(F.min("lang").alias("lang"))
    m = R.metrics(_lexical(t), gold, "item_id", "doc_id", 5).join(lang, "item_id")
    return m.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("hit5"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query("fusion_sweep", f"""WITH {BM25}, p AS (SELECT unnest([10, 20, 60, 100]) AS k), both_ AS (SELECT item_id, doc_id, rank, score FROM lex UNION ALL SELECT item_id, doc_id, rank, score FROM cvr),
f AS (SELECT k, item_id, doc_id, round(sum(1.0 / (k + rank)), 9) AS fused, round(sum(score), 6) AS tb FROM both_, p GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY k, item_id ORDER BY fused DESC, tb DESC, doc_id) AS pos FROM f),
g AS (SELECT item_id, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT k, item_id, min(pos) AS first FROM r JOIN gold USING (item_id, doc_id) WHERE pos <= 5 GROUP BY 1, 2)
SELECT CAST(p.k AS INT) AS k, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) AS n FROM p CROSS JOIN g LEFT JOIN h ON h.k = p.k AND h.item_id = g.item_id GROUP BY 1""")
def fusion_sweep(t, spark):
    """All settings in one job: the grid is four rows beside the candidate lists."""
    lists = _lists(t).select("item_id", "doc_id", "rank", "score")
    grid = spark.createDataFrame([(k,) for k in (10, 20, 60, 100)], "k int")
    fused = lists.crossJoin(F.broadcast(grid)).groupBy("k", "item_id", "doc_id").agg(F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 9).alias("fused"), F.round(F.sum("score"), 6).alias("tb"))
    pos = F.row_number().over(Window.partitionBy("k", "item_id").orderBy(F.desc("fused"), F.desc("tb"), "doc_id"))
    gold = _gold(t)
    first = fused.withColumn("pos", pos).where("pos <= 5").join(gold, ["item_id", "doc_id"]).groupBy("k", "item_id").agg(F.min("pos").alias("first"))
    asked = gold.select("item_id").distinct().crossJoin(F.broadcast(grid))
    return asked.join(first, ["k", "item_id"], "left").groupBy("k").agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))


@query("hit_dedupe", f"""WITH {BM25}, s AS (SELECT item_id, source, min(rank) AS first FROM lex JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT item_id, source, CAST(row_number() OVER (PARTITION BY item_id ORDER BY first) AS INT) AS rank FROM s""")
def hit_dedupe(t, spark):
    """The first hit of each source, ranked anew."""
    s = _lexical(t).join(t("documents").select("doc_id", "source"), "doc_id").groupBy("item_id", "source").agg(F.min("rank").alias("first"))
    return s.select("item_id", "source", F.row_number().over(Window.partitionBy("item_id").orderBy("first")).alias("rank"))


@query("rerank_stub", f"""WITH {BM25}, j AS (SELECT item_id, doc_id, lex.rank AS coarse, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS score
FROM lex JOIN (SELECT doc_id, list_distinct({_TOK}) AS a FROM documents) USING (doc_id) JOIN (SELECT item_id, list_distinct({_TOK}) AS b FROM benchmark) USING (item_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, coarse) AS INT) AS rank FROM j) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 3""")
def rerank_stub(t, spark):
    """Coarse hits scored again by word overlap, which stands in for a model; equal scores keep their order."""
    words = lambda c: F.array_distinct(T.tokens(F.col(c)))
    pairs = _lexical(t).withColumnRenamed("rank", "coarse").drop("score").join(t("documents").select("doc_id", words("text").alias("a")), "doc_id").join(t("benchmark").select("item_id", words("text").alias("b")), "item_id")
    scored = pairs.withColumn("score", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6))
    return R.top_k(scored, "item_id", [F.desc("score"), "coarse"], 3).select("item_id", "rank", "doc_id", "score")


@query("hard_negatives", f"""WITH {BM25}, n AS (SELECT item_id, doc_id, rank FROM lex ANTI JOIN gold USING (item_id, doc_id)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rank) AS INT) AS n FROM n)
SELECT item_id, doc_id, n FROM r WHERE n <= 3""")
def hard_negatives(t, spark):
    """The best hits that aren't gold."""
    wrong = _lexical(t).join(_gold(t), ["item_id", "doc_id"], "left_anti")
    return R.top_k(wrong, "item_id", ["rank"], 3, "n").select("item_id", "doc_id", "n")


@query("recall_union", f"""WITH {BM25} SELECT item_id, doc_id, l.rank AS bm25_rank, c.rank AS cover_rank, CASE WHEN l.rank IS NULL THEN 'cover' WHEN c.rank IS NULL THEN 'bm25' ELSE 'both' END AS recall_via,
CASE WHEN least(coalesce(l.rank, 99), coalesce(c.rank, 99)) <= 4 THEN 'A' WHEN length(text) > 1200 THEN 'C' ELSE 'B' END AS bucket FROM lex l FULL JOIN cvr c USING (item_id, doc_id) JOIN documents USING (doc_id)""")
def recall_union(t, spark):
    """Both recall lists as one, with the way each came and its bucket."""
    a, c = _both(t)
    a, c = a.select("item_id", "doc_id", F.col("rank").alias("bm25_rank")), c.select("item_id", "doc_id", F.col("rank").alias("cover_rank"))
    both = a.join(c, ["item_id", "doc_id"], "full").join(t("documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    best = F.least(F.coalesce("bm25_rank", F.lit(99)), F.coalesce("cover_rank", F.lit(99)))
    via = F.when(F.col("bm25_rank").isNull(), "cover").when(F.col("cover_rank").isNull(), "bm25").otherwise("both")
    return both.select("item_id", "doc_id", "bm25_rank", "cover_rank", via.alias("recall_via"), F.when(best <= 4, "A").when(F.col("n") > 1200, "C").otherwise("B").alias("bucket"))
