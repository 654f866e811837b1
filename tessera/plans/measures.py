"""Grids over retrieval settings, rule checks on texts, rates, graphs of several families, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import graph as G
from ..operators import retrieval as R
from ..streaming import guards
from .graphs import _edges
from .registry import query
from .retrieval import _BOUNDS, _TOK, BM25, _both, _gold

_FORMS = ("text", "text || ' the'", "substr(text, 1, 60)")
_BM25_FORMS = BM25.replace("qw AS (SELECT DISTINCT item_id,", f"f AS (SELECT item_id * 10 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 10 + 1, {_FORMS[1]} FROM benchmark UNION ALL SELECT item_id * 10 + 2, {_FORMS[2]} FROM benchmark), qw AS (SELECT DISTINCT item_id,").replace(" AS term FROM benchmark)", " AS term FROM f)", 1)


@query("query_forms", f"""WITH {_BM25_FORMS}, h AS (SELECT item_id // 10 AS item_id, item_id % 10 AS form, rank, doc_id, source || '|' || substr(text, 1, 60) AS k, score FROM lex JOIN documents USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, k ORDER BY form, rank) AS rn FROM h), r AS (SELECT item_id, doc_id, form, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, form, rank) AS INT) AS rank FROM o WHERE rn = 1) SELECT item_id, CAST(form AS INT) AS form, doc_id, rank FROM r WHERE rank <= 5""")
def query_forms(t, spark):
    """Three forms of each question, searched together; the first of equal hits stays, and hits are ranked anew."""
    b = t("benchmark")
    forms = reduce(DataFrame.unionByName, [b.select((F.col("item_id") * 10 + k).alias("item_id"), F.expr(f).alias("text")) for k, f in enumerate(_FORMS)])
    texts = t("documents").select("doc_id", F.array(T.tokens(F.coalesce("text", F.lit("")))).alias("units"))
    hits = R.ranked(texts, R.tokenised(forms, "item_id"), "doc_id", "item_id", 10)
    named = hits.join(t("documents").select("doc_id", F.concat_ws("|", "source", F.substring("text", 1, 60)).alias("key")), "doc_id")
    one = named.select(F.floor(F.col("item_id") / 10).alias("item_id"), (F.col("item_id") % 10).cast("int").alias("form"), "rank", "doc_id", "key", "score")
    first = one.withColumn("rn", F.row_number().over(Window.partitionBy("item_id", "key").orderBy("form", "rank"))).where("rn = 1")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "form", "rank"))
    return first.select("item_id", "form", "doc_id", place.alias("rank")).where("rank <= 5")


_KS, _ALPHAS = (10, 20, 60, 100), tuple(k / 10 for k in range(11))
_GRID = [(0, "bm25", 0.0), (1, "coverage", 0.0), *((2 + k, "rrf", float(x)) for k, x in enumerate(_KS)), *((6 + k, "convex", x) for k, x in enumerate(_ALPHAS))]
_GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, '{b}', CAST({c} AS DOUBLE))" for a, b, c in _GRID) + ") v(ord, kind, p))"


@query("fusion_grid", f"""WITH {BM25}, {_BOUNDS}, {_GRID_SQL}, l AS (SELECT item_id, doc_id, rank AS ra, CASE WHEN hi <= lo THEN 0.0 ELSE (least(greatest(score, lo), hi) - lo) / (hi - lo) END AS sa FROM lex, b), c AS (SELECT item_id, doc_id, rank AS rb, score AS sb FROM cvr),
j AS (SELECT coalesce(l.item_id, c.item_id) AS item_id, coalesce(l.doc_id, c.doc_id) AS doc_id, ra, rb, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb FROM l FULL JOIN c ON l.item_id = c.item_id AND l.doc_id = c.doc_id),
s AS (SELECT ord, kind, p, item_id, doc_id, round(CASE kind WHEN 'bm25' THEN 1.0 / ra WHEN 'coverage' THEN 1.0 / rb WHEN 'rrf' THEN coalesce(1.0 / (p + ra), 0) + coalesce(1.0 / (p + rb), 0) ELSE p * sa + (1 - p) * sb END, 9) AS score FROM j, grid),
r AS (SELECT *, row_number() OVER (PARTITION BY ord, item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score IS NOT NULL), g AS (SELECT DISTINCT item_id FROM gold), f AS (SELECT ord, item_id, min(rank) AS first FROM r JOIN gold USING (item_id, doc_id) WHERE rank <= 5 GROUP BY 1, 2),
m AS (SELECT grid.ord, kind, p, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CAST(first IS NOT NULL AS INT)), 6) AS hit5, count(*) AS n FROM grid CROSS JOIN g LEFT JOIN f ON f.ord = grid.ord AND f.item_id = g.item_id GROUP BY 1, 2, 3)
SELECT CAST(ord AS INT) AS ord, kind, p, mrr, hit5, n, ord = (SELECT arg_min(ord, (-mrr, ord)) FROM m) AS best FROM m""")
def fusion_grid(t, spark):
    """Both lists alone, four constants of rank fusion and eleven weights, in one job; the first of the
    best settings is marked."""
    from .retrieval import _bounds

    lexical, coverage = _both(t)
    a = lexical.crossJoin(F.broadcast(_bounds(lexical))).select("item_id", "doc_id", F.col("rank").alias("ra"), R.winsor_minmax(F.col("score"), F.col("lo"), F.col("hi")).alias("sa"))
    j = a.join(coverage.select("item_id", "doc_id", F.col("rank").alias("rb"), F.col("score").alias("sb")), ["item_id", "doc_id"], "full").fillna(0.0, ["sa", "sb"])
    grid = F.broadcast(spark.createDataFrame(_GRID, "ord int, kind string, p double"))
    zero, p = F.lit(0.0), F.col("p")
    score = F.when(F.col("kind") == "bm25", 1 / F.col("ra")).when(F.col("kind") == "coverage", 1 / F.col("rb")).when(F.col("kind") == "rrf", F.coalesce(1 / (p + F.col("ra")), zero) + F.coalesce(1 / (p + F.col("rb")), zero)).otherwise(p * F.col("sa") + (1 - p) * F.col("sb"))
    s = j.crossJoin(grid).withColumn("score", F.round(score, 9)).where("score IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("ord", "item_id").orderBy(F.desc("score"), "doc_id"))
    gold = _gold(t)
    first = s.withColumn("rank", rank).where("rank <= 5").join(gold, ["item_id", "doc_id"]).groupBy("ord", "item_id").agg(F.min("rank").alias("first"))
    m = gold.select("item_id").distinct().crossJoin(grid).join(first, ["ord", "item_id"], "left").groupBy("ord", "kind", "p").agg(
        F.round(F.avg(F.coalesce(1 / F.col("first"), zero)), 6).alias("mrr"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("hit5"), F.count("*").alias("n")
    )
    best = m.agg(F.min_by("ord", F.struct(F.negative("mrr"), "ord")).alias("top"))
    return m.crossJoin(F.broadcast(best)).select("ord", "kind", "p", "mrr", "hit5", "n", (F.col("ord") == F.col("top")).alias("best"))


_SIZES = ((400, 50), (700, 100), (1000, 150))


@query("chunk_size_ab", f"""WITH z AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b})" for a, b in _SIZES)}) v(size, overlap)), n AS (SELECT size, overlap, doc_id, text AS full_text, length(text) AS n FROM documents, z),
s AS (SELECT *, unnest(CASE WHEN n <= 1200 THEN [0] ELSE range(0, greatest(1, n - overlap), size - overlap) END) AS start FROM n), u AS (SELECT size, doc_id, start, CASE WHEN n <= 1200 THEN full_text ELSE substr(full_text, start + 1, size) END AS text FROM s),
w AS (SELECT size, doc_id, start, {_TOK} AS words FROM u), qw AS (SELECT DISTINCT item_id, unnest({_TOK}) AS term FROM benchmark), st AS (SELECT size, count(*) AS n, avg(greatest(len(words), 1)) AS avgdl FROM w GROUP BY 1),
tf AS (SELECT size, doc_id, start, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT size, doc_id, start, greatest(len(words), 1) AS dl, unnest(words) AS term FROM w) GROUP BY 1, 2, 3, 4), df AS (SELECT size, term, count(*) AS df FROM tf GROUP BY 1, 2),
sc AS (SELECT size, item_id, doc_id, start, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qw JOIN tf USING (term) JOIN df USING (size, term) JOIN st USING (size) GROUP BY 1, 2, 3, 4),
p AS (SELECT size, item_id, doc_id, max(score) AS score FROM sc GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY size, item_id ORDER BY score DESC, doc_id) AS rank FROM p), gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT size, item_id, min(rank) AS first FROM r JOIN gold USING (item_id, doc_id) WHERE rank <= 5 GROUP BY 1, 2), g AS (SELECT DISTINCT item_id FROM gold)
SELECT CAST(z.size AS INT) AS size, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) AS n FROM z CROSS JOIN g LEFT JOIN f ON f.size = z.size AND f.item_id = g.item_id GROUP BY 1""")
def chunk_size_ab(t, spark):
    """The same questions on chunks of three sizes."""
    gold, asked, out = _gold(t), R.tokenised(t("benchmark"), "item_id"), []
    for size, overlap in _SIZES:
        starts, width = chunking.strides(F.col("text"), size, overlap)
        texts = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.transform(starts, lambda s: T.tokens(F.substring("text", s + 1, width))).alias("units"))  # noqa: B023
        m = R.metrics(R.ranked(texts, asked, "doc_id", "item_id", 5), gold, "item_id", "doc_id", 5)
        out.append(m.agg(F.lit(size).alias("size"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, out)


_PLAN = "'依据 GB 5000' || (p_size % 4) || '-2010 第 3.' || (p_size % 3) || ' 条，JGJ 59-2011 与建质〔2009〕' || (80 + p_size % 10) || '号；' || CASE WHEN p_size % 2 = 0 THEN '基坑 支护 监测' ELSE '吊装 起重' END || CASE WHEN p_size > 30 THEN ' 应急预案' ELSE '' END"
_REF = r"[A-Za-z]+(?:/[A-Za-z]+)? *[0-9][0-9 -]{2,}[0-9]{3,4}"
#: Fixed values of the checks: withdrawn standards, standards with withdrawn clauses, what a kind of work must have.
_WITHDRAWN, _CLAUSES = ("GB50001-2010",), {"GB50002-2010": ("3.1", "3.2"), "JGJ59-2011": ("9.9",)}
_MUST = {"pit": (("基坑", "开挖"), ("监测", "降水")), "lift": (("吊装", "起重"), ("指挥", "警戒"))}
_CHECKS = f"""x AS (SELECT p_partkey, {_PLAN} AS text FROM part), r AS (SELECT p_partkey, text, unnest(list_distinct(regexp_extract_all(text, '{_REF}'))) AS raw FROM x), n AS (SELECT *, upper(replace(raw, ' ', '')) AS norm FROM r),
w AS (SELECT *, regexp_extract_all(substr(text, CAST(greatest(1, strpos(upper(text), upper(raw)) - 40) AS BIGINT), CAST(strpos(upper(text), upper(raw)) - greatest(1, strpos(upper(text), upper(raw)) - 40) + length(raw) + 60 AS BIGINT)), '第 *([0-9]+(?:\\.[0-9]+)*) *条', 1) AS cited FROM n),
c1 AS (SELECT p_partkey, 'C1' AS chk, CASE WHEN norm = 'GB50001-2010' THEN 'HIGH' WHEN norm = 'GB50002-2010' AND len(list_intersect(cited, ['3.1', '3.2'])) > 0 OR norm = 'JGJ59-2011' AND list_contains(cited, '9.9') THEN 'HIGH' ELSE 'LOW' END AS severity, raw AS what FROM w WHERE norm IN ('GB50001-2010', 'GB50002-2010', 'JGJ59-2011')
 UNION ALL SELECT p_partkey, 'C1', 'HIGH', '建质〔2009〕87号' FROM x WHERE contains(text, '建质〔2009〕87号')),
c2 AS (SELECT p_partkey, 'C2' AS chk, 'MEDIUM' AS severity, must AS what FROM x, (VALUES ('基坑', '开挖', '监测'), ('基坑', '开挖', '降水'), ('吊装', '起重', '指挥'), ('吊装', '起重', '警戒')) v(a, b, must) WHERE (contains(text, a) OR contains(text, b)) AND NOT contains(text, must)),
c4 AS (SELECT p_partkey, 'C4' AS chk, 'MEDIUM' AS severity, ch AS what FROM x, (VALUES ('应急'), ('依据')) v(ch) WHERE NOT contains(text, ch)), a AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c4)"""


def _plans(t):
    p = F.col("p_size")
    kind = F.when(p % 2 == 0, "基坑 支护 监测").otherwise("吊装 起重")
    text = F.concat(F.lit("依据 GB 5000"), (p % 4).cast("string"), F.lit("-2010 第 3."), (p % 3).cast("string"), F.lit(" 条，JGJ 59-2011 与建质〔2009〕"), (80 + p % 10).cast("string"), F.lit("号；"), kind, F.when(p > 30, " 应急预案").otherwise(""))
    return t("part").select("p_partkey", text.alias("text"))


def _c1(x):
    """References to withdrawn standards, to withdrawn clauses cited near them, or to standards that have some."""
    r = x.select("p_partkey", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_REF), F.lit(0)))).alias("raw")).withColumn("norm", F.upper(F.replace("raw", F.lit(" "), F.lit(""))))
    at = F.instr(F.upper("text"), F.upper("raw"))
    start = F.greatest(F.lit(1), at - 40)
    cited = F.regexp_extract_all(F.substring("text", start, at - start + F.length("raw") + 60), F.lit(r"第 *([0-9]+(?:\.[0-9]+)*) *条"), F.lit(1))
    known = [*_WITHDRAWN, *_CLAUSES]
    hit = reduce(lambda a, b: a | b, [(F.col("norm") == s) & F.arrays_overlap(cited, F.array(*map(F.lit, own))) for s, own in _CLAUSES.items()])
    severity = F.when(F.col("norm").isin(*_WITHDRAWN) | hit, "HIGH").otherwise("LOW")
    found = r.where(F.col("norm").isin(*known)).select("p_partkey", F.lit("C1").alias("chk"), severity.alias("severity"), F.col("raw").alias("what"))
    notice = "建质〔2009〕87号"
    return found.unionByName(x.where(F.contains("text", F.lit(notice))).select("p_partkey", F.lit("C1").alias("chk"), F.lit("HIGH").alias("severity"), F.lit(notice).alias("what")))


def _missing(x, chk, wanted):
    """wanted: (condition, word) pairs; a row for each word that a text lacks where the condition holds."""
    lacks = F.filter(F.array(*(F.when(c & ~F.contains("text", F.lit(w)), w) for c, w in wanted)), lambda v: v.isNotNull())
    return x.select("p_partkey", F.lit(chk).alias("chk"), F.lit("MEDIUM").alias("severity"), F.explode(lacks).alias("what"))


@query("withdrawn_refs", f"WITH {_CHECKS} SELECT p_partkey, severity, what FROM c1")
def withdrawn_refs(t, spark):
    return _c1(_plans(t)).drop("chk")


@query("missing_contents", f"WITH {_CHECKS} SELECT p_partkey, what FROM c2")
def missing_contents(t, spark):
    """What the kinds of work that a text speaks of must have, and it lacks."""
    return _c2(_plans(t)).select("p_partkey", "what")


def _c2(x):
    has = lambda words: reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in words])
    return _missing(x, "C2", [(has(words), must) for words, musts in _MUST.values() for must in musts])


@query("run_checks", f"WITH {_CHECKS} SELECT p_partkey, chk, severity, what, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, chk, what) AS INT) AS place FROM a")
def run_checks(t, spark):
    """All checks of a text, the gravest findings first."""
    x = _plans(t)
    a = _c1(x).unionByName(_c2(x)).unionByName(_missing(x, "C4", [(F.lit(True), "应急"), (F.lit(True), "依据")]))
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return a.withColumn("place", F.row_number().over(Window.partitionBy("p_partkey").orderBy(rank, "chk", "what")))


#: Category, metric, precondition, hazardous from, super from: fixed values. 0.1 means hazardous by itself.
_LEVELS = [("R", "ECONOMY", 0, 3.0, 5.0), ("R", "STANDARD", 0, 0.1, 40.0), ("A", "PROMO", 1, 10.0, None), ("A", "PROMO", 0, 30.0, 45.0), ("N", "", 0, None, 20.0)]
_LEVELS_SQL = "lv AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {'NULL' if d is None else d}, {'NULL' if e is None else e})" for a, b, c, d, e in _LEVELS) + ") v(cat, metric, pre, h, s))"


@query("hazard_levels", f"""WITH {_LEVELS_SQL}, l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity AS q, p_type, l_tax > 0.04 AS pre FROM lineitem JOIN part ON p_partkey = l_partkey),
j AS (SELECT l.*, lv.* EXCLUDE (pre), row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, q ORDER BY lv.pre DESC) AS rn FROM l LEFT JOIN lv ON cat = l_returnflag AND starts_with(p_type, metric) AND (lv.pre = 0 OR l.pre))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN cat IS NULL THEN 'unknown' WHEN s IS NOT NULL AND q >= s THEN 'super' WHEN h = 0.1 THEN 'hazardous' WHEN h IS NOT NULL AND q >= h THEN 'hazardous' ELSE 'none' END AS level FROM j WHERE rn = 1""")
def hazard_levels(t, spark):
    """Values against thresholds; where a precondition holds its row goes first, else the plain one."""
    lv = spark.createDataFrame(_LEVELS, "cat string, metric string, pre int, h double, s double")
    l = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").withColumn("holds", F.col("l_tax") > 0.04)
    rules = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, (n, k) in zip(row, (("cat", "string"), ("metric", "string"), ("pre", "int"), ("h", "double"), ("s", "double")), strict=True))) for row in sorted(_LEVELS, key=lambda r: -r[2])))
    rule = F.get(F.filter(rules, lambda r: (r["cat"] == F.col("l_returnflag")) & F.startswith(F.col("p_type"), r["metric"]) & ((r["pre"] == 0) | F.col("holds"))), F.lit(0))
    q = F.col("l_quantity")
    level = F.when(rule.isNull(), "unknown").when(q >= rule["s"], "super").when((rule["h"] == 0.1) | (q >= rule["h"]), "hazardous").otherwise("none")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", level.alias("level"))


_ROUTES = (("review", ("heit", "ung"), "ner,rules", "C1,C2"), ("graph", ("que", "los"), "graph", ""), ("search", ("the", "tion"), "rag", "C4"))


@query("intent_plan", "WITH q AS (SELECT conv_id, turn, lower(text) AS q FROM conversations), r AS (SELECT *, CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws, _, _ in _ROUTES) + " ELSE 'chat' END AS route FROM q) SELECT conv_id, turn, route, CASE route " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, _, a, _ in _ROUTES) + " ELSE 'chat' END AS agents, CASE route " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, _, _, c in _ROUTES) + " ELSE '' END AS checks, array_to_string(list_filter(['der', 'the', 'que'], lambda w: contains(q, w)), ',') AS scope FROM r")
def intent_plan(t, spark):
    """The first route whose words a question has, with its agents and checks, and the scope's words."""
    q = F.lower("text")
    hit = lambda ws: reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in ws])
    pick = lambda k, other: reduce(lambda c, r: c.when(hit(r[1]), r[k]), _ROUTES, F.when(F.lit(False), "")).otherwise(other)
    scope = F.array_join(F.filter(F.array(*map(F.lit, ("der", "the", "que"))), lambda w: F.contains(q, w)), ",")
    return t("conversations").select("conv_id", "turn", pick(0, "chat").alias("route"), pick(2, "chat").alias("agents"), pick(3, "").alias("checks"), scope.alias("scope"))


@query("risk_matches", """WITH g AS (SELECT DISTINCT o_orderkey AS k, upper(replace(split_part(o_orderpriority, '-', 2), ' ', '')) AS frag, o_orderstatus AS chk FROM orders), p AS (SELECT DISTINCT l_orderkey AS k, upper(replace('not ' || CASE WHEN l_quantity > 30 THEN 'spec ified' WHEN l_quantity > 10 THEN 'HIGH' ELSE 'low' END, ' ', '')) AS detail FROM lineitem),
m AS (SELECT g.k, chk, frag, bool_or(coalesce(contains(detail, frag), FALSE)) AS found FROM g LEFT JOIN p USING (k) GROUP BY 1, 2, 3) SELECT chk, count(*) AS golden, count(*) FILTER (WHERE NOT found) AS missed, round(count(*) FILTER (WHERE NOT found) / CAST(count(*) AS DOUBLE), 6) AS fnr FROM m GROUP BY 1""")
def risk_matches(t, spark):
    """Expected findings that some reported one holds, whatever case and blanks, by check."""
    plain = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("")))
    g = t("orders").select(F.col("o_orderkey").alias("k"), plain(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("frag"), F.col("o_orderstatus").alias("chk")).distinct()
    said = F.when(F.col("l_quantity") > 30, "spec ified").when(F.col("l_quantity") > 10, "HIGH").otherwise("low")
    p = t("lineitem").select(F.col("l_orderkey").alias("k"), plain(F.concat(F.lit("not "), said)).alias("detail")).distinct()
    m = g.join(p, "k", "left").groupBy("k", "chk", "frag").agg(F.bool_or(F.coalesce(F.contains("detail", "frag"), F.lit(False))).alias("found"))
    return m.groupBy("chk").agg(F.count("*").alias("golden"), F.count_if(~F.col("found")).alias("missed"), F.round(F.count_if(~F.col("found")) / F.count("*"), 6).alias("fnr"))


@query("rerank_scores", """WITH s AS (SELECT l_orderkey AS q, l_partkey, l_extendedprice AS x, l_returnflag = 'R' AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rn FROM lineitem),
g AS (SELECT q, min(rn) FILTER (WHERE pos) AS first, max(x) FILTER (WHERE pos) - max(x) FILTER (WHERE NOT pos) AS gap FROM s GROUP BY 1) SELECT count(*) AS n, round(avg(CAST(first = 1 AS INT)), 6) AS hit1, round(avg(1.0 / first), 6) AS mrr, round(avg(gap), 4) AS margin, round(avg(1 / (1 + exp(-gap / 2000))), 6) AS preferred FROM g WHERE first IS NOT NULL AND gap IS NOT NULL""")
def rerank_scores(t, spark):
    """Of questions with both sorts: whether a positive is first, its rank, and its lead over the best negative."""
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber"))
    s = t("lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_extendedprice").alias("x"), (F.col("l_returnflag") == "R").alias("pos"), rn.alias("rn"))
    best = lambda c, v: F.max(F.when(c, v))
    g = s.groupBy("q").agg(F.min(F.when(F.col("pos"), F.col("rn"))).alias("first"), (best(F.col("pos"), F.col("x")) - best(~F.col("pos"), F.col("x"))).alias("gap")).dropna()
    return g.agg(F.count("*").alias("n"), F.round(F.avg((F.col("first") == 1).cast("int")), 6).alias("hit1"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.round(F.avg("gap"), 4).alias("margin"), F.round(F.avg(1 / (1 + F.exp(-F.col("gap") / 2000))), 6).alias("preferred"))


@query("violation_scores", """WITH p AS (SELECT toxic, CASE n_chars % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE END AS pred FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND pred) AS tp, count(*) FILTER (WHERE toxic = 0 AND pred IS NOT TRUE) AS tn, count(*) FILTER (WHERE toxic = 0 AND pred) AS fp, count(*) FILTER (WHERE toxic = 1 AND pred IS NOT TRUE) AS fn FROM p)
SELECT *, round(fn / CAST(greatest(1, tp + fn) AS DOUBLE), 6) AS miss, round(tp / CAST(greatest(1, tp + fp) AS DOUBLE), 6) AS prec, round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM c""")
def violation_scores(t, spark):
    """Counts and rates; no prediction counts as "no violation"."""
    n = F.col("n_chars") % 4
    p = t("labels").join(t("documents").select("doc_id", F.when(n == 0, True).when(n < 3, False).alias("pred")), "doc_id")
    y, yes = F.col("toxic") == 1, F.coalesce("pred", F.lit(False))
    c = p.agg(F.count_if(y & yes).alias("tp"), F.count_if(~y & ~yes).alias("tn"), F.count_if(~y & yes).alias("fp"), F.count_if(y & ~yes).alias("fn"))
    rate = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 6)
    tp, fp, fn = (F.col(k) for k in ("tp", "fp", "fn"))
    return c.select("*", rate(fn, tp + fn).alias("miss"), rate(tp, tp + fp).alias("prec"), rate(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


@query("graph_families", """WITH b AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation), r AS (SELECT DISTINCT x.p_size AS a, y.p_size AS b FROM part x JOIN part y ON starts_with(CAST(y.p_size AS VARCHAR), CAST(x.p_size AS VARCHAR)) AND x.p_size <> y.p_size), c AS (SELECT DISTINCT p_type AS a, l_suppkey AS b FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT doc_id AS a, term AS b FROM documents, (VALUES ('the'), ('und'), ('que')) v(term) WHERE contains(text, term)), g AS (SELECT s_nationkey AS a, p_brand AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 5), h AS (SELECT DISTINCT s_suppkey AS a, n_regionkey AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 'BELONGS_TO' AS family, count(*) AS n FROM b UNION ALL SELECT 'REFERENCES', count(*) FROM r UNION ALL SELECT 'COVERS', count(*) FROM c UNION ALL SELECT 'MENTIONS', count(*) FROM m UNION ALL SELECT 'REGULATED_BY', count(*) FROM g UNION ALL SELECT 'HIERARCHY', count(*) FROM h""")
def graph_families(t, spark):
    """Six families of edges: by key, by codes' prefixes, by pairs, by words in texts, by frequent pairs, by two steps."""
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    l = t("lineitem").select("l_partkey", "l_suppkey").join(part, "l_partkey")
    sizes = t("part").select(F.col("p_size").cast("string").alias("code")).distinct()
    pre = sizes.where("length(code) > 1").select(F.col("code").alias("b"), F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda i: F.col("code").substr(F.lit(1), i))).alias("code")).join(sizes, "code")
    words = F.filter(F.array(*map(F.lit, ("the", "und", "que"))), lambda w: F.contains("text", w))
    home = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    often = l.join(home, "l_suppkey").groupBy("n_nationkey", "p_brand").agg(F.countDistinct("l_partkey").alias("n")).where("n >= 5")
    families = {
        "BELONGS_TO": t("nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")),
        "REFERENCES": pre.select(F.col("code").alias("a"), "b").distinct(),
        "COVERS": l.select(F.col("p_type").alias("a"), F.col("l_suppkey").alias("b")).distinct(),
        "MENTIONS": t("documents").select(F.col("doc_id").alias("a"), F.explode(words).alias("b")),
        "REGULATED_BY": often.select(F.col("n_nationkey").alias("a"), F.col("p_brand").alias("b")),
        "HIERARCHY": home.join(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey").select(F.col("l_suppkey").alias("a"), F.col("n_regionkey").alias("b")).distinct(),
    }
    every = reduce(DataFrame.union, [df.select(F.lit(name).alias("family"), F.col("a").cast("string"), F.col("b").cast("string")) for name, df in families.items()])
    return every.groupBy("family").agg(F.count("*").alias("n"))


@query("valid_edges", "WITH e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders), v AS (SELECT 'o' || o_orderkey AS id FROM orders UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal >= 0) SELECT count(*) AS n FROM (SELECT DISTINCT src, dst FROM e) WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def valid_edges(t, spark):
    """Edges of which both ends are nodes, each once."""
    e = _edges(t).where("type = 'PLACED_BY'")
    nodes = e.select(F.col("src").alias("id")).union(t("customer").where("c_acctbal >= 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    return G.valid_graph(nodes, e)[1].agg(F.count("*").alias("n"))


@query("answer_stream", "SELECT conv_id * 1000 + turn AS conv_id, md5(text) AS digest FROM conversations WHERE turn % 2 = 0 AND length(text) > 0")
def answer_stream(t, spark):
    """Answers as JSON in pieces of seven characters, read back piece by piece. Turns of the other sort
    are thoughts, and nothing of them gets out."""
    kind = F.when(F.col("turn") % 2 == 0, "answer").otherwise("search")
    escaped = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    whole = F.concat(F.lit('{"thought": "x", "action": "'), kind, F.lit('", "action_input": "'), escaped, F.lit('"}'))
    places = F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / 7))
    c = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), whole.alias("whole")).select("conv_id", "whole", F.explode(places).alias("n"))
    got = guards.answer_text(c.select("conv_id", "n", F.col("whole").substr(F.col("n") * 7 + 1, F.lit(7)).alias("piece")))
    return got.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "")).alias("digest"))
