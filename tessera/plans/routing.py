"""Queries that take questions apart, route them, and sort candidates and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as O
from .labels import _SPANS, _spans
from .registry import query
from .retrieval import BM25, _both, _gold

_PIECES = (
    ("塔吊吊装", "基坑开挖", "", "高支模", "履带吊 吊装钢梁", "JGJ130 说什么", "网架"),
    ("有哪些风险", "管控清单", "", "验收节点和编制内容", "隐患"),
    ("，12t", "，99.9 kN", "，8吨", "", "，10.3 t", "，100KN"),
    ("要不要专家论证", "编制依据废止了吗", "请全面检查", "", "缺项", "工艺做法", "", ""),
)
_STEPS = (1, 3, 7, 5)
_QUESTION_SQL = " || ".join(f"{list(p)}[CAST((conv_id * {k} + turn * {k + 2}) % {len(p)} AS INT) + 1]" for p, k in zip(_PIECES, _STEPS, strict=True))


def _questions(t):
    pick = lambda p, k: F.element_at(F.array(*map(F.lit, p)), ((F.col("conv_id") * k + F.col("turn") * (k + 2)) % len(p) + 1).cast("int"))
    return t("conversations").select("conv_id", "turn", F.concat(*(pick(p, k) for p, k in zip(_PIECES, _STEPS, strict=True))).alias("q"))


def _any(words):
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def _first(words):
    return "CASE " + " ".join(f"WHEN contains(q, '{w}') THEN '{w}'" for w in words) + " END"


_APART = f"""q AS (SELECT conv_id, turn, trim({_QUESTION_SQL}) AS q FROM conversations),
a AS (SELECT *, CASE {" ".join(f"WHEN contains(q, '{w}') THEN '{kind}'" for w, kind in O.work_words())} END AS category, {_first(O.OBJECTS)} AS subject, {_first(O.EQUIPMENT)} AS equipment, {", ".join(f"{_any(ws)} AS d_{n}" for n, ws in O.DIMENSIONS.items())},
 regexp_extract(q, '{O.CAPACITY}', 1) AS num, regexp_extract(q, '{O.CAPACITY}', 2) AS un FROM q),
b AS (SELECT *, NOT (d_risks OR d_plan OR d_controls OR d_acceptance) AND category IS NOT NULL AS every, CASE WHEN num <> '' THEN CAST(num AS DOUBLE) END AS capacity, CASE WHEN num <> '' THEN un END AS unit FROM a),
c AS (SELECT conv_id, turn, q, category, subject, equipment, capacity, unit, d_risks OR every AS risks, d_plan OR every AS plan, d_controls OR every AS controls, d_acceptance OR every AS acceptance,
 coalesce(category = '起重吊装' AND CASE WHEN unit IN ('t', '吨') THEN capacity * 9.8 ELSE capacity END >= 100, FALSE) AS super_scale FROM b),
d AS (SELECT *, CAST(risks AS INT) + CAST(plan AS INT) + CAST(controls AS INT) + CAST(acceptance AS INT) >= CASE WHEN category IS NULL THEN 2 ELSE 1 END AS structured FROM c)"""


@query("question_parts", f"WITH {_APART} SELECT conv_id, turn, category, subject, equipment, capacity, unit, risks, plan, controls, acceptance, super_scale, structured FROM d")
def question_parts(t, spark):
    """Questions as slots: kind of work, object, equipment, load, dimensions."""
    return _questions(t).select("conv_id", "turn", *(c.alias(name) for name, c in O.taken_apart(F.col("q")).items()))


@query("question_routes", f"""WITH {_APART}, e AS (SELECT *, CASE WHEN q = '' THEN 'review' WHEN {_any(O.INTENTS["hazard_level"])} THEN 'hazard_level' WHEN structured THEN 'structured' {" ".join(f"WHEN {_any(O.INTENTS[n])} THEN '{n}'" for n in ("review", "basis", "elements", "technical"))} ELSE 'technical' END AS words FROM d),
f AS (SELECT *, CASE WHEN turn % 2 = 0 OR words = 'structured' THEN words ELSE 'qa' END AS intent FROM e)
SELECT conv_id, turn, intent, CASE intent {" ".join(f"WHEN '{n}' THEN '{a}'" for n, (a, _) in O.SENT_TO.items())} END AS agents, CASE intent {" ".join(f"WHEN '{n}' THEN '{c}'" for n, (_, c) in O.SENT_TO.items())} END AS checks FROM f""")
def question_routes(t, spark):
    """Each question's intent and where it goes; every second one comes with a plan."""
    return _questions(t).select("conv_id", "turn", *(c.alias(name) for name, c in O.intent(F.col("q"), F.col("turn") % 2 == 0).items()))


@query("label_conflicts", f"""WITH {_SPANS}, r AS (SELECT DISTINCT g, type, s, e FROM s WHERE who = 'gold'), m AS (SELECT DISTINCT g, type, s, e FROM s WHERE who = 'model'),
o AS (SELECT r.g, r.type, r.s, r.e, coalesce(bool_or(m.s < r.e AND r.s < m.e), FALSE) AS o, coalesce(bool_or(m.s < r.e AND r.s < m.e AND m.type = r.type), FALSE) AS t, coalesce(bool_or(m.s < r.e AND r.s < m.e AND m.type = r.type AND m.s = r.s AND m.e = r.e), FALSE) AS x FROM r LEFT JOIN m USING (g) GROUP BY ALL),
a AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE o AND NOT t) AS retyped, count(*) FILTER (WHERE NOT o) AS removed, count(*) FILTER (WHERE t AND NOT x) AS fixed FROM o GROUP BY 1),
b AS (SELECT g, count(*) FILTER (WHERE NOT o) AS added FROM (SELECT m.g, m.type, m.s, m.e, coalesce(bool_or(m.s < r.e AND r.s < m.e), FALSE) AS o FROM m LEFT JOIN r USING (g) GROUP BY ALL) GROUP BY 1),
j AS (SELECT coalesce(a.g, b.g) AS g, coalesce(n, 0) AS n, coalesce(retyped, 0) AS retyped, coalesce(removed, 0) AS removed, coalesce(fixed, 0) AS fixed, coalesce(added, 0) AS added FROM a FULL JOIN b USING (g))
SELECT g, retyped, removed, fixed, added, CASE WHEN removed = n AND n > 0 AND added = 0 THEN 'drop' WHEN retyped + removed + fixed + added > 0 THEN 'fix' ELSE 'keep' END AS verdict FROM j""")
def label_conflicts(t, spark):
    """Labels of rules against those of a model, by overlap of their spans, and what becomes of the text."""
    s = _spans(t)
    return O.label_conflicts(s.where("who = 'gold'"), s.where("who = 'model'"), "g")


@query("bucket_routing", f"""WITH {BM25}, pos AS (SELECT item_id, source AS pos_source FROM (SELECT item_id, min(doc_id) AS doc_id FROM gold GROUP BY 1) JOIN documents USING (doc_id)),
u AS (SELECT item_id, doc_id, l.rank AS bm25_rank, c.rank AS cover_rank FROM lex l FULL JOIN cvr c USING (item_id, doc_id)),
x AS (SELECT item_id, doc_id, least(coalesce(bm25_rank, cover_rank), coalesce(cover_rank, bm25_rank)) AS best_rank, CASE WHEN bm25_rank IS NULL THEN 'cover' WHEN cover_rank IS NULL THEN 'bm25' ELSE 'both' END AS recall_via, source = pos_source AS same_source, length(text) AS n FROM u JOIN pos USING (item_id) JOIN documents USING (doc_id))
SELECT item_id, doc_id, best_rank, recall_via, CASE WHEN n > 1200 THEN 'C' WHEN same_source THEN 'A' ELSE 'B' END AS bucket FROM x WHERE same_source OR best_rank BETWEEN 5 AND 20""")
def bucket_routing(t, spark):
    """Candidates of the passage's own source, and others from the fifth place on; long ones apart, the rest dropped."""
    a, c = _both(t)
    docs = t("documents").select("doc_id", "source", F.length("text").alias("n"))
    pos = _gold(t).groupBy("item_id").agg(F.min("doc_id").alias("doc_id")).join(docs, "doc_id").select("item_id", F.col("source").alias("pos_source"))
    u = a.select("item_id", "doc_id", F.col("rank").alias("x")).join(c.select("item_id", "doc_id", F.col("rank").alias("y")), ["item_id", "doc_id"], "full")
    via = F.when(F.col("x").isNull(), "cover").when(F.col("y").isNull(), "bm25").otherwise("both")
    j = u.join(pos, "item_id").join(docs, "doc_id").withColumns({"best_rank": F.least("x", "y"), "recall_via": via, "same": F.col("source") == F.col("pos_source")})
    bucket = F.when(F.col("n") > 1200, "C").when(F.col("same"), "A").otherwise("B")
    return j.where(F.col("same") | F.col("best_rank").between(5, 20)).select("item_id", "doc_id", "best_rank", "recall_via", bucket.alias("bucket"))
