"""Queries that judge: confident rows, labellings compared, lists of entities, candidates by bucket, scores of clauses,
contents pages, frames of sections, exported reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import reports as O
from ..operators import retrieval as R
from ..operators import verdicts as V
from ..sources import files
from ..sources.tables import stored
from .registry import query
from .retrieval import _TOK, BM25, _both, _gold

_SPAN, _OTHER, _CUT, _NEGATIVES, _LONG = 0.02, 0.45, 10, 0.25, 16
_NUMBER = "CAST('0x' || substr(md5({0}), 1, 4) AS BIGINT) / CAST(65535 AS DOUBLE)"


@query("confident_rows", f"""WITH x AS (SELECT doc_id, n_chars % 7 <> 0 AS agrees, n_chars % 1000 AS score, list_transform(coalesce({_TOK}, []), lambda w: {{'e': length(w) >= {_LONG}, 'm': {_NUMBER.format("w")}}}) AS z FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) - 1 AS i, count(*) OVER () AS n FROM x), c AS (SELECT score AS cut FROM o WHERE i = greatest(0, least(n - 1, floor(n * {_CUT} / 100)))),
y AS (SELECT doc_id, z, score, agrees, list_sort(list_transform(list_filter(z, lambda p: NOT p.e), lambda p: p.m)) AS o FROM x),
g AS (SELECT doc_id, coalesce(list_min(list_transform(z, lambda p: p.m)), 0) AS least, CASE WHEN score < cut THEN 'score' WHEN NOT agrees THEN 'differs' WHEN len(list_filter(z, lambda p: p.e AND p.m < {_SPAN})) > 0 THEN 'span' WHEN o[len(o) // 2 + 1] < {_OTHER} THEN 'other' WHEN len(o) < len(z) THEN 'kept' ELSE 'spare' END AS gate FROM y, c),
s AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS rn FROM g WHERE gate = 'spare'), k AS (SELECT floor(count(*) * CAST({_NEGATIVES} AS DOUBLE)) AS most FROM g WHERE gate = 'kept')
SELECT g.doc_id, CASE WHEN rn <= most THEN 'negative' ELSE gate END AS gate, round(least, 4) AS min_margin FROM g LEFT JOIN s USING (doc_id), k""")
def confident_rows(t, spark):
    """The gate that each text stops at: long words are its entities, hashes of words their margins."""
    words = F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>"))
    margin = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("long") / F.lit(65535.0)
    rows = t("documents").select("doc_id", (F.col("n_chars") % 7 != 0).alias("agrees"), (F.col("n_chars") % 1000).alias("score"), words.alias("w"))
    rows = rows.select("doc_id", "agrees", "score", F.transform("w", lambda w: F.when(F.length(w) >= _LONG, "B-W").otherwise("O")).alias("tags"), F.transform("w", margin).alias("margins"))
    return V.gates(rows, "doc_id", span_margin=_SPAN, other_margin=_OTHER, percentile=_CUT, negatives=_NEGATIVES)


_SIDES = """s AS (SELECT l_orderkey AS g, l_returnflag AS type, CAST(l_suppkey % 40 * 5 AS INT) AS s, CAST(l_suppkey % 40 * 5 + l_quantity AS INT) AS e, l_partkey AS p FROM lineitem),
r AS (SELECT DISTINCT g, type, s, e FROM s WHERE p % 3 <> 0), m AS (SELECT DISTINCT g, CASE WHEN p % 7 = 0 THEN 'X' ELSE type END AS type, CASE WHEN p % 11 = 0 THEN s + 3 ELSE s END AS s, CASE WHEN p % 11 = 0 THEN e + 3 ELSE e END AS e FROM s WHERE p % 5 <> 0 AND g % 4 <> 0 AND (p % 3 <> 0 OR g % 2 = 0)),
f AS (SELECT g, type, s, e, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.g = r.g AND m.type = r.type AND m.s = r.s AND m.e = r.e AND m.s < m.e) THEN 'same' WHEN EXISTS (SELECT 1 FROM m WHERE m.g = r.g AND m.type = r.type AND m.s < r.e AND r.s < m.e) THEN 'fix'
 WHEN EXISTS (SELECT 1 FROM m WHERE m.g = r.g AND m.s < r.e AND r.s < m.e) THEN 'type' ELSE 'removed' END AS state FROM r UNION ALL SELECT g, type, s, e, 'added' FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE m.g = r.g AND m.s < r.e AND r.s < m.e)),
n AS (SELECT g, count(*) FILTER (WHERE state = 'same') AS same, count(*) FILTER (WHERE state = 'fix') AS fixes, count(*) FILTER (WHERE state = 'type') AS type, count(*) FILTER (WHERE state = 'removed') AS removed, count(*) FILTER (WHERE state = 'added') AS added FROM f GROUP BY 1),
v AS (SELECT *, CASE WHEN removed > 0 AND same + fixes + type + added = 0 THEN 'drop' WHEN fixes + type + removed + added > 0 THEN 'fix' ELSE 'keep' END AS verdict FROM n)"""


def _sides(t):
    s = (F.col("l_suppkey") % 40 * 5).cast("int")
    every = t("lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("type"), s.alias("s"), (s + F.col("l_quantity")).cast("int").alias("e"), F.col("l_partkey").alias("p"))
    moved = F.when(F.col("p") % 11 == 0, 3).otherwise(0)
    model = every.where("p % 5 <> 0 AND g % 4 <> 0 AND (p % 3 <> 0 OR g % 2 = 0)").select("g", F.when(F.col("p") % 7 == 0, "X").otherwise(F.col("type")).alias("type"), (F.col("s") + moved).alias("s"), (F.col("e") + moved).alias("e"))
    return every.where("p % 3 <> 0").drop("p"), model


@query("span_verdicts", f"WITH {_SIDES} SELECT * FROM v")
def span_verdicts(t, spark):
    """Two labellings of each order compared: kept, mended, retyped, removed and added spans, and the verdict."""
    return V.verdicts(V.compare_labellings(*_sides(t), "g"), "g")


@query("silver_spans", f"WITH {_SIDES} SELECT r.g, r.type, s, e, verdict FROM r JOIN v ON v.g = r.g AND verdict = 'keep' UNION ALL SELECT m.g, m.type, s, e, verdict FROM m JOIN v ON v.g = m.g AND verdict = 'fix'")
def silver_spans(t, spark):
    """The spans that the verdicts leave."""
    rule, model = _sides(t)
    return V.applied(rule, model, V.verdicts(V.compare_labellings(rule, model, "g"), "g"), "g")


@query("entity_lists", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent FROM documents),
e AS (SELECT doc_id, sent, line, unnest(regexp_extract_all(line, '[A-Z][a-z]+|[0-9]+')) AS ent, generate_subscripts(regexp_extract_all(line, '[A-Z][a-z]+|[0-9]+'), 1) - 1 AS pos FROM s),
m AS (SELECT *, CASE WHEN regexp_matches(ent, '^[0-9]') THEN 'number' ELSE 'name' END AS type, CASE WHEN regexp_matches(ent, '^[0-9]') THEN 'rule' WHEN pos = 0 THEN 'dict' ELSE 'model' END AS layer FROM e),
a AS (SELECT doc_id, type, ent, count(*) AS n, arg_min(layer, (sent, pos)) AS layer, min(sent) AS first_sent FROM m GROUP BY 1, 2, 3), d AS (SELECT doc_id, type, ent, line, min((sent, pos)) AS spot FROM m GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, ent ORDER BY spot) AS rn FROM d), c AS (SELECT doc_id, type, ent, string_agg(md5(line), ',' ORDER BY rn) AS sentences FROM r WHERE rn <= 3 GROUP BY 1, 2, 3)
SELECT a.doc_id, a.type, a.ent AS text, n, layer, CAST(first_sent AS INT) AS first_sent, sentences, CAST(row_number() OVER (PARTITION BY a.doc_id ORDER BY n DESC, a.type, encode(a.ent)) AS INT) AS place FROM a JOIN c USING (doc_id, type, ent)""")
def entity_lists(t, spark):
    """Names and numbers of each text: how often, the layer of the first mention, its first three sentences (digests), its place."""
    # texts are dealt out by their number once; all that follows is of one text
    docs = t("documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    s = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent", "line"))
    s = s.select("doc_id", "sent", F.md5("line").alias("sentence"), F.regexp_extract_all("line", F.lit("[A-Z][a-z]+|[0-9]+"), F.lit(0)).alias("found")).where(F.size("found") > 0)
    e = s.select("doc_id", "sent", "sentence", F.posexplode("found").alias("pos", "text"))
    number = F.col("text").rlike("^[0-9]")
    m = e.withColumns({"type": F.when(number, "number").otherwise("name"), "layer": F.when(number, "rule").when(F.col("pos") == 0, "dict").otherwise("model")})
    return V.entity_list(m, "doc_id").withColumn("sentences", F.array_join("sentences", ","))


_BAND, _HUGE = (5, 20), 1200


@query("recall_buckets", f"""WITH {BM25.replace("rank <= 10", "rank <= 20")}, p AS (SELECT item_id, min(doc_id) AS pos_id FROM gold GROUP BY 1), q AS (SELECT item_id, pos_id, source AS pos_source FROM p JOIN documents ON doc_id = pos_id),
u AS (SELECT item_id, doc_id, l.rank AS bm25_rank, c.rank AS cover_rank FROM lex l FULL JOIN cvr c USING (item_id, doc_id)), j AS (SELECT u.*, least(coalesce(bm25_rank, 1000), coalesce(cover_rank, 1000)) AS best_rank, pos_id, d.source = pos_source AS same_source, length(text) AS n FROM u JOIN q USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, pos_id, bm25_rank, cover_rank, CAST(best_rank AS INT) AS best_rank, same_source, CASE WHEN bm25_rank IS NULL THEN 'cover' WHEN cover_rank IS NULL THEN 'bm25' ELSE 'both' END AS recall_via, CASE WHEN n > {_HUGE} THEN 'C' WHEN same_source THEN 'A' ELSE 'B' END AS bucket,
CASE WHEN n > {_HUGE} THEN 'cand_len=' || n || '>{_HUGE}' END AS exclude_reason FROM j WHERE same_source OR best_rank BETWEEN {_BAND[0]} AND {_BAND[1]}""")
def recall_buckets(t, spark):
    """Candidates of both recall lists: of the gold text's source (A), of others in the band of ranks (B), huge ones
    apart with the reason (C); what is neither goes."""
    a, c = _both(t, 20)
    u = a.select("item_id", "doc_id", F.col("rank").alias("bm25_rank")).join(c.select("item_id", "doc_id", F.col("rank").alias("cover_rank")), ["item_id", "doc_id"], "full")
    d = t("documents").select("doc_id", "source", F.length("text").alias("n"))
    gold = _gold(t).groupBy("item_id").agg(F.min("doc_id").alias("pos_id")).join(d.select(F.col("doc_id").alias("pos_id"), F.col("source").alias("pos_source")), "pos_id")
    j = u.join(gold, "item_id").join(d, "doc_id").withColumns({"best_rank": F.least("bm25_rank", "cover_rank"), "same_source": F.col("source") == F.col("pos_source")})
    huge = F.col("n") > _HUGE
    return j.where(F.col("same_source") | F.col("best_rank").between(*_BAND)).select(
        "item_id", "doc_id", "pos_id", "bm25_rank", "cover_rank", "best_rank", "same_source", F.when(F.col("bm25_rank").isNull(), "cover").when(F.col("cover_rank").isNull(), "bm25").otherwise("both").alias("recall_via"),
        F.when(huge, "C").when(F.col("same_source"), "A").otherwise("B").alias("bucket"), F.when(huge, F.concat(F.lit("cand_len="), F.col("n").cast("string"), F.lit(f">{_HUGE}"))).alias("exclude_reason"),
    )


_CLAUSE = "CASE p_size % 5 WHEN 0 THEN '不应小于' WHEN 1 THEN '应控制好在' WHEN 2 THEN '至少' WHEN 3 THEN '除应执行本' ELSE '宜为' END || p_size || CASE p_partkey % 4 WHEN 0 THEN ' mm' WHEN 1 THEN '层' WHEN 2 THEN '' ELSE ' kPa' END || repeat('；另见', CAST(p_size % 40 AS INT)) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE '' END"
_NO = "(p_partkey % 4) || '.' || (p_size % 2) || '.' || (1 + p_size % 3)"


@query("clause_scores", f"""WITH x AS (SELECT p_partkey, {_CLAUSE} AS text, {_NO} AS no FROM part) SELECT p_partkey, 3 * CAST(regexp_matches(text, '{T._THRESHOLD}') AS INT) + 2 * CAST(regexp_matches(text, '{T._QUANTITY}') AS INT) + CAST(length(text) BETWEEN 60 AND 320 AS INT)
- CAST(regexp_matches(text, '[A-Za-z]{{5,}}') AS INT) - 6 * CAST({" OR ".join(f"contains(text, '{p}')" for p in T._SET_PHRASES)} AS INT) - 2 * CAST(regexp_matches(no, '{T._GENERAL}') AS INT) AS score FROM x""")
def clause_scores(t, spark):
    """How much each clause tells: thresholds, quantities, length, Latin words, set phrases and general numbers."""
    pick = lambda by, options, other: F.coalesce(F.get(F.array(*map(F.lit, options)), by.cast("int")), F.lit(other))
    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.concat(pick(size % 5, ("不应小于", "应控制好在", "至少", "除应执行本"), "宜为"), size.cast("string"), pick(key % 4, (" mm", "层", ""), " kPa"), F.repeat(F.lit("；另见"), (size % 40).cast("int")), F.when(key % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    no = F.concat_ws(".", (key % 4).cast("string"), (size % 2).cast("string"), (1 + size % 3).cast("string"))
    return t("part").select("p_partkey", T.clause_score(text, no).alias("score"))


_PAGE = "CASE doc_id % 6 WHEN 0 THEN replace(text, '. ', chr(10)) WHEN 1 THEN replace(text, '. ', ' ...' || chr(10)) WHEN 2 THEN regexp_replace(regexp_replace(text, '\\s+', chr(10) || '1.2 ', 'g'), '([a-z]{14})[a-z]+', '\\1', 'g') ELSE text END"


@query("front_contents", f"""WITH p AS (SELECT doc_id, source, {_PAGE} AS text FROM documents), l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM p),
c AS (SELECT *, len(lines) AS k, len(list_filter(lines, lambda x: length(x) < 20)) AS short, len(list_filter(lines, lambda x: regexp_matches(x, '^[0-9]{{1,2}}(\\.[0-9]{{1,2}}){{1,3}}|\\.{{3,}}'))) AS number, list_sort(list_transform(lines, lambda x: length(x))) AS sizes FROM l)
SELECT source, doc_id, i, i < greatest(4, floor(n * 0.25)) AND coalesce(k >= 8 AND (regexp_matches(text, '\\.{{3,}}|…{{2,}}') OR short > 0.85 * k AND number >= 6 AND sizes[k // 2 + 1] < 15), FALSE) AS dropped FROM c""")
def front_contents(t, spark):
    """Contents pages among the first quarter of each book: a source's texts are its pages."""
    return V.front_contents(t("documents").select("doc_id", "source", F.expr(_PAGE.replace("chr(10)", "char(10)").replace(", 'g'", "").replace("'\\1'", "'$1'").replace("\\s", "\\\\s")).alias("text")), "source", "doc_id")


_KINDS, _CHAPTERS = ("pit", "lift", "form", "scaffold"), ["工程概况", "编制依据", "施工计划"]
_LABELS = {"risks": "风险点", "plan": "方案内容", "controls": "管控措施", "acceptance": "验收节点"}
_KIND = "CASE {0} % 5 WHEN 0 THEN 'pit' WHEN 1 THEN 'lift' WHEN 2 THEN 'form' WHEN 3 THEN 'scaffold' END"
_JOINED = lambda head, expr, table: f"(SELECT category, string_agg('{head}' || ({expr}) || chr(10), '' ORDER BY place) AS text, count(*) AS n FROM {table} GROUP BY 1)"


@query("section_frames", f"""WITH risk AS (SELECT {_KIND.format("n_nationkey")} AS category, n_nationkey AS place, n_name AS source, 'h' || n_regionkey AS hazard, 'c' || n_nationkey AS control FROM nation WHERE n_nationkey % 5 < 4), extra AS (SELECT category, place, 'x ' || source AS line FROM risk WHERE place % 2 = 0),
chk AS (SELECT category, place, 'y ' || source AS line FROM risk WHERE place % 3 = 0), pas AS (SELECT category, place, 'z ' || source AS line FROM risk WHERE category <> 'form' AND place < 12),
s AS (SELECT p_partkey AS item, {_KIND.format("p_size")} AS category, p_name AS subject, CASE WHEN p_size % 3 = 0 THEN p_type END AS equipment, CASE WHEN p_size % 4 = 0 THEN p_size END AS capacity, p_size > 30 AS sup, p_partkey % 4 AS w FROM part),
j AS (SELECT s.*, coalesce(r.text, '') AS rt, coalesce(r.n, 0) AS rn, coalesce(c.text, '') AS ct, coalesce(e.text, '') AS et, coalesce(e.n, 0) AS en, coalesce(k.text, '') AS kt, coalesce(k.n, 0) AS kn, coalesce(p.text, '') AS pt, coalesce(p.n, 0) AS pn FROM s LEFT JOIN {_JOINED("- ", "source || '：' || hazard || '（管控：' || control || '）'", "risk")} r USING (category)
 LEFT JOIN {_JOINED("- ", "source || ' → ' || control", "risk")} c USING (category) LEFT JOIN {_JOINED("- ", "line", "extra")} e USING (category) LEFT JOIN {_JOINED("- ", "line", "chk")} k USING (category) LEFT JOIN {_JOINED("- ", "line", "pas")} p USING (category)),
b AS (SELECT *, CASE WHEN equipment IS NOT NULL OR capacity IS NOT NULL THEN coalesce(capacity || 't', '') || ' ' || coalesce(equipment, '') || ' ' ELSE '' END || subject || ' 危大工程 — 管理框架（结构化问答）' AS title, CASE WHEN pn > 0 THEN ' + RAG 条文' ELSE '' END AS more FROM j)
SELECT item, title, 3 + CAST(w <> 0 AS INT) AS n_sections, '## ' || title || chr(10) || chr(10) || '- 危大类别：' || coalesce(category, '未识别') || CASE WHEN sup THEN '（**超规模，需专家论证**）' ELSE '（危大级别）' END || chr(10) || chr(10) || CASE WHEN w <> 0 THEN '### 风险点（' || rn || ' 项）' || chr(10) || '> 来源：风险源知识库（工程管理框架）' || chr(10) || rt || chr(10) ELSE '' END
|| '### 方案内容（' || (3 + CAST(sup AS INT) + en) || ' 项）' || chr(10) || '> 来源：建办质〔2018〕31号 九章 + 建办质〔2021〕48号 细化要素' || chr(10) || '- 工程概况' || chr(10) || '- 编制依据' || chr(10) || '- 施工计划' || chr(10) || CASE WHEN sup THEN '- （超规模）专家论证' || chr(10) ELSE '' END || et || chr(10)
|| '### 管控措施（' || (rn + pn) || ' 项）' || chr(10) || '> 来源：风险源知识库（管控要点）' || more || chr(10) || ct || pt || chr(10) || '### 验收节点（' || (kn + pn) || ' 项）' || chr(10) || '> 来源：分阶段验收规则模板' || more || chr(10) || kt || pt AS markdown FROM b""")
def section_frames(t, spark):
    """A frame of sections for each part: risks, chapters with extras, controls and checks with passages, as Markdown."""
    kind = lambda by: F.get(F.array(*map(F.lit, _KINDS)), (by % 5).cast("int"))
    n = F.col("n_nationkey")
    risks = t("nation").select(kind(n).alias("category"), n.alias("place"), F.col("n_name").alias("source"), F.concat(F.lit("h"), F.col("n_regionkey").cast("string")).alias("hazard"), F.concat(F.lit("c"), n.cast("string")).alias("control")).where("category IS NOT NULL")
    line = lambda mark, test: risks.where(test).select("category", "place", F.concat(F.lit(f"{mark} "), "source").alias("line"))
    size, key = F.col("p_size"), F.col("p_partkey")
    wants = F.when(key % 4 != 0, F.array(*map(F.lit, _LABELS))).otherwise(F.array(*map(F.lit, list(_LABELS)[1:])))
    slots = t("part").select(key.alias("item"), kind(size).alias("category"), F.col("p_name").alias("subject"), F.when(size % 3 == 0, F.col("p_type")).alias("equipment"), F.when(size % 4 == 0, size).alias("capacity"), F.lit("t").alias("unit"), (size > 30).alias("is_super"), wants.alias("wants"))
    frames = O.frames(slots, risks, line("x", "place % 2 = 0"), line("y", "place % 3 = 0"), line("z", "category <> 'form' AND place < 12"), _CHAPTERS, _LABELS)
    return frames.select("item", "title", F.size("sections").alias("n_sections"), "markdown")


_FINDINGS = "SELECT l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'C' || (l_linenumber % 4 + 1) AS chk, 'part ' || l_partkey AS title, CASE WHEN l_tax > 0.04 THEN 'see ' || l_suppkey ELSE '' END AS advice, repeat('much to say ', CAST(l_quantity AS INT)) AS detail, CASE WHEN l_discount > 0.04 THEN 'JGJ 59' ELSE '' END AS basis FROM lineitem"


@query("exported_reports", f"""WITH f AS ({_FINDINGS}), h AS (SELECT o_orderkey AS k, unnest(['# 施工方案合规自查报告', '', '> order ' || o_orderkey, '', '## 风险清单', '| 级别 | 检查项 | 风险 | 依据/建议 |', '| --- | --- | --- | --- |']) AS line FROM orders),
m AS (SELECT line FROM h UNION ALL SELECT '| ' || severity || ' | ' || chk || ' | ' || title || ' | ' || CASE WHEN advice = '' THEN substr(detail, 1, 60) ELSE advice END || ' ' || basis || ' |' FROM f)
SELECT 'md' AS kind, md5(line) AS digest, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT 'sheet', md5(severity || '|' || chk || '|' || title || '|' || detail || '|' || advice), count(*) FROM f GROUP BY 1, 2""")
def exported_reports(t, spark):
    """Reports of all orders written as Markdown files and a sheet, and read back from both: their different lines."""
    severity = F.when(F.col("l_returnflag") == "R", "HIGH").when(F.col("l_returnflag") == "A", "MEDIUM").otherwise("LOW")
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    findings = t("lineitem").select(
        F.col("l_orderkey").alias("case"), severity.alias("severity"), F.concat(F.lit("C"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("check"), text("part ", "l_partkey").alias("title"), F.when(F.col("l_tax") > 0.04, text("see ", "l_suppkey")).otherwise("").alias("suggestion"),
        F.repeat(F.lit("much to say "), F.col("l_quantity").cast("int")).alias("description"), F.when(F.col("l_discount") > 0.04, F.array(F.lit("JGJ 59"))).alias("basis"),
    )
    lines = O.finding_lines(t("orders").select(F.col("o_orderkey").alias("case"), text("order ", "o_orderkey").alias("summary")), findings, "case")
    md, sheet = O.export(lines, findings, "case")
    back = spark.read.schema("case long, severity string, check string, title string, description string, suggestion string").option("header", True).csv(sheet)
    row = F.concat_ws("|", "severity", "check", "title", F.coalesce("description", F.lit("")), F.coalesce("suggestion", F.lit("")))
    counts = lambda rows, line, kind: rows.groupBy(F.unhex(F.md5(line)).alias("d")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lower(F.hex("d")).alias("digest"), "n")
    return counts(spark.read.text(md), F.col("value"), "md").unionByName(counts(back, row, "sheet"))


_PAGE = "CASE doc_id % 6 WHEN 0 THEN replace(text, '. ', chr(10)) WHEN 1 THEN replace(text, '. ', ' ...' || chr(10)) WHEN 2 THEN regexp_replace(regexp_replace(text, '\\s+', chr(10) || '1.2 ', 'g'), '([a-z]{14})[a-z]+', '\\1', 'g') ELSE text END"


@query("front_contents", f"""WITH p AS (SELECT doc_id, source, {_PAGE} AS text FROM documents), l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM p),
c AS (SELECT *, len(lines) AS k, len(list_filter(lines, lambda x: length(x) < 20)) AS short, len(list_filter(lines, lambda x: regexp_matches(x, '^[0-9]{{1,2}}(\\.[0-9]{{1,2}}){{1,3}}|\\.{{3,}}'))) AS number, list_sort(list_transform(lines, lambda x: length(x))) AS sizes FROM l)
SELECT source, doc_id, i, i < greatest(4, floor(n * 0.25)) AND coalesce(k >= 8 AND (regexp_matches(text, '\\.{{3,}}|…{{2,}}') OR short > 0.85 * k AND number >= 6 AND sizes[k // 2 + 1] < 15), FALSE) AS dropped FROM c""")
def front_contents(t, spark):
    """Contents pages among the first quarter of each book: a source's texts are its pages."""
    return V.front_contents(t("documents").select("doc_id", "source", F.expr(_PAGE.replace("chr(10)", "char(10)").replace(", 'g'", "").replace("'\\1'", "'$1'").replace("\\s", "\\\\s")).alias("text")), "source", "doc_id")


_KINDS, _CHAPTERS = ("pit", "lift", "form", "scaffold"), ["工程概况", "编制依据", "施工计划"]
_LABELS = {"risks": "风险点", "plan": "方案内容", "controls": "管控措施", "acceptance": "验收节点"}
_KIND = "CASE {0} % 5 WHEN 0 THEN 'pit' WHEN 1 THEN 'lift' WHEN 2 THEN 'form' WHEN 3 THEN 'scaffold' END"
_JOINED = lambda head, expr, table: f"(SELECT category, string_agg('{head}' || ({expr}) || chr(10), '' ORDER BY place) AS text, count(*) AS n FROM {table} GROUP BY 1)"


@query("section_frames", f"""WITH risk AS (SELECT {_KIND.format("n_nationkey")} AS category, n_nationkey AS place, n_name AS source, 'h' || n_regionkey AS hazard, 'c' || n_nationkey AS control FROM nation WHERE n_nationkey % 5 < 4), extra AS (SELECT category, place, 'x ' || source AS line FROM risk WHERE place % 2 = 0),
chk AS (SELECT category, place, 'y ' || source AS line FROM risk WHERE place % 3 = 0), pas AS (SELECT category, place, 'z ' || source AS line FROM risk WHERE category <> 'form' AND place < 12),
s AS (SELECT p_partkey AS item, {_KIND.format("p_size")} AS category, p_name AS subject, CASE WHEN p_size % 3 = 0 THEN p_type END AS equipment, CASE WHEN p_size % 4 = 0 THEN p_size END AS capacity, p_size > 30 AS sup, p_partkey % 4 AS w FROM part),
j AS (SELECT s.*, coalesce(r.text, '') AS rt, coalesce(r.n, 0) AS rn, coalesce(c.text, '') AS ct, coalesce(e.text, '') AS et, coalesce(e.n, 0) AS en, coalesce(k.text, '') AS kt, coalesce(k.n, 0) AS kn, coalesce(p.text, '') AS pt, coalesce(p.n, 0) AS pn FROM s LEFT JOIN {_JOINED("- ", "source || '：' || hazard || '（管控：' || control || '）'", "risk")} r USING (category)
 LEFT JOIN {_JOINED("- ", "source || ' → ' || control", "risk")} c USING (category) LEFT JOIN {_JOINED("- ", "line", "extra")} e USING (category) LEFT JOIN {_JOINED("- ", "line", "chk")} k USING (category) LEFT JOIN {_JOINED("- ", "line", "pas")} p USING (category)),
b AS (SELECT *, CASE WHEN equipment IS NOT NULL OR capacity IS NOT NULL THEN coalesce(capacity || 't', '') || ' ' || coalesce(equipment, '') || ' ' ELSE '' END || subject || ' 危大工程 — 管理框架（结构化问答）' AS title, CASE WHEN pn > 0 THEN ' + RAG 条文' ELSE '' END AS more FROM j)
SELECT item, title, 3 + CAST(w <> 0 AS INT) AS n_sections, '## ' || title || chr(10) || chr(10) || '- 危大类别：' || coalesce(category, '未识别') || CASE WHEN sup THEN '（**超规模，需专家论证**）' ELSE '（危大级别）' END || chr(10) || chr(10) || CASE WHEN w <> 0 THEN '### 风险点（' || rn || ' 项）' || chr(10) || '> 来源：风险源知识库（工程管理框架）' || chr(10) || rt || chr(10) ELSE '' END
|| '### 方案内容（' || (3 + CAST(sup AS INT) + en) || ' 项）' || chr(10) || '> 来源：建办质〔2018〕31号 九章 + 建办质〔2021〕48号 细化要素' || chr(10) || '- 工程概况' || chr(10) || '- 编制依据' || chr(10) || '- 施工计划' || chr(10) || CASE WHEN sup THEN '- （超规模）专家论证' || chr(10) ELSE '' END || et || chr(10)
|| '### 管控措施（' || (rn + pn) || ' 项）' || chr(10) || '> 来源：风险源知识库（管控要点）' || more || chr(10) || ct || pt || chr(10) || '### 验收节点（' || (kn + pn) || ' 项）' || chr(10) || '> 来源：分阶段验收规则模板' || more || chr(10) || kt || pt AS markdown FROM b""")
def section_frames(t, spark):
    """A frame of sections for each part: risks, chapters with extras, controls and checks with passages, as Markdown."""
    kind = lambda by: F.get(F.array(*map(F.lit, _KINDS)), (by % 5).cast("int"))
    n = F.col("n_nationkey")
    risks = t("nation").select(kind(n).alias("category"), n.alias("place"), F.col("n_name").alias("source"), F.concat(F.lit("h"), F.col("n_regionkey").cast("string")).alias("hazard"), F.concat(F.lit("c"), n.cast("string")).alias("control")).where("category IS NOT NULL")
    line = lambda mark, test: risks.where(test).select("category", "place", F.concat(F.lit(f"{mark} "), "source").alias("line"))
    size, key = F.col("p_size"), F.col("p_partkey")
    wants = F.when(key % 4 != 0, F.array(*map(F.lit, _LABELS))).otherwise(F.array(*map(F.lit, list(_LABELS)[1:])))
    slots = t("part").select(key.alias("item"), kind(size).alias("category"), F.col("p_name").alias("subject"), F.when(size % 3 == 0, F.col("p_type")).alias("equipment"), F.when(size % 4 == 0, size).alias("capacity"), F.lit("t").alias("unit"), (size > 30).alias("is_super"), wants.alias("wants"))
    frames = O.frames(slots, risks, line("x", "place % 2 = 0"), line("y", "place % 3 = 0"), line("z", "category <> 'form' AND place < 12"), _CHAPTERS, _LABELS)
    return frames.select("item", "title", F.size("sections").alias("n_sections"), "markdown")


_FINDINGS = "SELECT l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'C' || (l_linenumber % 4 + 1) AS chk, 'part ' || l_partkey AS title, CASE WHEN l_tax > 0.04 THEN 'see ' || l_suppkey ELSE '' END AS advice, repeat('much to say ', CAST(l_quantity AS INT)) AS detail, CASE WHEN l_discount > 0.04 THEN 'JGJ 59' ELSE '' END AS basis FROM lineitem"


@query("exported_reports", f"""WITH f AS ({_FINDINGS}), h AS (SELECT o_orderkey AS k, unnest(['# 施工方案合规自查报告', '', '> order ' || o_orderkey, '', '## 风险清单', '| 级别 | 检查项 | 风险 | 依据/建议 |', '| --- | --- | --- | --- |']) AS line FROM orders),
m AS (SELECT line FROM h UNION ALL SELECT '| ' || severity || ' | ' || chk || ' | ' || title || ' | ' || CASE WHEN advice = '' THEN substr(detail, 1, 60) ELSE advice END || ' ' || basis || ' |' FROM f)
SELECT 'md' AS kind, md5(line) AS digest, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT 'sheet', md5(severity || '|' || chk || '|' || title || '|' || detail || '|' || advice), count(*) FROM f GROUP BY 1, 2""")
def exported_reports(t, spark):
    """Reports of all orders written as Markdown files and a sheet, and read back from both: their different lines."""
    severity = F.when(F.col("l_returnflag") == "R", "HIGH").when(F.col("l_returnflag") == "A", "MEDIUM").otherwise("LOW")
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    findings = t("lineitem").select(
        F.col("l_orderkey").alias("case"), severity.alias("severity"), F.concat(F.lit("C"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("check"), text("part ", "l_partkey").alias("title"), F.when(F.col("l_tax") > 0.04, text("see ", "l_suppkey")).otherwise("").alias("suggestion"),
        F.repeat(F.lit("much to say "), F.col("l_quantity").cast("int")).alias("description"), F.when(F.col("l_discount") > 0.04, F.array(F.lit("JGJ 59"))).alias("basis"),
    )
    lines = O.finding_lines(t("orders").select(F.col("o_orderkey").alias("case"), text("order ", "o_orderkey").alias("summary")), findings, "case")
    md, sheet = O.export(lines, findings, "case")
    back = spark.read.schema("case long, severity string, check string, title string, description string, suggestion string").option("header", True).csv(sheet)
    row = F.concat_ws("|", "severity", "check", "title", F.coalesce("description", F.lit("")), F.coalesce("suggestion", F.lit("")))
    both = spark.read.text(md).select(F.lit("md").alias("kind"), F.md5("value").alias("digest")).unionByName(back.select(F.lit("sheet").alias("kind"), F.md5(row).alias("digest")))
    return both.groupBy("kind", "digest").agg(F.count("*").alias("n"))


_SIZES = ((350, 50), (700, 100), (1000, 150))


@query("recursive_size_ab")
def recursive_size_ab(t, spark):
    """The same questions on recursive chunks of three sizes: chunks, the share of questions whose gold text is among
    the best five, and the mean reciprocal rank."""
    gold, asked, out = _gold(t), R.tokenised(t("benchmark"), "item_id"), []
    for size, overlap in _SIZES:
        words = F.transform("units", lambda u: T.tokens(u))
        texts = stored(chunking.unit_texts(t("documents").select("doc_id", "text"), "doc_id", size, overlap).select("doc_id", words.alias("units")))
        m = R.metrics(R.ranked(texts, asked, "doc_id", "item_id", 5), gold, "item_id", "doc_id", 5)
        scores = m.agg(F.round(F.avg((F.col("mrr") > 0).cast("int")), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("n"))
        out.append(texts.agg(F.sum(F.size("units")).alias("chunks")).crossJoin(scores).select(F.lit(size).alias("size"), "chunks", "hit", "mrr", "n"))  # one row each
    return reduce(DataFrame.unionByName, out)


#: Kinds of nations by words of a question, and how many of its words are tried where it names none.
_NAMED, _TRIED = {"ones": ("the", "and"), "twos": ("der", "und"), "threes": ("pour", "dans")}, 3
_KINDS_OF = ("ones", "twos", "threes")


@query("graph_path", f"""WITH q AS (SELECT item_id, lower(text) AS text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'x 1' || (item_id % 5) || '？' || lower(substr(text, 40, 12)) || ' tion' FROM benchmark WHERE item_id % 2 = 1),
k AS (SELECT item_id, kind FROM q, (VALUES {", ".join(f"('{k}', '{w}')" for k, ws in _NAMED.items() for w in ws)}) v(kind, word) WHERE contains(text, word) GROUP BY ALL), kn AS (SELECT item_id, kind, n_nationkey, n_regionkey FROM k JOIN nation ON (['ones', 'twos', 'threes'])[n_nationkey % 3 + 1] = kind),
w AS (SELECT item_id, unnest(list_slice(list_filter(string_split(replace(text, '？', ' '), ' '), lambda x: length(x) >= 2), 1, {_TRIED})) AS word FROM q WHERE item_id NOT IN (SELECT item_id FROM k)), wn AS (SELECT DISTINCT item_id, n_nationkey, n_regionkey FROM w JOIN nation ON contains(lower(n_name), word)),
s AS (SELECT item_id, n_nationkey, n_regionkey, 'kind' AS way FROM kn UNION SELECT item_id, n_nationkey, n_regionkey, 'word' FROM wn)
SELECT item_id, way, 'n' || n_nationkey AS id FROM s UNION SELECT item_id, way, 'r' || n_regionkey FROM s UNION SELECT item_id, way, 's' || s_suppkey FROM s JOIN supplier ON s_nationkey = n_nationkey WHERE way = 'kind'""")
def graph_path(t, spark):
    """What a question leads to in the graph: by the kinds that it names, with their regions and suppliers; where it
    names none, by its first three words of two letters, found in names as parts, with their regions only."""
    b, text = t("benchmark"), F.lower("text")
    odd = F.concat(F.lit("x 1"), (F.col("item_id") % 5).cast("string"), F.lit("？"), F.lower(F.substring("text", 40, 12)), F.lit(" tion"))
    q = b.select("item_id", F.when(F.col("item_id") % 2 == 0, text).otherwise(odd).alias("text"))
    has = lambda words: reduce(lambda a, c: a | c, [F.contains("text", F.lit(w)) for w in words])
    kinds = F.array_compact(F.array(*(F.when(has(words), kind) for kind, words in _NAMED.items())))
    q = q.withColumn("kinds", kinds)
    n = t("nation").select("n_nationkey", "n_regionkey", F.lower("n_name").alias("name"), F.get(F.array(*map(F.lit, _KINDS_OF)), (F.col("n_nationkey") % 3).cast("int")).alias("kind"))
    by_kind = q.select("item_id", F.explode("kinds").alias("kind")).join(n, "kind").select("item_id", "n_nationkey", "n_regionkey", F.lit("kind").alias("way"))
    words = F.slice(F.filter(F.split(F.replace("text", F.lit("？"), F.lit(" ")), " "), lambda x: F.length(x) >= 2), 1, _TRIED)
    # a name's parts, so that words meet them by equality
    part = n.select("n_nationkey", "n_regionkey", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.transform(F.sequence(F.lit(2), F.length("name") - i + 1), lambda k: F.substring("name", i, k))))).alias("word")).distinct()
    by_word = q.where(F.size("kinds") == 0).select("item_id", F.explode(words).alias("word")).join(part, "word").select("item_id", "n_nationkey", "n_regionkey", F.lit("word").alias("way"))
    s = by_kind.unionByName(by_word).distinct()
    named = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    near = s.select("item_id", "way", F.explode(F.array(named("n", "n_nationkey"), named("r", "n_regionkey"))).alias("id")).distinct()
    far = s.where("way = 'kind'").join(t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), "n_nationkey").select("item_id", "way", named("s", "s_suppkey").alias("id")).distinct()
    return near.unionByName(far)


@query("case_texts", """WITH p AS (SELECT 'plan ' || (item_id // 20) AS plan_file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY item_id) AS plan FROM benchmark WHERE item_id // 20 % 4 <> 3 GROUP BY 1),
c AS (SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN 'plan ' || (item_id // 20) END AS plan_file FROM benchmark) SELECT item_id, c.plan_file, length(coalesce(plan, '')) AS n, md5(coalesce(plan, '')) AS digest FROM c LEFT JOIN p USING (plan_file)""")
def case_texts(t, spark):
    """Cases out of JSON lines with the texts of the side files that they name: twenty passages a file, every fourth
    file missing, every seventh case without one."""
    cases, sides = files.scratch(spark, "cases"), files.scratch(spark, "sides")
    named = t("benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("value"), F.floor(F.col("item_id") / 20).alias("k")).withColumn("side", F.concat(F.lit("plan "), F.col("k").cast("string")))
    named.where("k % 4 <> 3").repartition("side").sortWithinPartitions("side", "item_id").select("value", "side").write.partitionBy("side").text(sides)
    files.write_jsonl(named.select("item_id", F.when(F.col("item_id") % 7 != 0, F.col("side")).alias("plan_file")), cases)
    read = files.read_jsonl(spark, cases, "item_id long, plan_file string")
    whole = files.with_side_text(read, sides, "plan_file", "plan")
    return whole.select("item_id", "plan_file", F.length("plan").cast("long").alias("n"), F.md5("plan").alias("digest"))
