"""Spans, labels, rules and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spans as P
from .registry import query

#: Fixed lexicon of the tests' own: (term, type, priority).
LEXICON = [("the", "ARTICLE", 1), ("then", "ADVERB", 2), ("tion", "SUFFIX", 3), ("und", "JOIN", 1), ("que", "JOIN", 1), ("heit", "SUFFIX", 3)]
_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in LEXICON) + ") v(term, type, prio))"


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "term string, type string, prio int")


@query("keyword_tag", f"WITH {_LEX} SELECT doc_id, type, count(*) AS n_terms, arg_max(term, (length(term), term)) AS longest FROM documents JOIN lex ON contains(text, term) GROUP BY 1, 2")
def keyword_tag(t, spark):
    """Types whose terms a text holds; of several terms the longest is named. The lexicon is an array
    of the row, so that no text is copied for it."""
    hit = t("documents").select("doc_id", F.explode(_held(spark)).alias("x")).select("doc_id", "x.*")
    return hit.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n_terms"), F.max_by("term", F.struct(F.length("term"), "term")).alias("longest"))


def _held(spark, text="text"):
    """The lexicon's entries that a text holds, by priority and term."""
    entries = [F.struct(F.lit(a).alias("term"), F.lit(b).alias("type"), F.lit(k).alias("ord")) for k, (a, b, _) in enumerate(sorted(LEXICON, key=lambda x: (x[2], x[0])))]
    return F.filter(F.array(*entries), lambda x: F.contains(text, x["term"]))


@query("longest_keyword", f"WITH {_LEX}, o AS (SELECT *, row_number() OVER (ORDER BY prio, term) AS ord FROM lex) SELECT doc_id, arg_max(type, (length(term), -ord)) AS type FROM documents JOIN o ON contains(text, term) GROUP BY 1")
def longest_keyword(t, spark):
    best = F.array_max(F.transform(_held(spark), lambda x: F.struct(F.length(x["term"]).alias("n"), F.negative(x["ord"]).alias("o"), x["type"].alias("type"))))
    return t("documents").select("doc_id", best["type"].alias("type")).where("type IS NOT NULL")


@query("dictionary_spans")
def dictionary_spans(t, spark):
    """Longest terms first, no overlaps."""
    return P.tag(t("documents").select("doc_id", "text"), LEXICON, patterns=[("NUMBER", r"[0-9]+(?:\.[0-9]+)?")])


_SPANS = "s AS (SELECT l_orderkey AS g, l_returnflag AS type, l_linenumber AS id, CAST(l_suppkey % 40 AS INT) AS s, CAST(l_suppkey % 40 + l_quantity AS INT) AS e, CASE WHEN l_linestatus = 'F' THEN 'gold' ELSE 'model' END AS who, l_partkey AS p FROM lineitem)"


def _spans(t):
    s = F.col("l_suppkey") % 40
    return t("lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("id"), s.cast("int").alias("s"), (s + F.col("l_quantity")).cast("int").alias("e"), F.when(F.col("l_linestatus") == "F", "gold").otherwise("model").alias("who"), F.col("l_partkey").alias("p"))


@query("span_overlap_join", f"WITH {_SPANS} SELECT a.g, a.type, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM s a JOIN s b ON a.g = b.g AND a.type = b.type AND a.s < b.e AND b.s < a.e AND (a.id, a.p) < (b.id, b.p) GROUP BY 1, 2")
def span_overlap_join(t, spark):
    s = _spans(t)
    a, b = s.select("g", "type", *(F.col(c).alias(f"{c}1") for c in ("id", "p", "s", "e"))), s.select("g", "type", *(F.col(c).alias(f"{c}2") for c in ("id", "p", "s", "e")))
    j = a.join(b, ["g", "type"]).where(P.overlaps("s1", "e1", "s2", "e2") & (F.struct("id1", "p1") < F.struct("id2", "p2")))
    return j.groupBy("g", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("shared"))


@query("cascade_merge", f"WITH {_SPANS} SELECT g, id, p, s, e FROM s m WHERE who = 'model' AND NOT EXISTS (SELECT 1 FROM s r WHERE r.who = 'gold' AND r.g = m.g AND r.s < m.e AND m.s < r.e)")
def cascade_merge(t, spark):
    """Model spans that no rule span touches."""
    s = _spans(t)
    rule = s.where("who = 'gold'").select(F.col("g").alias("rg"), F.col("s").alias("rs"), F.col("e").alias("re"))
    return s.where("who = 'model'").join(rule, (F.col("g") == F.col("rg")) & P.overlaps("s", "e", "rs", "re"), "left_anti").select("g", "id", "p", "s", "e")


@query("strict_f1", """WITH a AS (SELECT l_suppkey AS g, l_returnflag AS type, CAST(l_quantity AS INT) AS s, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3), b AS (SELECT l_suppkey AS g, l_returnflag AS type, CAST(l_quantity AS INT) AS s, count(*) AS n FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1, 2, 3),
m AS (SELECT coalesce(a.type, b.type) AS type, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS tp, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.g = b.g AND a.type = b.type AND a.s = b.s)
SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(nb - tp) AS BIGINT) AS fp, CAST(sum(na - tp) AS BIGINT) AS fn, round(2 * sum(tp) / CAST(greatest(1, sum(na) + sum(nb)) AS DOUBLE), 6) AS f1 FROM m GROUP BY 1""")
def strict_f1(t, spark):
    """Equal spans matched one to one, as counts of each key."""
    key = ["g", "type", "s"]
    n = lambda c, name: t("lineitem").where(c).select(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("type"), F.col("l_quantity").cast("int").alias("s")).groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    m = n("l_linestatus = 'F'", "na").join(n("l_linestatus <> 'F'", "nb"), key, "full").fillna(0, ["na", "nb"]).withColumn("tp", F.least("na", "nb"))
    return m.groupBy("type").agg(F.sum("tp").alias("tp"), F.sum(F.col("nb") - F.col("tp")).alias("fp"), F.sum(F.col("na") - F.col("tp")).alias("fn"), F.round(2 * F.sum("tp") / F.greatest(F.lit(1), F.sum("na") + F.sum("nb")), 6).alias("f1"))


@query("relaxed_f1")
def relaxed_f1(t, spark):
    """Overlapping spans matched one to one, greedily in the order of the gold spans."""
    return P.relaxed_counts(_spans(t), "g")


@query("vote_groups")
def vote_groups(t, spark):
    """Spans of one type that overlap a seed become one; the longest stands for them."""
    return P.vote(_spans(t), "g")


@query("sanitize_spans")
def sanitize_spans(t, spark):
    """Clamped, of known types, sorted, and without overlaps."""
    return P.sanitize(_spans(t), "g", 60, ["A", "N", "R"])


@query("pair_jaccard", "WITH k AS (SELECT DISTINCT o_orderpriority AS who, o_custkey AS k FROM orders), n AS (SELECT who, count(*) AS n FROM k GROUP BY 1), b AS (SELECT a.who AS a, b.who AS b, count(*) AS both_ FROM k a JOIN k b ON a.k = b.k AND a.who < b.who GROUP BY 1, 2) SELECT a, b, round(both_ / CAST(x.n + y.n - both_ AS DOUBLE), 6) AS jaccard FROM b JOIN n x ON x.who = a JOIN n y ON y.who = b")
def pair_jaccard(t, spark):
    """Agreement of five annotators: each key carries the small set of who marked it."""
    marks = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("w"))
    one = marks.select(F.explode("w").alias("who")).groupBy("who").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = marks.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("c"))
    j = both.join(one.toDF("a", "na"), "a").join(one.toDF("b", "nb"), "b")
    return j.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


@query("label_set_diff", "WITH x AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_shipdate) FILTER (WHERE l_returnflag = 'R')) AS a, list_sort(list(DISTINCT l_shipdate) FILTER (WHERE l_returnflag = 'A')) AS b FROM lineitem GROUP BY 1) SELECT k, CAST(len(list_intersect(coalesce(a, []), coalesce(b, []))) AS BIGINT) AS shared, CAST(len(coalesce(a, [])) - len(list_intersect(coalesce(a, []), coalesce(b, []))) AS BIGINT) AS only_a FROM x")
def label_set_diff(t, spark):
    flags = t("lineitem").groupBy(F.col("l_suppkey").alias("k"), "l_shipdate").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    return flags.groupBy("k").agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"))


@query("dedup_entities", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), e AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '[A-Z][a-z]+')) AS ent FROM s)
SELECT doc_id, ent, count(*) AS n, CAST(min(pos) - 1 AS INT) AS first_sent, count(DISTINCT pos) AS n_sents FROM e GROUP BY 1, 2 HAVING count(*) > 1""")
def dedup_entities(t, spark):
    s = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    e = s.select("doc_id", "pos", F.explode(F.regexp_extract_all("line", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("ent"))
    return e.groupBy("doc_id", "ent").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_sent"), F.countDistinct("pos").alias("n_sents")).where("n > 1")


@query("suffix_mining", r"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 6)) AS w FROM documents) SELECT right(w, 4) AS suffix, count(*) AS n, count(DISTINCT w) AS n_words, min(w) AS example FROM w GROUP BY 1 HAVING count(*) >= 50""")
def suffix_mining(t, spark):
    w = t("documents").select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 6)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return w.groupBy(F.expr("right(w, 4)").alias("suffix")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_words"), F.min("w").alias("example")).where("n >= 50")


#: Unit, base unit, factor: fixed values.
UNITS = [("mm", "m", 0.001), ("cm", "m", 0.01), ("m", "m", 1.0), ("t", "kN", 10.0), ("kN", "kN", 1.0)]


@query("unit_normalise", "WITH u AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in UNITS) + ") v(unit, base, factor)), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, ['mm', 'cm', 'm', 't', 'kN', 'x'][CAST(l_suppkey % 6 AS INT) + 1] AS unit FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * factor, 6) AS value, base FROM l LEFT JOIN u USING (unit)")
def unit_normalise(t, spark):
    units = spark.createDataFrame(UNITS, "unit string, base string, factor double")
    names = F.array(*map(F.lit, ("mm", "cm", "m", "t", "kN", "x")))
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.element_at(names, (F.col("l_suppkey") % 6 + 1).cast("int")).alias("unit"))
    return l.join(F.broadcast(units), "unit", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") * F.col("factor"), 6).alias("value"), "base")


#: Category, metric pattern, hazardous from, super-hazardous from: fixed values.
THRESHOLDS = [("R", "^ECO", 10.0, 40.0), ("A", "STANDARD|PROMO", 20.0, 45.0), ("N", ".", None, 48.0)]


@query("threshold_judge", "WITH th AS (SELECT * FROM (VALUES ('R', '^ECO', 10.0, 40.0), ('A', 'STANDARD|PROMO', 20.0, 45.0), ('N', '.', NULL, 48.0)) v(cat, pat, h, s)) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN cat IS NULL THEN 'unknown' WHEN l_quantity >= s THEN 'super' WHEN h IS NULL OR l_quantity < h THEN 'none' ELSE 'hazardous' END AS level FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN th ON cat = l_returnflag AND regexp_matches(p_type, pat)")
def threshold_judge(t, spark):
    """Values against thresholds of their category and metric."""
    th = spark.createDataFrame(THRESHOLDS, "cat string, pat string, h double, s double")
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    j = l.join(F.broadcast(th), (F.col("cat") == F.col("l_returnflag")) & F.expr("p_type rlike pat"), "left")
    q = F.col("l_quantity")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("cat").isNull(), "unknown").when(q >= F.col("s"), "super").when(F.col("h").isNull() | (q < F.col("h")), "none").otherwise("hazardous").alias("level"))


@query("triage_semi_anti", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25 AND l_quantity > p_size) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P')")
def triage_semi_anti(t, spark):
    part = t("part").where("p_size > 25").select("p_partkey", "p_size")
    l = t("lineitem").join(part, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_quantity") > F.col("p_size")), "left_semi")
    return l.join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("limit_compare", "WITH j AS (SELECT l_orderkey, CASE WHEN p_type LIKE 'ECO%' THEN 'NA' WHEN l_quantity > p_size THEN 'BAD' ELSE 'OK' END AS v FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT l_orderkey, CASE WHEN bool_or(v = 'BAD') THEN 'BAD' WHEN bool_or(v = 'OK') THEN 'OK' ELSE 'NA' END AS verdict, count(*) AS n FROM j GROUP BY 1")
def limit_compare(t, spark):
    """Each value against its limit; one BAD decides, then one OK."""
    v = F.when(F.col("p_type").startswith("ECO"), 0).when(F.col("l_quantity") > F.col("p_size"), 2).otherwise(1)
    j = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size"), "l_partkey")
    worst = j.groupBy("l_orderkey").agg(F.max(v).alias("v"), F.count(F.lit(1)).alias("n"))
    return worst.select("l_orderkey", F.element_at(F.array(*map(F.lit, ("NA", "OK", "BAD"))), F.col("v") + 1).alias("verdict"), "n")


@query("rule_missing_sections", "WITH req AS (SELECT * FROM (VALUES (1, ['the', 'of']), (2, ['und', 'der']), (3, ['que', 'los']), (4, ['password', 'token'])) v(id, words)) SELECT doc_id, CAST(id AS INT) AS id FROM documents, req WHERE NOT list_bool_or(list_transform(words, lambda w: contains(text, w)))")
def rule_missing_sections(t, spark):
    """Required sections without any of their keywords."""
    req = [(1, ("the", "of")), (2, ("und", "der")), (3, ("que", "los")), (4, ("password", "token"))]
    missing = F.filter(F.array(*(F.when(~(F.contains("text", F.lit(a)) | F.contains("text", F.lit(b))), F.lit(k)) for k, (a, b) in req)), lambda x: x.isNotNull())
    return t("documents").select("doc_id", F.explode(missing).alias("id"))


@query("abolished_refs", r"""WITH r AS (SELECT DISTINCT p_partkey, p_brand AS ref, p_size FROM part) SELECT p_partkey, CASE WHEN ref IN ('Brand#1', 'Brand#7') THEN 'HIGH' WHEN ref IN ('Brand#2', 'Brand#9') AND p_size BETWEEN 10 AND 20 THEN 'HIGH' WHEN ref IN ('Brand#2', 'Brand#9') THEN 'LOW' END AS severity FROM r WHERE ref IN ('Brand#1', 'Brand#7', 'Brand#2', 'Brand#9')""")
def abolished_refs(t, spark):
    whole, part = ["Brand#1", "Brand#7"], ["Brand#2", "Brand#9"]
    ref = F.col("p_brand")
    severity = F.when(ref.isin(whole), "HIGH").when(ref.isin(part) & F.col("p_size").between(10, 20), "HIGH").when(ref.isin(part), "LOW")
    return t("part").where(ref.isin(whole + part)).select("p_partkey", severity.alias("severity")).distinct()


@query("intent_route", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'th') THEN 'search' WHEN contains(lower(text), 'ei') THEN 'review' WHEN contains(lower(text), 'qu') THEN 'graph' ELSE 'chat' END AS route FROM conversations")
def intent_route(t, spark):
    low = F.lower("text")
    return t("conversations").select("conv_id", "turn", F.when(F.contains(low, F.lit("th")), "search").when(F.contains(low, F.lit("ei")), "review").when(F.contains(low, F.lit("qu")), "graph").otherwise("chat").alias("route"))


@query("confusion_matrix", "WITH p AS (SELECT toxic, CAST(n_chars % 3 = 0 AS INT) AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE toxic = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND pred = 0) AS fn FROM p) SELECT tp, tn, fp, fn, round(fn / CAST(greatest(1, tp + fn) AS DOUBLE), 6) AS miss, round(fp / CAST(greatest(1, fp + tn) AS DOUBLE), 6) AS false_alarm FROM c")
def confusion_matrix(t, spark):
    p = t("labels").select("doc_id", "toxic").join(t("documents").select("doc_id", (F.col("n_chars") % 3 == 0).alias("pred")), "doc_id")
    y = F.col("toxic") == 1
    c = p.agg(F.count_if(y & F.col("pred")).alias("tp"), F.count_if(~y & ~F.col("pred")).alias("tn"), F.count_if(~y & F.col("pred")).alias("fp"), F.count_if(y & ~F.col("pred")).alias("fn"))
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b)), 6)
    return c.select("tp", "tn", "fp", "fn", rate("fn", "tp").alias("miss"), rate("fp", "tn").alias("false_alarm"))


@query("reward_parts", """SELECT event_id, round(0.15 * CAST(props LIKE '{%' AS INT) + 0.2 * CAST(value > 10 AS INT) + 0.25 * greatest(0, 1 - 0.15 * (user_id % 4)) + 0.4 * greatest(0, 1 - abs(value - 50) / 50 * 2), 4) AS reward FROM events""")
def reward_parts(t, spark):
    """Format, steps, basis (a false one costs 0.15) and a numeric answer that decays with its error."""
    v = F.col("value")
    reward = 0.15 * F.col("props").startswith("{").cast("int") + 0.2 * (v > 10).cast("int") + 0.25 * F.greatest(F.lit(0), 1 - 0.15 * (F.col("user_id") % 4)) + 0.4 * F.greatest(F.lit(0), 1 - F.abs(v - 50) / 50 * 2)
    return t("events").select("event_id", F.round(reward, 4).alias("reward"))


@query("severity_sort", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'HIGH' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'MEDIUM' ELSE 'LOW' END AS severity, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def severity_sort(t, spark):
    p = F.substring("o_orderpriority", 1, 1)
    s = F.when(p == "1", "HIGH").when(p.isin("2", "3"), "MEDIUM").otherwise("LOW")
    return t("orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", s.alias("severity"), "o_totalprice")
