"""Clauses, limits, triples, rule checks, label repair, samples and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clauses as C
from ..operators import params as P
from ..operators import sampling as S
from ..operators.graph import valid_graph
from .labels import _SPANS, _spans
from ..sources.tables import scratch
from .registry import query


@query("clause_levels")
def clause_levels(t, spark):
    """Documents as standards: their lines numbered in fives, then parsed again. Documents with few
    lines have fixed chunks."""
    pos = F.sequence(F.lit(0), F.size("lines") - 1)
    no = lambda i: F.concat((F.floor(i / 5) + 1).cast("string"), F.lit("."), (i % 5 + 1).cast("string"))
    named = F.transform(pos, lambda i: F.concat(F.when(i % 5 == 0, F.concat((F.floor(i / 5) + 1).cast("string"), F.lit(" Part\n"))).otherwise(""), no(i), F.lit(" "), F.get("lines", i)))
    docs = t("documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("source"), F.split("text", "\n").alias("lines"))
    return C.split_clauses(docs.select("source", F.array_join(named, "\n").alias("text")), body="a-zA-ZÀ-ÿ一-鿿").drop("text")


_PART_TEXT = "'深度不应大于' || p_size || '. Om，长度不得小于' || p_size || '00mm，重量不超过' || (p_size % 7) || 't；坡度不大于' || p_size || '%'"


def _part_text():
    p = F.col("p_size").cast("string")
    return F.concat(F.lit("深度不应大于"), p, F.lit(". Om，长度不得小于"), p, F.lit("00mm，重量不超过"), (F.col("p_size") % 7).cast("string"), F.lit("t；坡度不大于"), p, F.lit("%"))


_CLEAN = r"regexp_replace(regexp_replace(x, '([0-9])\s*[.．]\s*[Oo](\s*[a-zA-Z一-龥])', '\1.0\2', 'g'), '([0-9])\s*[.．]\s+([a-zA-Z一-龥])', '\1.0 \2', 'g')"
_BASES = "bases AS (SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{b}', {f})" for u, (b, f) in P.BASE.items()) + ") v(unit, base, factor))"
_LIMITS = f"""raw AS (SELECT p_partkey, {_PART_TEXT} AS x FROM part), cl AS (SELECT p_partkey, {_CLEAN} AS y FROM raw),
z AS (SELECT p_partkey, unnest(regexp_extract_all(y, '{P.LIMIT_PATTERN}', 1)) AS op, unnest(regexp_extract_all(y, '{P.LIMIT_PATTERN}', 2)) AS num, unnest(regexp_extract_all(y, '{P.LIMIT_PATTERN}', 3)) AS unit FROM cl),
lim AS (SELECT p_partkey, op, CASE WHEN op IN ({", ".join(f"'{u}'" for u in P.UPPER)}) THEN 'upper' ELSE 'lower' END AS direction, CAST(regexp_replace(num, '\\s', '', 'g') AS DOUBLE) AS value, unit FROM z)"""


@query("ocr_numbers", f"WITH raw AS (SELECT p_partkey, {_PART_TEXT} AS x FROM part) SELECT p_partkey, {_CLEAN} AS text FROM raw")
def ocr_numbers(t, spark):
    """Clause texts with misread numbers, made of the parts, and mended."""
    return t("part").select("p_partkey", P.clean_numbers(_part_text()).alias("text"))


@query("limit_extract", f"WITH {_LIMITS} SELECT * FROM lim")
def limit_extract(t, spark):
    return t("part").select("p_partkey", F.explode(P.limits(_part_text())).alias("l")).select("p_partkey", "l.*")


@query("limit_verdicts", f"""WITH {_LIMITS}, {_BASES}, tr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS value, ['m', 'mm', 't', 'kPa', 'x'][CAST(l_suppkey % 5 AS INT) + 1] AS unit FROM lineitem),
j AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a.base IS NULL OR b.base IS NULL OR a.base <> b.base THEN 0 WHEN CASE WHEN direction = 'upper' THEN round(tr.value * a.factor, 6) > round(lim.value * b.factor, 6) ELSE round(tr.value * a.factor, 6) < round(lim.value * b.factor, 6) END THEN 2 ELSE 1 END AS v
FROM tr JOIN lim ON p_partkey = l_partkey LEFT JOIN bases a ON a.unit = tr.unit LEFT JOIN bases b ON b.unit = lim.unit)
SELECT l_orderkey, l_linenumber, l_partkey, ['NA', 'OK', 'BAD'][max(v) + 1] AS verdict, count(*) AS n_checked FROM j GROUP BY 1, 2, 3""")
def limit_verdicts(t, spark):
    """Values with units against the limits of their part's clause: one that is broken decides, then one that is kept."""
    unit = F.element_at(F.array(*map(F.lit, ("m", "mm", "t", "kPa", "x"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    lim = t("part").select(F.col("p_partkey").alias("l_partkey"), P.limits(_part_text()).alias("limits"))
    each = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("value"), unit.alias("unit")).join(lim, "l_partkey")
    found = F.transform("limits", lambda x: P.verdict(F.col("value"), F.col("unit"), x))
    rows = each.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(found).alias("v"))
    out = rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("v").alias("v"), F.count("*").alias("n_checked"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(F.array(*map(F.lit, ("NA", "OK", "BAD"))), F.col("v") + 1).alias("verdict"), "n_checked")


_METRICS = ("开挖深度", "总荷载", "坡度", "工期", "桩长")
_CATS = (("基坑", "pit"), ("吊装", "lift"), ("模板", "form"))


def _sentences(t):
    """A sentence for each line item: a category word, a subject, a quantity's name and a value."""
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("sent"))
    word = F.element_at(F.array(*map(F.lit, ("基坑", "", "吊装", "", "模板", "", ""))), (F.col("l_partkey") % 7 + 1).cast("int"))
    metric = F.element_at(F.array(*map(F.lit, _METRICS)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("m", "kPa", "%", "mm"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    gap = F.when(F.col("l_quantity") % 5 == 0, "按照设计文件的要求应当达到约").otherwise("为")
    value = F.concat(F.when(F.col("l_quantity") > 40, "-").otherwise(""), F.col("l_quantity").cast("int").cast("string"))
    return l.select("l_orderkey", "sent", word.alias("word"), metric.alias("metric"), F.concat(word, F.lit("施工"), metric, gap, value, unit, F.lit("。")).alias("text"))


_SENT = f"""l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS sent FROM lineitem),
s AS (SELECT l_orderkey, sent, ['基坑', '', '吊装', '', '模板', '', ''][CAST(l_partkey % 7 AS INT) + 1] AS word, {list(_METRICS)}[CAST(l_suppkey % 5 AS INT) + 1] AS metric, ['m', 'kPa', '%', 'mm'][CAST(l_partkey % 4 AS INT) + 1] AS unit,
 l_quantity % 5 = 0 AS far, CASE WHEN l_quantity > 40 THEN -CAST(l_quantity AS INT) ELSE CAST(l_quantity AS INT) END AS v FROM l)"""
_FITS = "CASE metric WHEN '开挖深度' THEN unit IN ('m', 'mm') WHEN '总荷载' THEN unit = 'kPa' WHEN '坡度' THEN unit = '%' WHEN '桩长' THEN unit IN ('m', 'mm') ELSE TRUE END"


@query("param_triples", f"""WITH {_SENT}, c AS (SELECT *, nullif(word, '') AS own, lag(nullif(word, '')) OVER w AS before, lead(nullif(word, '')) OVER w AS after FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY sent))
SELECT l_orderkey, CAST(sent AS INT) AS sent, metric, CAST(CASE WHEN v < 0 AND metric IN ('开挖深度', '桩长') THEN -v ELSE v END AS DOUBLE) AS value, unit, CASE coalesce(own, before, after) WHEN '基坑' THEN 'pit' WHEN '吊装' THEN 'lift' WHEN '模板' THEN 'form' END AS category FROM c WHERE NOT far AND {_FITS}""")
def param_triples(t, spark):
    """Quantities with the value right behind them, where its unit fits; the category is the
    sentence's own, or that of the one before or after it; lengths are never negative."""
    s = _sentences(t)
    category = F.lit(None).cast("string")
    for word, name in reversed(_CATS):
        category = F.when(F.contains("text", F.lit(word)), name).otherwise(category)
    w = Window.partitionBy("l_orderkey").orderBy("sent")
    s = s.withColumn("own", category)
    s = s.withColumn("category", F.coalesce("own", F.lag("own").over(w), F.lead("own").over(w)))
    s = s.withColumn("found", P.value_after(F.expr("substring(text, instr(text, metric) + length(metric))"))).where(F.col("found").isNotNull() & P.dimension_fits(F.col("metric"), F.col("found.unit")))
    value = F.when(F.col("metric").rlike(P.POSITIVE), F.abs("found.value")).otherwise(F.col("found.value"))
    return s.select("l_orderkey", "sent", "metric", value.alias("value"), F.col("found.unit").alias("unit"), "category")


@query("triple_subjects", f"""WITH {_SPANS}, m AS (SELECT g, id, p, s FROM s WHERE type = 'N'), c AS (SELECT m.g, m.id, m.p, m.s, k.type, k.e, k.id AS kid FROM m JOIN s k ON k.g = m.g AND k.type IN ('A', 'R') AND k.e <= m.s)
SELECT g, id, p, arg_max(kid, (CASE type WHEN 'A' THEN 1 ELSE 0 END, e, kid)) AS subject FROM c GROUP BY 1, 2, 3""")
def triple_subjects(t, spark):
    """The nearest entity before each parameter, those of the preferred type first."""
    s = _spans(t)
    m = s.where("type = 'N'").select("g", "id", "p", F.col("s").alias("at"))
    k = s.where("type IN ('A', 'R')").select("g", F.col("type").alias("kind"), "e", F.col("id").alias("kid"))
    best = F.max_by("kid", F.struct((F.col("kind") == "A").cast("int"), "e", "kid"))
    return m.join(k, "g").where("e <= at").groupBy("g", "id", "p").agg(best.alias("subject"))


@query("char_map", r"""WITH c AS (SELECT doc_id, list_filter(string_split(text, ''), lambda x: x NOT IN (' ', '　')) AS kept, string_split(text, '') AS every FROM documents)
SELECT doc_id, CAST(len(kept) AS INT) AS n_kept, md5(array_to_string(kept, '')) AS digest, list_filter(list_transform(every, lambda x, i: CASE WHEN x NOT IN (' ', '　') THEN i - 1 END), lambda x: x IS NOT NULL)[10] AS tenth FROM c""")
def char_map(t, spark):
    """Texts without blanks, and where a kept character stood."""
    chars = F.split("text", "")
    kept = lambda c: ~c.isin(" ", "　") & (c != "")
    at = F.filter(F.transform(chars, lambda c, i: F.when(kept(c), i)), lambda i: i.isNotNull())
    return t("documents").select("doc_id", F.size(at).alias("n_kept"), F.md5(F.array_join(F.filter(chars, kept), "")).alias("digest"), F.get(at, F.lit(9)).cast("long").alias("tenth"))


@query("pretty_codes", r"""WITH k AS (SELECT p_partkey, ['JGJ-T', 'DG-TJ-', 'GB', 'X '][CAST(p_partkey % 4 AS INT) + 1] || (50000 + p_size) || '-' || (2000 + p_partkey % 25) AS no, p_name || ' / ' || p_type AS name FROM part)
SELECT p_partkey, CASE WHEN no LIKE 'JGJ-T%' THEN 'JGJ/T ' || ltrim(substr(no, 6), '-') WHEN no LIKE 'DG-TJ%' THEN 'DG/TJ ' || ltrim(substr(no, 6), '-') ELSE regexp_replace(no, '^([A-Za-z]+)([0-9].*)$', '\1 \2') END AS pretty,
regexp_replace(regexp_replace(no, '\s+', '', 'g'), '/', '-', 'g') || '_' || regexp_replace(name, '[\\/:*?"<>|\s]+', '', 'g') || '.pdf' AS file, array_to_string(list_transform(regexp_extract_all(no, '[0-9]+'), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS numbers FROM k""")
def pretty_codes(t, spark):
    """Numbers of standards as they are printed, as file names, and as arrays of numbers."""
    no = F.concat(F.element_at(F.array(*map(F.lit, ("JGJ-T", "DG-TJ-", "GB", "X "))), (F.col("p_partkey") % 4 + 1).cast("int")), (50000 + F.col("p_size")).cast("string"), F.lit("-"), (2000 + F.col("p_partkey") % 25).cast("string"))
    return t("part").select("p_partkey", T.pretty_code(no).alias("pretty"), F.concat(F.regexp_replace(F.regexp_replace(no, r"\s+", ""), "/", "-"), F.lit("_"), F.regexp_replace(F.concat_ws(" / ", "p_name", "p_type"), r'[\\/:*?"<>|\s]+', ""), F.lit(".pdf")).alias("file"), F.array_join(T.code_numbers(no), ",").alias("numbers"))


@query("numerals_to_digits", r"""WITH k AS (SELECT o_orderkey, CAST(o_orderkey % 100 AS INT) AS n FROM orders) SELECT o_orderkey, CAST(n AS VARCHAR) || '条' AS text FROM k WHERE n >= 1""")
def numerals_to_digits(t, spark):
    """Numerals in a text as digits: made from order numbers, read back."""
    n = (F.col("o_orderkey") % 100).cast("int")
    digit = lambda x: F.substring(F.lit("零一二三四五六七八九"), x + 1, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), n % 10
    written = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))
    return t("orders").where(n >= 1).select("o_orderkey", F.concat(T.chinese_number(written).cast("string"), F.lit("条")).alias("text"))


@query("fenced_json", r"""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Here: ```json' || chr(10) || props || chr(10) || '``` end {"k": -1}' WHEN 1 THEN props ELSE 'so ' || props || ' it is' END AS raw FROM events)
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM r JOIN events USING (event_id)""")
def fenced_json(t, spark):
    """A fenced block first, then the whole, then from the first brace to the last."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: ```json\n"), F.col("props"), F.lit('\n``` end {"k": -1}'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("so "), F.col("props"), F.lit(" it is")))
    return t("events").select("event_id", F.try_variant_get(T.loose_json(raw), "$.k", "int").alias("k"))


@query("citation_context", r"""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM conversations), b AS (SELECT conv_id, string_agg('[' || n || '] ' || substr(text, 1, 300), chr(10) ORDER BY n) AS context, '[' || string_agg(CAST(n AS VARCHAR), '][' ORDER BY n DESC) || ']' AS cited FROM c GROUP BY 1)
SELECT conv_id, md5(context) AS digest, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT unnest(regexp_extract_all(cited, '\[([0-9]+)\]', 1)) AS m)) AS marks FROM b""")
def citation_context(t, spark):
    """Numbered contexts of at most 300 characters a turn, and the marks that an answer cites."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t("conversations").select("conv_id", n.alias("n"), "text").select("conv_id", "n", F.concat(F.lit("["), F.col("n"), F.lit("] "), F.substring("text", 1, 300)).alias("line"))
    b = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    cited = F.concat_ws("", F.transform(F.reverse("x"), lambda r: F.concat(F.lit("["), r["n"], F.lit("]"))))
    marks = F.sort_array(F.array_distinct(F.regexp_extract_all(cited, F.lit(r"\[([0-9]+)\]"), F.lit(1))))
    return b.select("conv_id", F.md5(F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("digest"), F.array_join(marks, ",").alias("marks"))


@query("code_prefixes", r"""WITH k AS (SELECT DISTINCT 'GB' AS letters, list_transform(string_split(CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey % 3 AS VARCHAR), '-'), lambda x: CAST(x AS INT)) AS nums FROM part UNION SELECT DISTINCT 'GB', [p_size] FROM part WHERE p_size % 2 = 0)
SELECT array_to_string(a.nums, '-') AS shorter, array_to_string(b.nums, '-') AS longer FROM k a JOIN k b ON a.letters = b.letters AND a.nums <> b.nums AND list_slice(b.nums, 1, len(a.nums)) = a.nums""")
def code_prefixes(t, spark):
    """Codes whose numbers begin with all numbers of another: each looks its own prefixes up."""
    p = t("part")
    k = p.select(F.lit("GB").alias("letters"), F.array("p_size", (F.col("p_partkey") % 3).cast("int")).alias("nums")).union(p.where("p_size % 2 = 0").select(F.lit("GB"), F.array("p_size"))).distinct()
    pre = k.select("letters", F.col("nums").alias("long"), F.explode(F.transform(F.sequence(F.lit(1), F.size("nums") - 1), lambda i: F.slice("nums", F.lit(1), i))).alias("nums")).where(F.size("long") > 1)
    return pre.join(k, ["letters", "nums"]).select(F.array_join(F.transform("nums", lambda x: x.cast("string")), "-").alias("shorter"), F.array_join(F.transform("long", lambda x: x.cast("string")), "-").alias("longer"))


@query("scope_revert", """WITH e AS (SELECT l_suppkey AS k, l_returnflag = 'R' AS inside FROM lineitem), c AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE inside) AS kept FROM e GROUP BY 1)
SELECT k, n, kept, n >= 5 AND kept < greatest(2, CAST(floor(n * 0.2) AS BIGINT)) AS reverted, CASE WHEN n >= 5 AND kept < greatest(2, CAST(floor(n * 0.2) AS BIGINT)) THEN n ELSE kept END AS used FROM c""")
def scope_revert(t, spark):
    """A scope that leaves too little of five entities or more is given up."""
    c = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("kept"))
    reverted = (F.col("n") >= 5) & (F.col("kept") < F.greatest(F.lit(2), F.floor(F.col("n") * 0.2)))
    return c.select("k", "n", "kept", reverted.alias("reverted"), F.when(reverted, F.col("n")).otherwise(F.col("kept")).alias("used"))


@query("lexicon_merge", """WITH a AS (SELECT p_type AS type, p_name AS term, 1 AS prio, p_partkey AS pos FROM part WHERE p_size > 20 UNION ALL SELECT p_type, ' ' || p_name || ' ', 2, p_partkey FROM part WHERE p_size <= 30 UNION ALL SELECT p_type, ' ', 3, p_partkey FROM part)
SELECT type, trim(term) AS term, CAST(row_number() OVER (PARTITION BY type ORDER BY min(prio), arg_min(pos, (prio, pos))) AS INT) AS place FROM a WHERE trim(term) <> '' GROUP BY 1, 2""")
def lexicon_merge(t, spark):
    """Lexicons in order of precedence as one: stripped, distinct within a type, the first place of each counts."""
    p = t("part")
    own = lambda term, prio: p.select(F.col("p_type").alias("type"), term.alias("term"), F.lit(prio).alias("prio"), F.col("p_partkey").alias("pos"), "p_size")
    every = own(F.col("p_name"), 1).where("p_size > 20").union(own(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")), 2).where("p_size <= 30")).union(own(F.lit(" "), 3))
    first = every.select("type", F.trim("term").alias("term"), "prio", "pos").where("term <> ''").groupBy("type", "term").agg(F.min(F.struct("prio", "pos")).alias("first"))
    return first.select("type", "term", F.row_number().over(Window.partitionBy("type").orderBy("first")).alias("place"))


@query("candidate_harvest", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+ ?[a-zA-Z%]+')) AS cand FROM documents), d AS (SELECT DISTINCT doc_id, cand FROM m WHERE length(cand) BETWEEN 3 AND 20)
SELECT doc_id, cand FROM d""")
def candidate_harvest(t, spark):
    """Different candidates of a text by a pattern, within limits of length."""
    found = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+ ?[a-zA-Z%]+"), F.lit(0))), lambda c: F.length(c).between(3, 20))
    return t("documents").select("doc_id", F.explode(found).alias("cand"))


@query("judged_pairs", """WITH j AS (SELECT l_orderkey AS q, l_partkey AS c, l_returnflag AS verdict, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS file, l_linenumber AS line, l_suppkey FROM lineitem), last AS (SELECT q, c, arg_max(verdict, (file, line, l_suppkey)) AS verdict FROM j GROUP BY 1, 2),
k AS (SELECT o_orderkey AS q, p_partkey AS c FROM orders JOIN part ON p_partkey % 50 = o_orderkey % 50), m AS (SELECT k.q, k.c, verdict FROM k LEFT JOIN last USING (q, c)) SELECT coalesce(verdict, 'missing') AS verdict, count(*) AS n FROM m GROUP BY 1""")
def judged_pairs(t, spark):
    """Candidates with their judgement, of several files the last; those without one are counted."""
    last = t("lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("c")).agg(F.max_by("l_returnflag", F.struct(F.when(F.col("l_linestatus") == "F", 1).otherwise(2), "l_linenumber", "l_suppkey")).alias("verdict"))
    # A candidate is a pair of an order and a part of one remainder. Pairs aren't made: judged ones are looked up,
    # and all are counted as products of the remainders' counts.
    orders, parts = t("orders").select(F.col("o_orderkey").alias("q")), t("part").select(F.col("p_partkey").alias("c"))
    judged = last.where((F.col("q") % 50).eqNullSafe(F.col("c") % 50)).join(orders, "q").join(parts, "c").groupBy(F.coalesce("verdict", F.lit("missing")).alias("verdict")).agg(F.count("*").alias("n"))
    counts = lambda df, key, name: df.groupBy((F.col(key) % 50).alias("m")).agg(F.count("*").alias(name))  # noqa: E731  50 rows
    every = counts(orders, "q", "a").join(counts(parts, "c", "b"), "m").select(F.lit("missing").alias("verdict"), (F.col("a") * F.col("b")).alias("n"))
    less = judged.select(F.lit("missing").alias("verdict"), F.negative("n").alias("n"))
    return judged.unionByName(every).unionByName(less).groupBy("verdict").agg(F.sum("n").alias("n")).where("n > 0")


@query("label_arbitration", f"""WITH {_SPANS}, a AS (SELECT * FROM s WHERE who = 'gold'), v AS (SELECT * FROM s WHERE who = 'model'),
x AS (SELECT v.g, v.type, v.id, v.p, v.s, v.e, count(a.g) AS aligned FROM v LEFT JOIN a ON a.g = v.g AND a.type = v.type AND a.s < v.e AND v.s < a.e GROUP BY ALL)
SELECT g, type, s, e, CASE WHEN aligned > 0 THEN 'keep' ELSE 'conflict' END AS verdict, count(*) AS n FROM x GROUP BY ALL UNION ALL
SELECT g, type, s, e, 'missed', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM v WHERE a.g = v.g AND a.type = v.type AND a.s < v.e AND v.s < a.e) GROUP BY ALL""")
def label_arbitration(t, spark):
    """Spans that the authority shares are kept, others are conflicts; what only the authority has was missed."""
    s = _spans(t)
    a, v = s.where("who = 'gold'"), s.where("who = 'model'")
    key = ["g", "type"]
    meets = lambda x, y: x.join(y.select(*key, F.col("s").alias("s2"), F.col("e").alias("e2")).distinct(), key).where("s < e2 AND s2 < e").select("g", "type", "s", "e").distinct()
    held = v.groupBy("g", "type", "s", "e").agg(F.count("*").alias("n")).join(meets(v, a).withColumn("ok", F.lit(True)), ["g", "type", "s", "e"], "left")
    kept = held.select("g", "type", "s", "e", F.when(F.col("ok"), "keep").otherwise("conflict").alias("verdict"), "n")
    missed = a.join(meets(a, v), ["g", "type", "s", "e"], "left_anti").groupBy("g", "type", "s", "e").agg(F.count("*").alias("n"))
    return kept.unionByName(missed.withColumn("verdict", F.lit("missed")).select(kept.columns))


@query("complete_labels", f"""WITH {_SPANS}, a AS (SELECT * FROM s WHERE who = 'gold') SELECT g, type, id, p, s, e FROM s m WHERE who = 'model' AND type <> 'N' AND p % 10 >= 3 AND NOT EXISTS (SELECT 1 FROM a WHERE a.g = m.g AND a.s < m.e AND m.s < a.e)""")
def complete_labels(t, spark):
    """Spans of other types with enough margin that touch no label."""
    s = _spans(t)
    a = s.where("who = 'gold'").select(F.col("g").alias("g2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return s.where("who = 'model' AND type <> 'N' AND p % 10 >= 3").join(a, (F.col("g") == F.col("g2")) & F.expr("s < e2 AND s2 < e"), "left_anti").select("g", "type", "id", "p", "s", "e")


@query("pseudo_review", """WITH e AS (SELECT l_orderkey AS g, l_linenumber AS id, l_partkey, p_name AS term, l_returnflag AS type, l_quantity AS len, p_size FROM lineitem JOIN part ON p_partkey = l_partkey), pairs AS (SELECT DISTINCT p_name AS term, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE 'N' END AS type FROM part WHERE p_size > 25), one AS (SELECT term, min(type) AS type FROM pairs GROUP BY 1),
r AS (SELECT e.*, pairs.term IS NOT NULL AS agreed, one.type AS other, CASE WHEN len < 2 THEN 'fragment' WHEN len > 45 THEN 'too_long' WHEN e.term LIKE 'cold%' THEN 'generic' WHEN e.type = 'N' AND p_size % 2 = 1 THEN 'no_value' END AS bad FROM e LEFT JOIN pairs ON pairs.term = e.term AND pairs.type = e.type LEFT JOIN one ON one.term = e.term)
SELECT g, id, l_partkey, coalesce(bad, CASE WHEN agreed THEN 'kept' WHEN other IS NOT NULL THEN 'retyped' ELSE 'no_consensus' END) AS verdict, CASE WHEN bad IS NULL THEN CASE WHEN agreed THEN type ELSE other END END AS type FROM r""")
def pseudo_review(t, spark):
    """Pseudo labels against rules and a lexicon: a wrong type gives way to the lexicon's."""
    part = t("part")
    pairs = part.where("p_size > 25").select(F.col("p_name").alias("term"), F.element_at(F.array(*map(F.lit, "ARN")), F.col("p_size") % 3 + 1).alias("type")).distinct()
    one = pairs.groupBy("term").agg(F.min("type").alias("other"))
    e = t("lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("term"), "p_size"), "l_partkey").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("id"), "l_partkey", "term", F.col("l_returnflag").alias("type"), "l_quantity", "p_size")
    r = e.join(pairs.withColumn("agreed", F.lit(True)), ["term", "type"], "left").join(one, "term", "left")
    bad = F.when(F.col("l_quantity") < 2, "fragment").when(F.col("l_quantity") > 45, "too_long").when(F.col("term").startswith("cold"), "generic").when((F.col("type") == "N") & (F.col("p_size") % 2 == 1), "no_value")
    good = F.when(F.col("agreed"), "kept").when(F.col("other").isNotNull(), "retyped").otherwise("no_consensus")
    return r.select("g", "id", "l_partkey", F.coalesce(bad, good).alias("verdict"), F.when(bad.isNull(), F.when(F.col("agreed"), F.col("type")).otherwise(F.col("other"))).alias("type"))


@query("expert_fixes", """WITH e AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS s, l_returnflag AS type, p_name AS frag FROM lineitem JOIN part ON p_partkey = l_partkey), o AS (SELECT o_orderkey AS g FROM orders WHERE o_orderpriority LIKE '1%')
SELECT DISTINCT g, s, CASE WHEN g IN (SELECT g FROM o) THEN 'OVERRIDE' WHEN type = 'A' AND frag LIKE '%bolt' THEN 'R' ELSE type END AS type FROM e WHERE g IN (SELECT g FROM o) OR NOT (type = 'A' AND frag LIKE 'hot%' OR type = 'N' AND NOT contains(frag, 'e'))""")
def expert_fixes(t, spark):
    """An expert's rules over labels: drop, retype, keep one of equal ones; overrides of a text win."""
    e = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("frag")), "l_partkey").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("s"), F.col("l_returnflag").alias("type"), "frag").distinct()
    over = t("orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("g"), F.lit(True).alias("over"))
    j = e.join(over, "g", "left").withColumn("over", F.coalesce("over", F.lit(False)))
    dropped = ((F.col("type") == "A") & F.col("frag").startswith("hot")) | ((F.col("type") == "N") & ~F.contains("frag", F.lit("e")))
    kind = F.when(F.col("over"), "OVERRIDE").when((F.col("type") == "A") & F.col("frag").endswith("bolt"), "R").otherwise(F.col("type"))
    return j.where(F.col("over") | ~dropped).select("g", "s", kind.alias("type")).distinct()


@query("fragment_places", """SELECT doc_id, CAST(strpos(text, 'th') - 1 AS INT) AS first_th, CAST(CASE WHEN strpos(text, 'th') > 0 AND strpos(substr(text, strpos(text, 'th') + 2), 'th') > 0 THEN strpos(text, 'th') + strpos(substr(text, strpos(text, 'th') + 2), 'th') ELSE -1 END AS INT) AS second_th FROM documents WHERE strpos(text, 'th') > 0""")
def fragment_places(t, spark):
    """Places for a text's fragments, each the first that no earlier one has taken."""
    from ..operators.spans import allocate

    got = allocate(t("documents").select("doc_id", "text"), ["th", "th"])
    return got.where(F.get("places", F.lit(0)) >= 0).select("doc_id", F.get("places", F.lit(0)).alias("first_th"), F.get("places", F.lit(1)).alias("second_th"))


@query("leak_substring", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, split_part(p.p_name, ' ', 1)))")
def leak_substring(t, spark):
    """Texts that no test text holds: all different ones are looked for in one pass."""
    from ..operators.retrieval import held

    p = t("part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("text"))
    return p.join(held(t("documents").select("text"), p), "text", "left_anti").select("p_partkey")


@query("evidence_lookup", """WITH k AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), c AS (SELECT s_suppkey, s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier WHERE contains(s_name, '1'))
SELECT n_nationkey, coalesce(s_name, 'made up for ' || n_name) AS evidence, s_suppkey IS NULL AS synthetic FROM k LEFT JOIN c ON s_nationkey = n_nationkey AND rn <= 2""")
def evidence_lookup(t, spark):
    """The first two records of a source that hold a word, or a made one."""
    rn = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    c = t("supplier").where(F.contains("s_name", F.lit("1"))).select(F.col("s_nationkey").alias("n_nationkey"), "s_name", rn.alias("rn")).where("rn <= 2")
    return t("nation").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("s_name", F.concat(F.lit("made up for "), F.col("n_name"))).alias("evidence"), F.col("s_name").isNull().alias("synthetic"))


@query("risk_basis", """WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'HIGH' WHEN o_orderpriority LIKE '2%' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM orders), b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rn FROM lineitem)
SELECT r.o_orderkey, severity, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rn), '') AS basis FROM r LEFT JOIN b ON l_orderkey = o_orderkey AND rn <= 2 WHERE severity <> 'LOW' GROUP BY 1, 2""")
def risk_basis(t, spark):
    """Risks that matter, each with its two best texts in order."""
    p = F.substring("o_orderpriority", 1, 1)
    r = t("orders").select("o_orderkey", F.when(p == "1", "HIGH").when(p == "2", "MEDIUM").otherwise("LOW").alias("severity")).where("severity <> 'LOW'")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber"))
    b = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", rn.alias("rn")).where("rn <= 2").groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("basis"))
    return r.join(b, "o_orderkey", "left").select("o_orderkey", "severity", F.coalesce("basis", F.lit("")).alias("basis"))


@query("benchmark_summary", """WITH c AS (SELECT l_suppkey AS case_id, l_returnflag AS chk, count(*) AS golden, count(*) FILTER (WHERE l_discount < 0.03) AS missed, CASE WHEN count(*) FILTER (WHERE l_tax > 0.05) > 0 THEN avg(l_quantity) FILTER (WHERE l_tax > 0.05) END AS score FROM lineitem GROUP BY 1, 2)
SELECT chk, count(DISTINCT case_id) AS cases, round(avg(score), 4) AS mean_score, count(score) AS with_score, CAST(sum(golden) AS BIGINT) AS golden, CAST(sum(missed) AS BIGINT) AS missed, round(sum(missed) / CAST(sum(golden) AS DOUBLE), 6) AS fnr FROM c GROUP BY 1""")
def benchmark_summary(t, spark):
    """Means over the cases that have a value, and rates over all findings, for each check."""
    c = t("lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("chk")).agg(F.count("*").alias("golden"), F.count_if(F.col("l_discount") < 0.03).alias("missed"), F.avg(F.when(F.col("l_tax") > 0.05, F.col("l_quantity"))).alias("score"))
    return c.groupBy("chk").agg(F.countDistinct("case_id").alias("cases"), F.round(F.avg("score"), 4).alias("mean_score"), F.count("score").alias("with_score"), F.sum("golden").alias("golden"), F.sum("missed").alias("missed"), F.round(F.sum("missed") / F.sum("golden"), 6).alias("fnr"))


@query("suspicious_first", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS src, CAST(l_discount >= 0.09 AS INT) + CAST(l_quantity >= 48 AS INT) AS n_reasons, CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8) AS BIGINT) AS h FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY src, n_reasons > 0 ORDER BY n_reasons DESC, h, l_orderkey, l_linenumber, l_partkey) AS rn FROM r) SELECT src, l_orderkey, l_linenumber, l_partkey, n_reasons FROM a WHERE rn <= CASE WHEN n_reasons > 0 THEN 30 ELSE 20 END""")
def suspicious_first(t, spark):
    """Of each source 30 rows with reasons for doubt (60 %), most reasons first, and 20 others by hash."""
    n = (F.col("l_discount") >= 0.09).cast("int") + (F.col("l_quantity") >= 48).cast("int")
    r = t("lineitem").select(F.col("l_returnflag").alias("src"), "l_orderkey", "l_linenumber", "l_partkey", n.alias("n_reasons"), S.hash_number(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")).alias("h"))
    w = Window.partitionBy("src", F.col("n_reasons") > 0).orderBy(F.desc("n_reasons"), "h", "l_orderkey", "l_linenumber", "l_partkey")
    return r.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 30).where((F.col("n_reasons") > 0) | (F.col("rn") <= 20)).select("src", "l_orderkey", "l_linenumber", "l_partkey", "n_reasons")


@query("replay_mix", """WITH new AS (SELECT doc_id FROM documents WHERE source LIKE '%1%'), old AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|replay'), doc_id) AS rn FROM documents WHERE source NOT LIKE '%1%') SELECT doc_id, 'new' AS part FROM new UNION ALL SELECT doc_id, 'replay' FROM old WHERE rn <= 60""")
def replay_mix(t, spark):
    """All new rows, and sixty old ones by hash, which the mix replays."""
    d = t("documents").select("doc_id", "source")
    new = F.contains("source", F.lit("1"))
    old = d.where(~new).orderBy(S.hash_order(F.col("doc_id"), "replay"), "doc_id").limit(60)
    return d.where(new).select("doc_id", F.lit("new").alias("part")).unionByName(old.select("doc_id", F.lit("replay").alias("part")))


@query("mix_with_replacement", """WITH base AS (SELECT count(*) AS n FROM labels), c AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE length(trim(text)) >= 30), m AS (SELECT count(*) AS k FROM c), r AS (SELECT unnest(range(0, CAST(floor(n * 0.1 / 0.9) AS BIGINT))) AS draw FROM base)
SELECT draw, md5(substr(trim(text), 1, 300)) AS digest FROM r, m JOIN c ON TRUE WHERE c.i = CAST('0x' || substr(md5('123|' || draw), 1, 8) AS BIGINT) % k""")
def mix_with_replacement(t, spark):
    """A tenth of general texts drawn with replacement: draws name places by hash. Texts are numbered
    by the counts of their partitions, not in one task."""
    c = t("documents").where(F.length(F.trim("text")) >= 30).select("doc_id", "text")
    k, n = c.count(), int(t("labels").count() * 0.1 / 0.9)
    draws = spark.range(n).select(F.col("id").alias("draw"), (S.hash_number(F.concat(F.lit("123|"), F.col("id").cast("string"))) % max(1, k)).alias("i"))
    return draws.join(S.numbered(c, "doc_id"), "i").select("draw", F.md5(F.substring(F.trim("text"), 1, 300)).alias("digest"))


@query("subgraph_merge", """WITH a AS (SELECT o_custkey AS src, o_orderkey AS dst, 'PLACED' AS type FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS src, o_orderkey AS dst, 'PLACED' AS type FROM orders WHERE o_orderkey % 3 = 0) SELECT src, dst, type FROM a UNION SELECT src, dst, type FROM b""")
def subgraph_merge(t, spark):
    """Two subgraphs as one: edges with both ends, once."""
    e = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst"), F.lit("PLACED").alias("type"), "o_orderkey")
    both = e.where("o_orderkey % 2 = 0").unionByName(e.where("o_orderkey % 3 = 0")).drop("o_orderkey")
    nodes = both.select(F.explode(F.array("src", "dst")).alias("id"))
    _, edges = valid_graph(nodes, both)
    return edges.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"), "type")


@query("bounded_scan", "WITH n AS (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50), e AS (SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 150) SELECT o_custkey, o_orderkey, o_custkey IN (SELECT c_custkey FROM n) AS inside FROM e")
def bounded_scan(t, spark):
    """A graph's first 50 nodes and three times as many edges, by id."""
    n = t("customer").select(F.col("c_custkey").alias("o_custkey")).orderBy("o_custkey").limit(50).withColumn("inside", F.lit(True))
    e = t("orders").select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey").limit(150)
    return e.join(n, "o_custkey", "left").select("o_custkey", "o_orderkey", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("graph_load_batches", "WITH e AS (SELECT 'PLACED' AS type, o_orderkey FROM orders UNION ALL SELECT 'LINE', l_orderkey FROM lineitem) SELECT type, count(*) AS n, CAST(ceil(count(*) / 500.0) AS BIGINT) AS batches FROM e GROUP BY 1")
def graph_load_batches(t, spark):
    """What a load in batches of 500 of one label is made of; equal edges are loaded twice."""
    e = t("orders").select(F.lit("PLACED").alias("type")).unionByName(t("lineitem").select(F.lit("LINE").alias("type")))
    return e.groupBy("type").agg(F.count("*").alias("n"), F.ceil(F.count("*") / 500).alias("batches"))


@query("param_errors", f"""WITH {_SPANS}, gd AS (SELECT g, s, e, count(*) AS n FROM s WHERE who = 'gold' AND type = 'N' GROUP BY ALL), pd AS (SELECT g, s, e, count(*) AS n FROM s WHERE who = 'model' AND type = 'N' GROUP BY ALL), ot AS (SELECT DISTINCT g, s, e FROM s WHERE who = 'model' AND type <> 'N'),
k AS (SELECT gd.*, EXISTS (SELECT 1 FROM pd WHERE pd.g = gd.g AND pd.s = gd.s AND pd.e = gd.e) AS exact, EXISTS (SELECT 1 FROM pd WHERE pd.g = gd.g AND pd.s < gd.e AND gd.s < pd.e) AS near, EXISTS (SELECT 1 FROM ot WHERE ot.g = gd.g AND ot.s < gd.e AND gd.s < ot.e) AS other FROM gd)
SELECT CASE WHEN exact THEN 'exact' WHEN near THEN 'boundary' WHEN other THEN 'type_confused' ELSE 'missed' END AS kind, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT 'spurious', count(*) FROM pd WHERE NOT EXISTS (SELECT 1 FROM gd WHERE gd.g = pd.g AND gd.s < pd.e AND pd.s < gd.e)""")
def param_errors(t, spark):
    """How each gold parameter fared, by the best that meets it, and predictions that meet none."""
    s = _spans(t)
    gold = s.where("who = 'gold' AND type = 'N'").select("g", "s", "e").distinct()
    other = s.where("who = 'model'").select("g", F.col("s").alias("s2"), F.col("e").alias("e2"), (F.col("type") == "N").alias("same")).distinct()
    meets = gold.join(other, "g").where("s < e2 AND s2 < e")
    rank = F.when(F.col("same") & F.expr("s = s2 AND e = e2"), 3).when(F.col("same"), 2).otherwise(1)
    fared = gold.join(meets.groupBy("g", "s", "e").agg(F.max(rank).alias("r")), ["g", "s", "e"], "left")
    kind = F.element_at(F.array(*map(F.lit, ("missed", "type_confused", "boundary", "exact"))), F.coalesce("r", F.lit(0)) + 1)
    pred = other.where("same").select("g", F.col("s2").alias("s"), F.col("e2").alias("e"))
    alone = pred.join(meets.where("same").select("g", F.col("s2").alias("s"), F.col("e2").alias("e")).distinct(), ["g", "s", "e"], "left_anti")
    return fared.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).unionByName(alone.agg(F.count("*").alias("n")).select(F.lit("spurious").alias("kind"), "n"))


@query("loose_f1", """WITH g AS (SELECT DISTINCT l_orderkey AS k, p_name AS t FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F'), p AS (SELECT DISTINCT l_orderkey AS k, split_part(p_name, ' ', 1) AS t FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus <> 'F'),
h AS (SELECT g.k, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p WHERE p.k = g.k AND (contains(g.t, p.t) OR contains(p.t, g.t)))) AS hit, count(*) AS n FROM g GROUP BY 1), c AS (SELECT k, count(*) AS m FROM p GROUP BY 1)
SELECT k, hit, n AS golden, coalesce(m, 0) AS pred, round(CASE WHEN hit = 0 THEN 0 ELSE 2.0 * hit / (n + coalesce(m, 0)) END, 6) AS f1 FROM h LEFT JOIN c USING (k)""")
def loose_f1(t, spark):
    """Entities count as found where one holds the other."""
    j = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select(F.col("l_orderkey").alias("k"), "p_name", "l_linestatus")
    g = j.where("l_linestatus = 'F'").select("k", F.col("p_name").alias("t")).distinct()
    p = j.where("l_linestatus <> 'F'").select("k", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("t2")).distinct()
    hit = g.join(p, "k").where(F.contains("t", "t2") | F.contains("t2", "t")).select("k", "t").distinct().groupBy("k").agg(F.count("*").alias("hit"))
    n = g.groupBy("k").agg(F.count("*").alias("golden")).join(p.groupBy("k").agg(F.count("*").alias("pred")), "k", "left").join(hit, "k", "left").fillna(0, ["pred", "hit"])
    return n.select("k", "hit", "golden", "pred", F.round(2.0 * F.col("hit") / (F.col("golden") + F.col("pred")), 6).alias("f1"))


@query("policy_terms", """WITH x AS (SELECT event_id, value / 500 AS p, (user_id % 11 - 5) / 10.0 AS d, CASE WHEN event_type = 'error' THEN -1.0 ELSE 1.0 END AS adv FROM events)
SELECT event_id, round(-least(exp(d) * adv, least(greatest(exp(d), 0.8), 1.2) * adv), 6) AS clipped, round(exp(-d) + d - 1, 6) AS kl, round(-power(1 - greatest(p, 1e-6), 2) * ln(greatest(p, 1e-6)), 6) AS focal, round(greatest(0, 0.2 - d), 6) AS margin FROM x""")
def policy_terms(t, spark):
    """Terms of losses as columns: clipped policy ratio, the k3 estimate of divergence, focal loss, margin rank."""
    d, p = (F.col("user_id") % 11 - 5) / 10.0, F.greatest(F.col("value") / 500, F.lit(1e-6))
    adv, ratio = F.when(F.col("event_type") == "error", -1.0).otherwise(1.0), F.exp(d)
    clipped = -F.least(ratio * adv, F.least(F.greatest(ratio, F.lit(0.8)), F.lit(1.2)) * adv)
    return t("events").select("event_id", F.round(clipped, 6).alias("clipped"), F.round(F.exp(-d) + d - 1, 6).alias("kl"), F.round(-F.pow(1 - p, F.lit(2)) * F.log(p), 6).alias("focal"), F.round(F.greatest(F.lit(0.0), 0.2 - d), 6).alias("margin"))


@query("contrastive_loss", """WITH s AS (SELECT l_orderkey AS q, l_extendedprice / 10000 AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1 AS pos FROM lineitem) SELECT q, round(ln(sum(exp(x))) - max(x) FILTER (WHERE pos), 6) AS loss FROM s GROUP BY 1""")
def contrastive_loss(t, spark):
    """Log of a question's summed scores, less that of its positive."""
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) == 1
    s = t("lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_extendedprice") / 10000).alias("x"), pos.alias("pos"))
    return s.groupBy("q").agg(F.round(F.log(F.sum(F.exp("x"))) - F.max(F.when(F.col("pos"), F.col("x"))), 6).alias("loss"))


_DIMS = (("depth", ("der", "die")), ("load", ("que", "los")), ("rule", ("the", "of")))


@query("structured_queries", """WITH d AS (SELECT conv_id, turn, lower(text) AS q, regexp_extract(text, '([0-9]+)', 1) AS cap FROM conversations), h AS (SELECT *, CAST(contains(q, 'der') OR contains(q, 'die') AS INT) + CAST(contains(q, 'que') OR contains(q, 'los') AS INT) + CAST(contains(q, 'the') OR contains(q, 'of') AS INT) AS n, CASE WHEN contains(q, 'heit') THEN 'lift' WHEN contains(q, 'tion') THEN 'pit' END AS category FROM d)
SELECT conv_id, turn, category, CASE WHEN category IS NOT NULL AND n = 0 THEN 3 ELSE n END AS dims, n >= 2 OR (category IS NOT NULL) AS structured, coalesce(category = 'lift' AND try_cast(cap AS DOUBLE) * 9.8 >= 100, FALSE) AS super FROM h""")
def structured_queries(t, spark):
    """Which slots a question fills, and whether that makes it a structured one; a category alone asks
    for all of them."""
    q = F.lower("text")
    n = sum((F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w)).cast("int") for _, words in _DIMS), F.lit(0))
    category = F.when(F.contains(q, F.lit("heit")), "lift").when(F.contains(q, F.lit("tion")), "pit")
    dims = F.when(category.isNotNull() & (n == 0), len(_DIMS)).otherwise(n)
    heavy = (category == "lift") & (F.regexp_extract("text", "([0-9]+)", 1).try_cast("double") * 9.8 >= 100)
    return t("conversations").select("conv_id", "turn", category.alias("category"), dims.alias("dims"), ((dims >= 2) | (category.isNotNull() & (dims >= 1))).alias("structured"), F.coalesce(heavy, F.lit(False)).alias("super"))


@query("brief", """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) SELECT o_custkey, substr(string_agg(o_orderpriority || ' #' || o_orderkey, chr(10) ORDER BY rn), 1, 4800) AS brief FROM r WHERE rn <= 20 GROUP BY 1""")
def brief(t, spark):
    """Twenty findings at most, the gravest first, in 4,800 characters at most."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey"))
    r = t("orders").select("o_custkey", rn.alias("rn"), F.concat("o_orderpriority", F.lit(" #"), F.col("o_orderkey").cast("string")).alias("line")).where("rn <= 20")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"])
    return r.groupBy("o_custkey").agg(F.substring(F.array_join(lines, "\n"), 1, 4800).alias("brief"))


@query("graph_words", """WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS w FROM benchmark), x AS (SELECT item_id, unnest(w) AS term FROM q),
whole AS (SELECT DISTINCT item_id, n_nationkey FROM x JOIN nation ON lower(n_name) = term)
SELECT * FROM whole UNION ALL SELECT DISTINCT item_id, n_nationkey FROM x JOIN nation ON contains(lower(n_name), term) WHERE item_id NOT IN (SELECT item_id FROM whole)""")
def graph_words(t, spark):
    """Seeds of a graph search: nodes whose whole name a question has, else those that have one of its words in their name."""
    words = F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda w: F.length(w) >= 3)
    x = t("benchmark").select("item_id", F.explode(words).alias("term"))
    grams = t("nation").select("n_nationkey", F.lower("n_name").alias("name"))
    part = grams.select("n_nationkey", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.transform(F.sequence(F.lit(3), F.length("name") - i + 1), lambda n: F.substring("name", i, n))))).alias("term"))
    whole = x.join(grams.withColumnRenamed("name", "term"), "term").select("item_id", "n_nationkey").distinct()
    other = x.join(part.distinct(), "term").select("item_id", "n_nationkey").distinct()
    return whole.unionByName(other.join(whole.select("item_id"), "item_id", "left_anti"))


@query("alias_upsert", "WITH have AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0), new AS (SELECT n_name AS name, n_regionkey FROM nation) SELECT new.name, r_name AS source FROM new JOIN region ON r_regionkey = n_regionkey WHERE name NOT IN (SELECT name FROM have)")
def alias_upsert(t, spark):
    """Sources that a graph lacks are added, those it has stay."""
    have = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    new = t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("r_regionkey")).join(have, "name", "left_anti")
    return new.join(t("region"), "r_regionkey").select("name", F.col("r_name").alias("source"))


@query("rule_layer", r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM documents), a AS (SELECT doc_id, count(*) AS numbers FROM n GROUP BY 1), k AS (SELECT doc_id, CASE WHEN contains(text, 'then') THEN 'then' WHEN contains(text, 'the') THEN 'the' END AS article, CASE WHEN contains(text, 'heit') THEN 'heit' WHEN contains(text, 'und') THEN 'und' END AS noun FROM documents)
SELECT doc_id, coalesce(numbers, 0) AS numbers, article, noun FROM k LEFT JOIN a USING (doc_id)""")
def rule_layer(t, spark):
    """Patterns, and of each category its longest word that a text holds, with full confidence."""
    first = lambda words: F.coalesce(*(F.when(F.contains("text", F.lit(w)), w) for w in sorted(words, key=len, reverse=True)))
    return t("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"), first(("the", "then")).alias("article"), first(("und", "heit")).alias("noun"))


@query("zip_rows", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) SELECT a.n, a.doc_id FROM a JOIN b ON a.n = b.n AND a.doc_id = b.doc_id")
def zip_rows(t, spark):
    """A table and a copy of it in JSON lines, row by row; unequal rows fail the query."""
    path = scratch(spark, "copy")
    own = S.numbered(t("documents").select("doc_id"), "doc_id")
    own.select("i", "doc_id").write.json(path)
    copy = spark.read.schema("i long, doc_id long").json(path)
    return S.zipped(own, copy, "i", "doc_id").select((F.col("i") + 1).alias("n"), "doc_id")
