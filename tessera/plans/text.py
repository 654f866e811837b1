"""Cleaning, projection and chunking queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators.clauses import number_key_column
from .registry import query

_ID = "doc_id"


def _lines(docs):
    return docs.select(_ID, F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '　，；：（）！？．', ' ,;:()!?.'),
  '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '([0-9]) ?\. ?([0-9])', '\1.\2', 'g'), '[-=_*~]{4,}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))"""


@query("clean_text", f"SELECT doc_id, length({_CLEAN}) AS n_clean, md5({_CLEAN}) AS digest FROM documents")
def clean_text(t, spark):
    c = T.clean_text(F.col("text"))
    return t("documents").select(_ID, F.length(c).cast("long").alias("n_clean"), F.md5(c).alias("digest"))


@query("strip_boilerplate", f"""WITH {_LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(line)) AS times FROM lines),
kept AS (SELECT *, NOT ((length(trim(line)) < 40 AND times >= 4 AND trim(line) <> '') OR regexp_matches(trim(line), '^[-— ]*[0-9]+[-— ]*$')) AS keep FROM n)
SELECT doc_id, count(*) FILTER (WHERE keep) AS n_kept, count(*) FILTER (WHERE NOT keep) AS n_dropped,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS digest FROM kept GROUP BY doc_id""")
def strip_boilerplate(t, spark):
    """Drops short lines that a document repeats four times or more, and page numbers."""
    line = F.trim("line")
    times = F.count(F.lit(1)).over(Window.partitionBy(_ID, line))
    junk = ((F.length(line) < 40) & (times >= 4) & (line != "")) | line.rlike("^[-— ]*[0-9]+[-— ]*$")
    kept = _lines(t("documents")).withColumn("keep", ~junk)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return kept.groupBy(_ID).agg(F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_dropped"), F.md5(text).alias("digest"))


@query("strip_page_boilerplate", f"""WITH {_LINES}, l AS (SELECT doc_id, pos, trim(line) AS line, pos // 8 AS page FROM lines WHERE trim(line) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS head, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS tail FROM l),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
edge AS (SELECT doc_id, line, sum(CAST(head <= 2 AS INT) + CAST(tail <= 2 AS INT)) AS times FROM r GROUP BY 1, 2),
drop_ AS (SELECT e.doc_id, e.line FROM edge e JOIN p USING (doc_id) WHERE pages >= 6 AND times >= greatest(3, floor(0.3 * pages)))
SELECT l.doc_id, count(*) AS n_lines, count(d.line) AS n_dropped FROM l LEFT JOIN drop_ d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY 1""")
def strip_page_boilerplate(t, spark):
    """Lines that stand first or last on many pages of a document (pages: eight lines each)."""
    own = _lines(t("documents")).select(_ID, "pos", F.trim("line").alias("line"), F.expr("pos div 8").alias("page")).where("line <> ''")
    page = Window.partitionBy(_ID, "page")
    head, tail = F.row_number().over(page.orderBy("pos")), F.row_number().over(page.orderBy(F.desc("pos")))
    edge = own.withColumn("n", (head <= 2).cast("int") + (tail <= 2).cast("int")).groupBy(_ID, "line").agg(F.sum("n").alias("times"))
    pages = own.groupBy(_ID).agg(F.countDistinct("page").alias("pages"))
    gone = edge.join(pages, _ID).where((F.col("pages") >= 6) & (F.col("times") >= F.greatest(F.lit(3), F.floor(0.3 * F.col("pages"))))).select(_ID, F.col("line").alias("gone"))
    joined = own.join(gone.withColumnRenamed(_ID, "d"), (F.col(_ID) == F.col("d")) & (F.col("line") == F.col("gone")), "left")
    return joined.groupBy(_ID).agg(F.count(F.lit(1)).alias("n_lines"), F.count("gone").alias("n_dropped"))


@query("toc_pages", f"""WITH {_LINES}, l AS (SELECT doc_id, trim(line) AS line, pos // 8 AS page FROM lines WHERE trim(line) <> ''),
p AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '\\.{{3,}}|…')) AS dotted, count(*) FILTER (WHERE length(line) < 40) AS short,
  list_sort(list(length(line)))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_median, avg(length(line)) AS mean FROM l GROUP BY 1, 2)
SELECT doc_id, page, n, dotted, CAST(upper_median AS BIGINT) AS upper_median, (dotted > 0.3 * n) OR (mean < 12 AND n > 15) OR (n >= 6 AND short > 0.85 * n AND upper_median < 15) AS toc FROM p""".replace("{{", "{").replace("}}", "}").replace("\\\\", "\\"))
def toc_pages(t, spark):
    """Pages that look like a table of contents: leader dots, or many short lines. The median is the upper one."""
    own = _lines(t("documents")).select(_ID, F.trim("line").alias("line"), F.expr("pos div 8").cast("long").alias("page")).where("line <> ''")
    size = F.length("line")
    p = own.groupBy(_ID, "page").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("line").rlike(r"\.{3,}|…")).alias("dotted"), F.count_if(size < 40).alias("short"),
        F.element_at(F.sort_array(F.collect_list(size)), F.expr("cast(count(1) div 2 as int) + 1")).cast("long").alias("upper_median"), F.avg(size).alias("mean"),
    )
    toc = (F.col("dotted") > 0.3 * F.col("n")) | ((F.col("mean") < 12) & (F.col("n") > 15)) | ((F.col("n") >= 6) & (F.col("short") > 0.85 * F.col("n")) & (F.col("upper_median") < 15))
    return p.select(_ID, "page", "n", "dotted", "upper_median", toc.alias("toc"))


@query("text_quality", r"""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 1.0 ELSE 1 - length(regexp_replace(text, '[^\p{L}\p{N}\s.,;:!?''"()%/-]', '', 'g')) / CAST(length(text) AS DOUBLE) END, 6) AS garbage,
CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS density, CASE WHEN length(regexp_replace(text, '\s', '', 'g')) < 500 THEN 'scanned_no_text' ELSE 'ok' END AS status FROM documents""")
def text_quality(t, spark):
    dense = F.length(F.regexp_replace("text", r"\s", "")).cast("long")
    return t("documents").select(_ID, F.round(T.garbage_ratio(F.col("text")), 6).alias("garbage"), dense.alias("density"), F.when(dense < 500, "scanned_no_text").otherwise("ok").alias("status"))


@query("collapse_lines", """WITH k AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, md5(CASE WHEN len(list_filter(l, lambda x: length(x) >= 40)) = 0 THEN array_to_string(l, '') ELSE array_to_string(l, chr(10)) END) AS digest FROM k""")
def collapse_lines(t, spark):
    return t("documents").select(_ID, F.md5(T.collapse(F.col("text"))).alias("digest"))


_SENT = r"""s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS raw FROM documents), k AS (SELECT doc_id, trim(raw) AS sent FROM s)"""


@query("split_long", f"""WITH {_SENT} SELECT doc_id, count(*) AS n, CAST(sum(length(sent)) AS BIGINT) AS n_chars, min(sent) AS least FROM k
WHERE length(sent) BETWEEN 6 AND 240 AND regexp_matches(sent, '^[\\p{{L}}]') AND NOT regexp_matches(sent, '[#*%&$]{{3}}') GROUP BY doc_id""".replace("\\\\", "\\").replace("{{", "{").replace("}}", "}"))
def split_long(t, spark):
    """Sentences that are neither too short nor too long, start with a letter and hold no rubbish."""
    s = t("documents").select(_ID, F.explode(F.split("text", r"[.!?\n]+")).alias("raw")).select(_ID, F.trim("raw").alias("sent"))
    good = F.length("sent").between(6, 240) & F.col("sent").rlike(r"^[\p{L}]") & ~F.col("sent").rlike(r"[#*%&$]{3}")
    return s.where(good).groupBy(_ID).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sent")).alias("n_chars"), F.min("sent").alias("least"))


@query("split_sentences", f"""WITH {_LINES}, o AS (SELECT doc_id, pos, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS start FROM lines)
SELECT doc_id, CAST(pos AS INT) AS sent_idx, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS "end", md5(line) AS digest FROM o WHERE length(trim(line)) BETWEEN 6 AND 240""")
def split_sentences(t, spark):
    """Lines with their offsets; dirty ones are dropped, but their length counts."""
    size = F.length("line") + 1
    start = F.coalesce(F.sum(size).over(Window.partitionBy(_ID).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    o = _lines(t("documents")).withColumn("start", start)
    return o.where(F.length(F.trim("line")).between(6, 240)).select(_ID, F.col("pos").alias("sent_idx"), "start", (F.col("start") + F.length("line")).alias("end"), F.md5("line").alias("digest"))


@query("normalise_codes", """SELECT p_partkey, upper(regexp_extract(p_brand, '^([A-Za-z]+)', 1)) AS letters, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS number,
CASE WHEN p_type LIKE 'ECO%' THEN 'national' WHEN p_type LIKE 'STA%' THEN 'industry' ELSE 'local' END AS level, upper(replace(translate(p_name, '–—‐', '---'), ' ', '')) AS norm FROM part""")
def normalise_codes(t, spark):
    level = F.when(F.col("p_type").startswith("ECO"), "national").when(F.col("p_type").startswith("STA"), "industry").otherwise("local")
    norm = F.upper(F.replace(F.translate("p_name", "–—‐", "---"), F.lit(" "), F.lit("")))
    return t("part").select("p_partkey", T.code_letters(F.col("p_brand")).alias("letters"), T.code_number(F.col("p_brand")).alias("number"), level.alias("level"), norm.alias("norm"))


@query("info_score", r"""SELECT doc_id, CAST(3 * CAST(regexp_matches(lower(text), 'password|secret|license') AS INT) + 2 * CAST(regexp_matches(text, '[0-9]+ ?[a-z%]') AS INT)
+ CAST(length(text) BETWEEN 60 AND 320 AS INT) - CAST(regexp_matches(text, '[A-Za-z]{20,}') AS INT) - 6 * CAST(regexp_matches(text, '^(The|In)([^\p{L}\p{M}\p{N}_]|$)') AS INT) AS INT) AS score FROM documents""")
def info_score(t, spark):
    """How much a text tells: 3 for a telling word, 2 for a quantity, 1 for 60 to 320 characters; less 1 for a long Latin
    word, 6 for a first word The or In. A word ends where no letter, mark, digit or underscore of any script follows."""
    hit = lambda c, p: c.rlike(p).cast("int")
    text = F.col("text")
    score = 3 * hit(F.lower("text"), "password|secret|license") + 2 * hit(text, "[0-9]+ ?[a-z%]") + F.length("text").between(60, 320).cast("int") - hit(text, "[A-Za-z]{20,}") - 6 * hit(text, r"^(The|In)([^\p{L}\p{M}\p{N}_]|$)")
    return t("documents").select(_ID, score.cast("int").alias("score"))


@query("tolerant_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, regexp_extract(props, '(\\{.*\\})', 1) <> '' AS found FROM events""".replace("\\\\", "\\"))
def tolerant_json(t, spark):
    """A JSON object somewhere in a text: the whole, else from the first brace to the last."""
    body = F.coalesce(F.nullif(F.regexp_extract("props", r"(\{.*\})", 1), F.lit("")), F.col("props"))
    k = F.try_variant_get(F.try_parse_json(body), "$.k", "int")
    return t("events").select("event_id", k.alias("k"), (F.regexp_extract("props", r"(\{.*\})", 1) != "").alias("found"))


@query("citation_marks", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+)', 1)) AS m FROM documents) SELECT doc_id, count(DISTINCT m) AS n, string_agg(DISTINCT m, ',' ORDER BY m) AS marks FROM m GROUP BY 1""")
def citation_marks(t, spark):
    """Distinct numbers of a text, in the order of texts."""
    marks = F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))))
    return t("documents").select(_ID, F.size(marks).cast("long").alias("n"), F.array_join(marks, ",").alias("marks")).where("n > 0")


@query("clip_and_highlight", """SELECT doc_id, concat_ws('::', source, CAST(doc_id AS VARCHAR)) AS uid, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS clip,
CASE WHEN strpos(text, 'the') > 0 THEN substr(text, greatest(1, strpos(text, 'the') - 14), least(14, strpos(text, 'the') - 1)) || '【the】' || substr(text, strpos(text, 'the') + 3, 12) END AS snippet FROM documents""")
def clip_and_highlight(t, spark):
    at = F.instr("text", "the")
    snippet = F.when(at > 0, F.concat(F.expr("substring(text, greatest(1, instr(text, 'the') - 14), least(14, instr(text, 'the') - 1))"), F.lit("【the】"), F.expr("substring(text, instr(text, 'the') + 3, 12)")))
    clip = F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("…"))).otherwise(F.col("text"))
    return t("documents").select(_ID, F.concat_ws("::", "source", F.col(_ID).cast("string")).alias("uid"), clip.alias("clip"), snippet.alias("snippet"))


@query("window_around", """WITH s AS (SELECT doc_id, length(text) AS total, length(text) // 3 AS s, length(text) // 3 + 100 AS e FROM documents),
w AS (SELECT *, 1500 AS lim FROM s), g AS (SELECT *, greatest(0, least(s - (lim - (e - s)) // 2, total - lim)) AS lo FROM w)
SELECT doc_id, CAST(CASE WHEN total <= lim THEN 0 ELSE lo END AS BIGINT) AS start, CAST(CASE WHEN total <= lim THEN total ELSE least(total, lo + lim) END AS BIGINT) AS "end" FROM g""")
def window_around(t, spark):
    s = t("documents").select(_ID, F.length("text").alias("total"), F.expr("length(text) div 3").alias("s"), F.expr("length(text) div 3 + 100").alias("e"))
    start, end = chunking.window_around(F.col("s"), F.col("e"), F.col("total"), 1500)
    return s.select(_ID, start.cast("long").alias("start"), end.cast("long").alias("end"))


@query("recursive_chunks")
def recursive_chunks(t, spark):
    return chunking.units(t("documents").select(F.col(_ID).cast("string").alias("clause_id"), "text", "source"))


@query("stride_units", """WITH n AS (SELECT doc_id, length(text) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(CASE WHEN n <= 1200 THEN [0] ELSE range(0, greatest(1, n - 100), 600) END) AS start FROM n)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS k, CAST(start AS BIGINT) AS start, CAST(CASE WHEN n <= 1200 THEN n ELSE least(n, start + 700) END AS BIGINT) AS "end" FROM s""")
def stride_units(t, spark):
    return chunking.stride_units(t("documents").select(_ID, "text")).select(_ID, "k", "start", "end")


@query("heading_scope", f"""WITH {_LINES}, h AS (SELECT doc_id, pos, line, CASE WHEN length(trim(line)) BETWEEN 1 AND 40 THEN trim(line) END AS heading FROM lines),
g AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS scope FROM h)
SELECT doc_id, coalesce(scope, '') AS scope, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM g WHERE heading IS NULL GROUP BY 1, 2""")
def heading_scope(t, spark):
    """Lines belong to the last short line before them."""
    short = F.length(F.trim("line")).between(1, 40)
    h = _lines(t("documents")).withColumn("heading", F.when(short, F.trim("line")))
    scope = F.last("heading", ignorenulls=True).over(Window.partitionBy(_ID).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return h.withColumn("scope", F.coalesce(scope, F.lit(""))).where("heading IS NULL").groupBy(_ID, "scope").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("param_fragments", """WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 6 AS fragment, l_suppkey FROM lineitem)
SELECT l_suppkey, CAST(fragment AS BIGINT) AS fragment, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM r GROUP BY 1, 2""")
def param_fragments(t, spark):
    """Six lines in a row to a fragment."""
    rn = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    r = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").withColumn("fragment", F.floor((rn - 1) / 6))
    return r.groupBy("l_suppkey", "fragment").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query("monotone_runs", """WITH k AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_totalprice > lag(o_totalprice) OVER w THEN 0 ELSE 1 END AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT *, sum(b) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM k)
SELECT o_custkey, CAST(run AS BIGINT) AS run, count(*) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key FROM g GROUP BY 1, 2 HAVING count(*) >= 4""")
def monotone_runs(t, spark):
    """Strictly rising runs of at least four."""
    return chunking.monotone_runs(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 4).select("o_custkey", "run", "n", F.col("first.o_orderkey").alias("first_key"))


@query("number_keys", """SELECT p_partkey, lpad(regexp_extract(p_brand, '([0-9]+)', 1), 4, '0') || '.' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS key,
CAST(rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT), p_size) AS BIGINT) AS pos FROM part""")
def number_keys(t, spark):
    """Section numbers as padded keys, and their place: ranks from counts of the distinct keys, so that no row is sorted alone."""
    key = F.concat_ws(".", F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 4, "0"), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    own = t("part").select("p_partkey", key.alias("key"))
    keys = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pos = F.coalesce(F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return own.join(keys.withColumn("pos", pos), "key").select("p_partkey", "key", "pos")


@query("keep_longest", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang, n_chars % 7 ORDER BY length(text) DESC, doc_id) AS rn FROM documents WHERE length(text) >= 24)
SELECT source, lang, CAST(n_chars % 7 AS BIGINT) AS slot, doc_id FROM r WHERE rn = 1""")
def keep_longest(t, spark):
    """Of rows with one key the longest text, the first on ties: a partial maximum, no sort."""
    d = t("documents").where(F.length("text") >= 24)
    return d.groupBy("source", "lang", (F.col("n_chars") % 7).alias("slot")).agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))


@query("char_profile", r"""SELECT length(w) AS n_letters, count(*) AS n, count(DISTINCT w) AS n_distinct FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1""")
def char_profile(t, spark):
    """Histogram of word lengths."""
    w = t("documents").select(F.explode(T.tokens(F.col("text"))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("k")).groupBy(F.length("w").cast("long").alias("n_letters")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


_CLAUSE_NO = "CASE WHEN p_partkey % 9 = 0 THEN chr(CAST(65 + p_size % 5 AS INT)) || '.' || (p_partkey % 12) ELSE (p_size % 21) || '.' || (p_partkey % 12) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey % 17) END END"


@query("clause_order", f"""WITH c AS (SELECT p_partkey, p_brand, {_CLAUSE_NO} AS no FROM part),
k AS (SELECT *, list_concat(list_transform(string_split(no, '.'), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' THEN ascii(x) ELSE CAST(x AS INT) END), [0, 0, 0, 0])[1:4] AS key FROM c)
SELECT p_partkey, no, CAST(rank() OVER (PARTITION BY p_brand ORDER BY key) AS INT) AS place, coalesce(key > lag(key) OVER (PARTITION BY p_brand ORDER BY p_partkey), TRUE) AS rises FROM k""")
def clause_order(t, spark):
    """Clause numbers of a brand's parts in their order (3.10 behind 3.9.5, A.1 behind numbers), and whether each rises."""
    p = F.col("p_partkey")
    last = lambda c, n: (c % n).cast("string")
    plain = F.concat(last(F.col("p_size"), 21), F.lit("."), last(p, 12), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("."), last(p, 17))))
    no = F.when(p % 9 == 0, F.concat(F.char(65 + F.col("p_size") % 5), F.lit("."), last(p, 12))).otherwise(plain)
    key = number_key_column(F.col("no"))
    own = t("part").select("p_partkey", "p_brand", no.alias("no")).withColumn("key", key)
    before = F.lag("key").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    place = F.rank().over(Window.partitionBy("p_brand").orderBy("key"))
    return own.select("p_partkey", "no", place.alias("place"), F.coalesce(F.col("key") > before, F.lit(True)).alias("rises"))
