"""Smaller operators: profiles, reports, headings, highlights, quotas, combinations, fallbacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators import spans as P
from ..sources import files
from ..sources.tables import scratch
from .labels import cascade_merge
from .registry import query
from .retrieval import _TOK, BM25, _lexical

_CLASSES = (("letters", "[a-zA-ZÀ-ÿ]"), ("digits", "[0-9]"), ("blanks", "[ \\t\\n\\r]"), ("ideographs", "[一-鿿]"))


@query("char_classes", "SELECT lang, count(*) AS n, " + ", ".join(f"CAST(sum(length(text) - length(regexp_replace(text, '{p}', '', 'g'))) AS BIGINT) AS {k}" for k, p in _CLASSES) + ", CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def char_classes(t, spark):
    """What sorts of characters texts are made of, by language."""
    n = lambda p: F.sum(F.length("text") - F.length(F.regexp_replace("text", p, "")))
    return t("documents").where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), *(n(p).alias(k) for k, p in _CLASSES), F.sum(F.length("text")).alias("chars"))


@query("stats_report", "SELECT 'documents' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'chars', sum(n_chars) FROM documents UNION ALL SELECT 'longest', max(n_chars) FROM documents UNION ALL SELECT 'lang ' || lang, count(*) FROM documents GROUP BY lang")
def stats_report(t, spark):
    """A report's figures as rows, from two passes over the columns that it needs."""
    d = t("documents")
    one = d.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    figures = one.select(F.explode(F.create_map(*[x for k in ("documents", "sources", "chars", "longest") for x in (F.lit(k), F.col(k).cast("double"))])).alias("metric", "value"))
    return figures.unionByName(d.groupBy("lang").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("lang "), F.col("lang")).alias("metric"), "value"))


@query("headings", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, length(trim(line)) BETWEEN 1 AND 40 AND NOT regexp_matches(trim(line), '[.!?;,:。；，：]$') AND regexp_matches(trim(line), '^[A-ZÀ-Þ0-9一-鿿]') AS heading FROM s),
g AS (SELECT *, last_value(CASE WHEN heading THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS scope FROM h) SELECT doc_id, coalesce(scope, '') AS scope, count(*) AS n_lines FROM g WHERE NOT heading GROUP BY 1, 2""")
def headings(t, spark):
    """Lines below the last heading: a short line that begins like one and has no mark at its end."""
    line = F.trim("line")
    heading = F.length(line).between(1, 40) & ~line.rlike(r"[.!?;,:。；，：]$") & line.rlike(r"^[A-ZÀ-Þ0-9一-鿿]")
    s = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("heading", heading)
    scope = F.last(F.when(F.col("heading"), line), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("scope", F.coalesce(scope, F.lit(""))).where(~F.col("heading")).groupBy("doc_id", "scope").agg(F.count("*").alias("n_lines"))


@query("highlight_all", "SELECT doc_id, md5(regexp_replace(text, 'the|und|que', '【\\0】', 'g')) AS digest, (length(text) - length(replace(replace(replace(text, 'the', ''), 'und', ''), 'que', ''))) // 3 AS n FROM documents WHERE regexp_matches(text, 'the|und|que')")
def highlight_all(t, spark):
    """Every occurrence of some words marked."""
    without = F.replace(F.replace(F.replace("text", F.lit("the"), F.lit("")), F.lit("und"), F.lit("")), F.lit("que"), F.lit(""))
    return t("documents").where(F.col("text").rlike("the|und|que")).select("doc_id", F.md5(F.regexp_replace("text", "(the|und|que)", "【$1】")).alias("digest"), F.floor((F.length("text") - F.length(without)) / 3).alias("n"))


@query("cjk_gaps", r"""WITH x AS (SELECT p_partkey, '基 坑 ' || p_size || ' m 深 W A T E R 工 程 ' || p_name AS t FROM part) SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([一-鿿]) +([一-鿿])', '\1\2', 'g'), '([一-鿿]) +([一-鿿])', '\1\2', 'g'), '\b([A-Z]) ([A-Z])\b', '\1\2', 'g'), '([A-Z]{2}) ([A-Z]{2}|[A-Z]\b)', '\1\2', 'g') AS text FROM x""")
def cjk_gaps(t, spark):
    """Blanks between ideographs go, letters that stand apart are joined."""
    x = F.concat(F.lit("基 坑 "), F.col("p_size").cast("string"), F.lit(" m 深 W A T E R 工 程 "), F.col("p_name"))
    for pattern in (r"([一-鿿]) +([一-鿿])",) * 2 + (r"\b([A-Z]) ([A-Z])\b", r"([A-Z]{2}) ([A-Z]{2}|[A-Z]\b)"):
        x = F.regexp_replace(x, pattern, "$1$2")
    return t("part").select("p_partkey", x.alias("text"))


@query("code_tokens", r"""WITH x AS (SELECT p_partkey, 'gb' || (50000 + p_size) || ' ' || (p_size % 9) || '.' || (p_partkey % 7) || '.1 ' || p_name AS t FROM part), k AS (SELECT p_partkey, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)+|[a-z]+[0-9]+|[a-z]+|[0-9]+') AS w, regexp_extract_all(t, '[a-z]+([0-9]+)', 1) AS twins FROM x)
SELECT p_partkey, array_to_string(list_concat(w, twins), ' ') AS tokens FROM k""")
def code_tokens(t, spark):
    """Words, dotted numbers whole, codes whole and their numbers once more."""
    x = F.concat(F.lit("gb"), (50000 + F.col("p_size")).cast("string"), F.lit(" "), (F.col("p_size") % 9).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".1 "), F.col("p_name"))
    words = F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)+|[a-z]+[0-9]+|[a-z]+|[0-9]+"), F.lit(0))
    return t("part").select("p_partkey", F.array_join(F.concat(words, F.regexp_extract_all(x, F.lit("[a-z]+([0-9]+)"), F.lit(1))), " ").alias("tokens"))


@query("first_sentences", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), e AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(line, '[A-Z][a-z]+')) AS ent FROM s)
SELECT doc_id, ent, count(*) AS n, array_to_string(list_slice(list_sort(list(pos)), 1, 3), ',') AS first_three, CASE WHEN length(ent) > 8 THEN 'long' ELSE 'short' END AS layer FROM e GROUP BY 1, 2""")
def first_sentences(t, spark):
    """Entities of a text with the first three lines that have them, and their layer."""
    s = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    e = s.select("doc_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("ent"))
    first = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("pos")), 1, 3), lambda x: x.cast("string")), ",")
    return e.groupBy("doc_id", "ent").agg(F.count("*").alias("n"), first.alias("first_three")).withColumn("layer", F.when(F.length("ent") > 8, "long").otherwise("short"))


@query("cascade_spans")
def cascade_spans(t, spark):
    """Model spans that no rule span touches, and of these, in order, those that touch no accepted one."""
    free = cascade_merge(t, spark)
    return P.sanitize(free, "g", 1_000_000)


@query("source_quota", """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|quota'), doc_id) AS rn FROM documents) SELECT doc_id, source FROM r JOIN n USING (source) WHERE rn <= CASE WHEN n <= 20 THEN 20 ELSE least(60, greatest(25, n // 10)) END""")
def source_quota(t, spark):
    """Small sources whole, of others a tenth, within 25 and 60."""
    d = t("documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("source").orderBy(S.hash_order(F.col("doc_id"), "quota"), "doc_id"))
    first = d.withColumn("rn", rn).where("rn <= 60").join(n, "source")
    return first.where(F.col("rn") <= F.when(F.col("n") <= 20, 20).otherwise(F.least(F.lit(60), F.greatest(F.lit(25), F.floor(F.col("n") / 10))))).select("doc_id", "source")


@query("combinations", "WITH a AS (SELECT n_regionkey AS r, n_name AS x FROM nation) SELECT a.r, a.x AS first, b.x AS second, 'compare ' || a.x || ' with ' || b.x AS text FROM a JOIN a b ON a.r = b.r AND a.x < b.x")
def combinations(t, spark):
    """Pairs of a region's nations put into a template: from each region's short list."""
    g = t("nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_set("n_name")).alias("v"))  # a region's nations are few
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return g.select("r", F.explode(pairs).alias("p")).select("r", "p.first", "p.second", F.format_string("compare %s with %s", "p.first", "p.second").alias("text"))


@query("null_last_order", "SELECT event_id, nullif(user_id % 4, 0) AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 40")
def null_last_order(t, spark):
    return t("events").select("event_id", F.nullif(F.col("user_id") % 4, F.lit(0)).alias("k")).orderBy(F.desc_nulls_last("k"), "event_id").limit(40)


@query("semi_and_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS known FROM customer")
def semi_and_anti(t, spark):
    """Both halves of a guard: customers with a large order, and the others."""
    big = t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    c = t("customer").select("c_custkey")
    return c.join(big, "c_custkey", "left_semi").withColumn("known", F.lit(True)).unionByName(c.join(big, "c_custkey", "left_anti").withColumn("known", F.lit(False)))


@query("lookup_drop_empty", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE nullif(trim(CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END), '') IS NOT NULL")
def lookup_drop_empty(t, spark):
    """Looked-up values; rows whose value is blank go."""
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")).where(F.trim("c_mktsegment") != "")
    return t("orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").drop("o_custkey")


@query("contents_pages", "WITH s AS (SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 8)) AS line, generate_subscripts(list_slice(string_split(text, chr(10)), 1, 8), 1) - 1 AS pos FROM documents) SELECT doc_id, pos FROM s WHERE regexp_matches(line, '[.…·]{3,}|[0-9]+ *$')")
def contents_pages(t, spark):
    """Lines like those of a table of contents, among a text's first eight only."""
    s = t("documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 8)).alias("pos", "line"))
    return s.where(F.col("line").rlike("[.…·]{3,}|[0-9]+ *$")).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("rerank_oversampled", f"""WITH {BM25.replace("rank <= 10", "rank <= 20")}, j AS (SELECT item_id, doc_id, lex.rank AS coarse, CASE WHEN item_id % 4 = 0 THEN NULL ELSE round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) END AS score
FROM lex JOIN (SELECT doc_id, list_distinct({_TOK}) AS a FROM documents) USING (doc_id) JOIN (SELECT item_id, list_distinct({_TOK}) AS b FROM benchmark) USING (item_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC NULLS LAST, coarse) AS INT) AS rank FROM j) SELECT item_id, rank, doc_id FROM r WHERE rank <= 5""")
def rerank_oversampled(t, spark):
    """Four times as many hits as wanted are scored again; where scoring fails the coarse order holds."""
    from ..functions import text as T

    words = lambda c: F.array_distinct(T.tokens(F.col(c)))
    pairs = _lexical(t, 20).withColumnRenamed("rank", "coarse").drop("score").join(t("documents").select("doc_id", words("text").alias("a")), "doc_id").join(t("benchmark").select("item_id", words("text").alias("b")), "item_id")
    score = F.when(F.col("item_id") % 4 != 0, F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc_nulls_last("score"), "coarse"))
    return pairs.withColumn("score", score).select("item_id", rank.alias("rank"), "doc_id").where("rank <= 5")


@query("text_folder", "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY 1")
def text_folder(t, spark):
    """Lines written to a folder of text files and read from it. Carriage returns, which end a line of a file, are
    escaped there."""
    path = scratch(spark, "folder")
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines.select(F.concat_ws("\t", F.col("doc_id").cast("string"), files.escaped_line(F.col("line"))).alias("value")).write.text(path)
    back = files.read_lines(spark, path).select(F.split("line", "\t", 2).alias("x")).select(F.get("x", F.lit(0)).cast("long").alias("doc_id"), F.length(files.plain_line(F.get("x", F.lit(1)))).alias("n"))
    return back.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n").alias("chars"))


@query("whole_document", "SELECT n_nationkey, n_name FROM nation")
def whole_document(t, spark):
    """A table as one JSON document of many lines, read as one value a file."""
    path = scratch(spark, "document")
    whole = t("nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))  # a dimension of a few rows
    whole.select(F.replace("value", F.lit("},"), F.lit("},\n")).alias("value")).write.text(path)
    return files.read_document(spark, path, "n_nationkey int, n_name string")


@query("paged_export", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def paged_export(t, spark):
    """An export with a folder for each source, read back with the folder's name as a column."""
    path = scratch(spark, "pages")
    files.paged(t("documents").select("doc_id", "n_chars", "source"), path, "source")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("unit_vectors", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS last FROM embeddings")
def unit_vectors(t, spark):
    """Vectors scaled to length 1: their first and last places."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(v, lambda x: x / size)
    return t("embeddings").select("vec_id", F.round(F.element_at(unit, 1), 5).alias("first"), F.round(F.element_at(unit, -1), 5).alias("last"))


@query("three_ratios", """WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'hard' WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS kind FROM labels), n AS (SELECT count(*) FILTER (WHERE kind = 'pos') AS p FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(doc_id AS VARCHAR) || '|ratio'), doc_id) AS rn FROM l)
SELECT kind, count(*) AS n FROM r, n WHERE rn <= CASE kind WHEN 'pos' THEN p WHEN 'neg' THEN p // 2 ELSE p // 10 END GROUP BY 1""")
def three_ratios(t, spark):
    """Half as many negatives as positives and a tenth as many hard ones, by hash. Places are counted
    by ranges of hashes, so that no kind has to fit into a task."""
    kind = F.when(F.col("toxic") == 1, "hard").when(F.col("quality") == 1, "pos").otherwise("neg")
    l = t("labels").select("doc_id", kind.alias("kind"), F.struct(S.hash_order(F.col("doc_id"), "ratio").alias("h"), "doc_id").alias("o"))
    p = l.where("kind = 'pos'").agg(F.count("*").alias("p"))
    most = F.when(F.col("kind") == "pos", F.col("p")).when(F.col("kind") == "neg", F.floor(F.col("p") / 2)).otherwise(F.floor(F.col("p") / 10))
    return S.numbered(l, "o", "kind").crossJoin(F.broadcast(p)).where(F.col("i") < most).groupBy("kind").agg(F.count("*").alias("n"))
