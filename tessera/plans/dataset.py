"""Joins, sampling, splits, set operations, aggregates and windows over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sampling as S
from .registry import query

_HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


@query("hash_split", f"SELECT doc_id, CASE WHEN {_HASH.format('text')} % 100 < 80 THEN 'train' WHEN {_HASH.format('text')} % 100 < 90 THEN 'val' ELSE 'test' END AS split FROM documents")
def hash_split(t, spark):
    return t("documents").select("doc_id", S.hash_split(F.col("text"), {"train": 80, "val": 10, "test": 10}).alias("split"))


@query("leak_guard_anti", "SELECT doc_id FROM documents d WHERE md5(trim(text)) NOT IN (SELECT md5(trim(text)) FROM documents WHERE doc_id % 10 = 0) AND doc_id % 10 <> 0")
def leak_guard_anti(t, spark):
    """Training rows whose text no test row has."""
    d = t("documents").select("doc_id", F.md5(F.trim("text")).alias("h"))
    return d.where("doc_id % 10 <> 0").join(d.where("doc_id % 10 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("append_antidup", "SELECT conv_id, turn, md5(text) AS h FROM conversations c WHERE role = 'assistant' AND md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE role <> 'assistant')")
def append_antidup(t, spark):
    """Rows that may be appended: their text isn't there yet."""
    c = t("conversations").withColumn("h", F.md5("text"))
    return c.where("role = 'assistant'").join(c.where("role <> 'assistant'").select("h"), "h", "left_anti").select("conv_id", "turn", "h")


@query("dedup_first", "SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_first(t, spark):
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("stratified_quota", f"""WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id) AS rn FROM labels)
SELECT doc_id, quality, toxic FROM r WHERE rn <= CASE WHEN toxic = 1 THEN 30 WHEN quality = 1 THEN 40 ELSE 20 END""")
def stratified_quota(t, spark):
    quota = F.when(F.col("toxic") == 1, 30).when(F.col("quality") == 1, 40).otherwise(20)
    return S.quota(t("labels"), ["quality", "toxic"], "doc_id", quota, seed="7", most=40).select("doc_id", "quality", "toxic")


@query("round_robin", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents), z AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS sr FROM documents GROUP BY 1)
SELECT doc_id, source, CAST(rn AS INT) AS rn, CAST(sr AS INT) AS sr FROM r JOIN z USING (source) ORDER BY rn, sr LIMIT 110""")
def round_robin(t, spark):
    """The first of each source, then the second of each; larger sources first."""
    rows = S.round_robin(t("documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 110)
    return rows.orderBy("rn", "sr").limit(110).select("doc_id", "source", "rn", "sr")


@query("batch_number", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT source, CAST((rn - 1) // 110 AS BIGINT) AS batch, count(*) AS n, min(doc_id) AS lo FROM r GROUP BY 1, 2")
def batch_number(t, spark):
    rows = S.numbered(t("documents").select("source", "doc_id"), "doc_id", "source")
    return rows.groupBy("source", F.floor(F.col("i") / 110).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"))


@query("zip_join", "SELECT l.doc_id, quality, d.lang FROM labels l JOIN documents d USING (doc_id)")
def zip_join(t, spark):
    return t("labels").select("doc_id", "quality").join(t("documents").select("doc_id", "lang"), "doc_id")


@query("orphan_drop", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN length(text) < 60 THEN 'short' ELSE 'kept' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def orphan_drop(t, spark):
    l = t("labels").select("doc_id", F.lit(1).alias("has"))
    return t("documents").join(l, "doc_id", "left").select("doc_id", F.when(F.col("has").isNull(), "unlabelled").when(F.length("text") < 60, "short").otherwise("kept").alias("state"))


@query("gold_leak_drop", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def gold_leak_drop(t, spark):
    bad_part, bad_supp = t("part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey")), t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(bad_part, "l_partkey", "left_anti").join(bad_supp, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("lookup_fallback", "SELECT o_orderkey, coalesce(c_name, '') AS name, coalesce(n_name, '-') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_fallback(t, spark):
    c = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return t("orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").join(t("nation").select("n_nationkey", "n_name"), "n_nationkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("name"), F.coalesce("n_name", F.lit("-")).alias("nation"))


@query("validity_hint", "SELECT p_partkey, coalesce(CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'whole' END, CASE WHEN (p_brand, p_size) IN (('Brand#3', 7), ('Brand#4', 9), ('Brand#3', 11)) THEN 'clause' END) AS validity FROM part")
def validity_hint(t, spark):
    """A rule for the whole code first, else one for code and number. The rule tables are fixed and tiny."""
    whole = spark.createDataFrame([("Brand#1", "whole"), ("Brand#2", "whole")], "p_brand string, w string")
    clause = spark.createDataFrame([("Brand#3", 7, "clause"), ("Brand#4", 9, "clause"), ("Brand#3", 11, "clause")], "p_brand string, p_size int, c string")
    return t("part").join(F.broadcast(whole), "p_brand", "left").join(F.broadcast(clause), ["p_brand", "p_size"], "left").select("p_partkey", F.coalesce("w", "c").alias("validity"))


@query("neighbour_pairs", "WITH l AS (SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) AS next_id FROM documents) SELECT source, doc_id, next_id FROM l WHERE next_id IS NOT NULL")
def neighbour_pairs(t, spark):
    rows = S.numbered(t("documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("name")), "name", "source")
    return rows.select("source", "doc_id", "i").join(rows.select("source", F.col("doc_id").alias("next_id"), (F.col("i") - 1).alias("i")), ["source", "i"]).drop("i")


@query("negatives_per_source", "WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT d.doc_id, s.source AS neg, row_number() OVER (PARTITION BY d.doc_id ORDER BY md5(CAST(d.doc_id AS VARCHAR) || '|' || s.source), s.source) AS rn FROM documents d JOIN s ON s.source <> d.source) SELECT doc_id, neg FROM r WHERE rn <= 2")
def negatives_per_source(t, spark):
    """Two other sources for each document, by hash: sources sorted within each row's own array."""
    d = t("documents").select("doc_id", "source")
    every = d.agg(F.array_sort(F.collect_set("source")).alias("all"))  # one row: the names of sources, a small dimension
    keyed = F.array_sort(F.transform(F.array_remove(F.col("all"), F.col("source")), lambda s: F.struct(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), s)).alias("h"), s.alias("s"))))
    return d.crossJoin(F.broadcast(every)).select("doc_id", F.explode(F.slice(keyed, 1, 2)).alias("k")).select("doc_id", F.col("k.s").alias("neg"))


@query("percentile_flavours", """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(v) FILTER (WHERE i = least(n - 1, floor(n * 90 / 100))) AS floor90, max(v) FILTER (WHERE i = round_even(0.9 * (n - 1), 0)) AS round90, max(v) FILTER (WHERE i = n // 2) AS upper_median FROM r GROUP BY 1""")
def percentile_flavours(t, spark):
    """Three definitions of a percentile, from counts of the distinct values."""
    return S.percentile_places(t("lineitem"), "l_returnflag", "l_extendedprice", {
        "floor90": lambda n: F.least(n - 1, F.floor(n * 90 / 100)), "round90": lambda n: F.bround(F.lit(0.9) * (n - 1)).cast("long"), "upper_median": lambda n: F.floor(n / 2),
    })


@query("group_zscore", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER w) / greatest(stddev_pop(l_quantity) OVER w, 0.0001), 4) AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def group_zscore(t, spark):
    w = Window.partitionBy("l_orderkey")
    z = (F.col("l_quantity") - F.avg("l_quantity").over(w)) / F.greatest(F.stddev_pop("l_quantity").over(w), F.lit(1e-4))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(z, 4).alias("z"))


@query("traj_top2", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, CAST(rn AS INT) AS rn, CASE WHEN o_totalprice >= 400000 THEN 'keep' WHEN o_totalprice >= 200000 THEN 'rebuild' ELSE 'drop' END AS route FROM r WHERE rn <= 2""")
def traj_top2(t, spark):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    route = F.when(F.col("o_totalprice") >= 400000, "keep").when(F.col("o_totalprice") >= 200000, "rebuild").otherwise("drop")
    return t("orders").select("o_custkey", "o_orderkey", rn.alias("rn"), route.alias("route")).where("rn <= 2")


@query("keep_worst", "WITH r AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY abs(l_extendedprice * l_discount) DESC, l_orderkey, l_linenumber, l_partkey) AS rn, l_returnflag FROM lineitem) SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM r WHERE rn = 1")
def keep_worst(t, spark):
    rank = F.struct(F.abs(F.col("l_extendedprice") * F.col("l_discount")), -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_partkey"))
    return t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max_by(F.struct("l_orderkey", "l_linenumber"), rank).alias("w")).select("l_suppkey", "l_returnflag", "w.*")


@query("most_common", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 15")
def most_common(t, spark):
    return t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "lang").limit(15)


@query("conditional_rates", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, round(avg(CAST(value > 50 AS INT)), 6) AS rate, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def conditional_rates(t, spark):
    high = F.col("value") > 50
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("high"), F.round(F.avg(high.cast("int")), 6).alias("rate"), F.countDistinct("user_id").alias("users"))


@query("having_links", "SELECT o_custkey, l_suppkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 3")
def having_links(t, spark):
    j = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), "l_orderkey")
    return j.groupBy("o_custkey", "l_suppkey").agg(F.countDistinct("l_partkey").alias("n")).where("n >= 3")


@query("distribution_diff", "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT lang, count(*) AS n FROM documents WHERE source < 'src5' GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n FROM documents WHERE source >= 'src5' GROUP BY 1) b ON a.lang = b.lang")
def distribution_diff(t, spark):
    n = lambda c, name: t("documents").where(c).groupBy("lang").agg(F.count(F.lit(1)).alias(name))
    j = n("source < 'src5'", "a").join(n("source >= 'src5'", "b"), "lang", "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return j.select("lang", a.alias("n_a"), b.alias("n_b"), (b - a).alias("delta"))


@query("ratio_assembly", "WITH p AS (SELECT count(*) AS n FROM labels WHERE quality = 1), r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|3'), doc_id) AS rn FROM labels) SELECT doc_id, quality FROM r, p WHERE quality = 1 OR rn <= floor(n * 0.4)")
def ratio_assembly(t, spark):
    """All positives, and 0.4 negatives for each. Places are counted by ranges of hashes, so that no label's rows
    have to fit into a task."""
    l = t("labels").select("doc_id", "quality")
    n = l.where("quality = 1").agg(F.count(F.lit(1)).alias("n"))
    rest = l.where("quality <> 1 OR quality IS NULL").withColumn("o", F.struct(S.hash_order(F.col("doc_id"), "3").alias("h"), "doc_id"))
    drawn = S.numbered(rest, "o", "quality").crossJoin(F.broadcast(n)).where(F.col("i") < F.floor(F.col("n") * 0.4))  # n: one row
    return l.where("quality = 1").unionByName(drawn.select("doc_id", "quality"))


@query("cartesian_values", "SELECT p_type, a.p_size AS lo, b.p_size AS hi, count(*) AS n FROM (SELECT DISTINCT p_type, p_size FROM part) a JOIN (SELECT DISTINCT p_type, p_size FROM part) b USING (p_type) WHERE a.p_size < b.p_size AND b.p_size - a.p_size < 3 GROUP BY 1, 2, 3")
def cartesian_values(t, spark):
    """Pairs of close values within a type: shifts of one and two make an equality join."""
    a = t("part").select("p_type", F.col("p_size").alias("lo")).distinct()
    shifted = a.select("p_type", "lo", F.explode(F.array(F.col("lo") + 1, F.col("lo") + 2)).alias("hi"))
    return shifted.join(a.withColumnRenamed("lo", "hi"), ["p_type", "hi"]).select("p_type", "lo", "hi", F.lit(1).cast("long").alias("n"))


@query("span_key_sets", "SELECT doc_id, 'only_a' AS part FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'both' FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)")
def span_key_sets(t, spark):
    a, b = t("labels").where("quality = 1").select("doc_id"), t("labels").where("toxic = 1").select("doc_id")
    return a.subtract(b).withColumn("part", F.lit("only_a")).unionByName(a.intersect(b).withColumn("part", F.lit("both")))


@query("cube_counts", "SELECT lang, source, grouping_id(lang, source) AS gid, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def cube_counts(t, spark):
    return t("documents").cube("lang", "source").agg(F.grouping_id("lang", "source").cast("long").alias("gid"), F.count(F.lit(1)).alias("n"))


@query("first_wins_union", "WITH u AS (SELECT c_nationkey AS k, c_name AS name, 0 AS p, c_custkey AS i FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_name, 1, s_suppkey FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, i) AS rn FROM u) SELECT k, name FROM r WHERE rn = 1")
def first_wins_union(t, spark):
    u = t("customer").where("c_acctbal < 0").selectExpr("c_nationkey k", "c_name name", "0 p", "c_custkey i").unionByName(t("supplier").selectExpr("s_nationkey k", "s_name name", "1 p", "s_suppkey i"))
    return u.groupBy("k").agg(F.min_by("name", F.struct("p", "i")).alias("name"))


@query("bootstrap_f1")
def bootstrap_f1(t, spark):
    """The F1 of toxic labels predicted by a rule on the text, with its interval from 500 draws of
    documents with replacement."""
    pred = t("documents").select("doc_id", (F.col("n_chars") % 3 == 0).alias("pred"))
    j = t("labels").select("doc_id", (F.col("toxic") == 1).alias("gold")).join(pred, "doc_id")
    one = lambda c: c.cast("int")
    return S.bootstrap_f1(j.select("doc_id", one(F.col("gold") & F.col("pred")).alias("tp"), one(~F.col("gold") & F.col("pred")).alias("fp"), one(F.col("gold") & ~F.col("pred")).alias("fn")), "doc_id")
