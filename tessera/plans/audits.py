"""Queries that audit data: orders by several keys, neighbours of terms, health of cases, bands, mined terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query


@query("three_key_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'view') NULLS LAST, CASE WHEN value > 10 THEN value END DESC NULLS LAST, event_id) AS INT) AS place FROM events")
def three_key_order(t, spark):
    """Each user's events by kind, then value from the greatest down, then number; missing keys last in both."""
    kind, value = F.nullif("event_type", F.lit("view")), F.when(F.col("value") > 10, F.col("value"))
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last(kind), F.desc_nulls_last(value), "event_id")
    return t("events").select("event_id", F.row_number().over(w).alias("place"))


_TERM = r"(?s)(^|.)([A-Z][a-z]{3,})(.|$)"


@query("neighbour_characters", rf"""WITH m AS (SELECT unnest(regexp_extract_all(text, '{_TERM}', 1)) AS l, unnest(regexp_extract_all(text, '{_TERM}', 2)) AS w, unnest(regexp_extract_all(text, '{_TERM}', 3)) AS r FROM documents),
c AS (SELECT length(w) AS size, 'left' AS side, l AS c FROM m UNION ALL SELECT length(w), 'right', r FROM m), n AS (SELECT size, side, c, count(*) AS n FROM c GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY size, side ORDER BY n DESC, encode(c)) AS place FROM n) SELECT size, side, c, n, CAST(place AS INT) AS place FROM r WHERE place <= 15""")
def neighbour_characters(t, spark):
    """For terms of each length the fifteen characters that stand most often before and behind them."""
    group = lambda k: F.regexp_extract_all("text", F.lit(_TERM), F.lit(k))
    m = t("documents").select(F.explode(F.arrays_zip(group(1).alias("l"), group(2).alias("w"), group(3).alias("r"))).alias("m"))
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("m.l").alias("c")), F.struct(F.lit("right").alias("side"), F.col("m.r").alias("c")))
    n = m.select(F.length("m.w").cast("long").alias("size"), F.explode(sides).alias("s")).groupBy("size", "s.side", "s.c").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("size", "side").orderBy(F.desc("n"), F.col("c").cast("binary")))
    return n.withColumn("place", place).where("place <= 15")


@query("health_rates", r"""WITH f AS (SELECT source, regexp_matches(text, '[0-9]') AS a, regexp_matches(text, '[0-9]+ ?[a-zA-Z%]') AS b, contains(text, chr(10)) AS c, l.toxic = 1 AS d FROM documents LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS cases, round(avg(CAST(a AS INT)), 4) AS has_number, round(avg(CAST(b AS INT)), 4) AS has_quantity, round(avg(CAST(c AS INT)), 4) AS has_lines, round(avg(CAST(coalesce(d, FALSE) AS INT)), 4) AS has_risk, round(avg(CAST(a AND b AND c AS INT)), 4) AS whole FROM f GROUP BY 1""")
def health_rates(t, spark):
    """The share of each source's cases in which each step found something, and in which all did."""
    labels = t("labels").select("doc_id", (F.col("toxic") == 1).alias("risk"))
    d = t("documents").join(labels, "doc_id", "left").select("source", F.col("text").rlike("[0-9]").alias("a"), F.col("text").rlike("[0-9]+ ?[a-zA-Z%]").alias("b"), F.contains("text", F.lit("\n")).alias("c"), F.coalesce("risk", F.lit(False)).alias("d"))
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 4).alias(name)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return d.groupBy("source").agg(F.count("*").alias("cases"), rate(a, "has_number"), rate(b, "has_quantity"), rate(c, "has_lines"), rate(F.col("d"), "has_risk"), rate(a & b & c, "whole"))


#: Of each kind of line: from where on it is hazardous and super, the plausible range, and the sentinel for "unknown".
_BANDS = (("R", 10.0, 30.0, 1.0, 48.0), ("A", 20.0, None, 2.0, 50.0), ("N", None, 40.0, 1.0, 49.0))
_SENTINEL = 7.0
_BANDS_SQL = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if h is None else h}, {'NULL' if s is None else s}, {lo}, {hi})" for k, h, s, lo, hi in _BANDS) + ") v(k, h, s, lo, hi))"


@query("band_audit", f"""WITH {_BANDS_SQL}, l AS (SELECT l_returnflag AS k, l_quantity AS v, CASE WHEN l_discount > 0.07 THEN 'super' WHEN l_discount > 0.03 THEN 'hazardous' ELSE 'none' END AS label FROM lineitem),
j AS (SELECT l.k, v, label, CASE WHEN v = {_SENTINEL} THEN 'sentinel' WHEN v NOT BETWEEN lo AND hi THEN 'implausible' WHEN CASE WHEN s IS NOT NULL AND v >= s THEN 'super' WHEN h IS NOT NULL AND v >= h THEN 'hazardous' ELSE 'none' END <> label THEN 'label differs' ELSE 'fine' END AS finding,
 CASE WHEN s IS NOT NULL AND v >= s THEN 'super' WHEN h IS NOT NULL AND v >= h THEN 'hazardous' ELSE 'none' END AS band FROM l JOIN b USING (k)) SELECT k, band, label, finding, count(*) AS n FROM j GROUP BY ALL""")
def band_audit(t, spark):
    """Values against their bands and labels: sentinels, values out of range, labels that say another band."""
    label = F.when(F.col("l_discount") > 0.07, "super").when(F.col("l_discount") > 0.03, "hazardous").otherwise("none")
    v, k = F.col("v"), F.col("k")
    band, plausible = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for kind, h, s, lo, hi in _BANDS:
        own = F.when(v >= s if s is not None else F.lit(False), "super").when(v >= h if h is not None else F.lit(False), "hazardous").otherwise("none")
        band, plausible = F.when(k == kind, own).otherwise(band), F.when(k == kind, v.between(lo, hi)).otherwise(plausible)
    l = t("lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"), label.alias("label")).withColumns({"band": band, "plausible": plausible}).where("band IS NOT NULL")
    finding = F.when(v == _SENTINEL, "sentinel").when(~F.col("plausible"), "implausible").when(F.col("band") != F.col("label"), "label differs").otherwise("fine")
    return l.groupBy("k", "band", "label", finding.alias("finding")).agg(F.count("*").alias("n"))


_SUFFIXES, _BLACK, _SEEDS = ("tion", "ung", "ment", "ción"), ("tion", "ment", "ung"), ("edition", "heizung", "moment")
_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("mined_terms", f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), c AS (SELECT * FROM w WHERE ({" OR ".join(f"ends_with(term, '{s}')" for s in _SUFFIXES)}) AND term NOT IN ({", ".join(f"'{b}'" for b in _BLACK)})),
n AS (SELECT term, count(*) AS n, array_to_string(list_transform(list_sort(list_distinct(list(doc_id)))[1:3], lambda x: CAST(x AS VARCHAR)), ',') AS examples FROM c GROUP BY 1), s AS (SELECT unnest({list(_SEEDS)}) AS term)
SELECT coalesce(n.term, s.term) AS term, coalesce(n, 0) AS n, coalesce(examples, '') AS examples, s.term IS NOT NULL AS seed FROM n FULL JOIN s ON n.term = s.term WHERE s.term IS NOT NULL OR n >= 2""")
def mined_terms(t, spark):
    """Words with a telling end, not on the black list, that come at least twice, with three documents each; and all seeds."""
    w = t("documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    ends = F.lit(False)
    for s in _SUFFIXES:
        ends |= F.endswith("term", F.lit(s))
    c = w.where(ends & ~F.col("term").isin(*_BLACK))
    # the three smallest documents of a term, from counts of the different ones
    per = c.groupBy("term", "doc_id").agg(F.count("*").alias("c"))
    rn = F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))
    first = per.withColumn("rn", rn).where("rn <= 3").groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    n = per.groupBy("term").agg(F.sum("c").alias("n")).join(first, "term")
    seeds = spark.createDataFrame([(s, True) for s in _SEEDS], "term string, seed boolean")
    j = n.join(seeds, "term", "full").where("seed OR n >= 2")
    return j.select("term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"), F.coalesce("seed", F.lit(False)).alias("seed"))
