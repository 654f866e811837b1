"""More of retrieval, spans, metrics and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import spans as P
from ..sources import files
from .registry import query

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("jsonl_scan", "SELECT doc_id, quality, toxic FROM labels")
def jsonl_scan(t, spark):
    """Labels out as JSON lines, and in again by an explicit schema."""
    path = files.scratch(spark, "jsonl")
    files.write_jsonl(t("labels"), path)
    return files.read_jsonl(spark, path, "doc_id long, quality int, toxic int")


@query("tolerant_jsonl_scan", "SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0")
def tolerant_jsonl_scan(t, spark):
    """Half of the lines are broken; the others survive."""
    path = files.scratch(spark, "jsonl")
    good = F.to_json(F.struct("doc_id", "quality"))
    t("labels").select(F.when(F.col("doc_id") % 2 == 0, good).otherwise(F.substring(good, 1, 9)).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "doc_id long, quality int", tolerant=True)


@query("append_sink", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING min(doc_id) % 2 = 1 AND count(*) FILTER (WHERE doc_id % 2 = 0) = 0")
def append_sink(t, spark):
    """Odd documents are appended to the even ones, without texts that are there."""
    path = files.scratch(spark, "append-to")
    d = t("documents").select(F.md5("text").alias("h"), "doc_id")
    files.write_jsonl(d.where("doc_id % 2 = 0"), path)
    odd = d.where("doc_id % 2 = 1").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return files.append_new(odd, path, "h", "h string, doc_id long")


@query("first_match", r"SELECT doc_id, nullif(regexp_extract(text, '([0-9]+(\.[0-9]+)?) ?(kg|km|m|t|%)', 1), '') AS value, nullif(regexp_extract(text, '([0-9]+(\.[0-9]+)?) ?(kg|km|m|t|%)', 3), '') AS unit FROM documents")
def first_match(t, spark):
    p = r"([0-9]+(\.[0-9]+)?) ?(kg|km|m|t|%)"
    part = lambda k: F.nullif(F.regexp_extract("text", p, k), F.lit(""))
    return t("documents").select("doc_id", part(1).alias("value"), part(3).alias("unit"))


@query("char_bioe", "WITH s AS (SELECT l_orderkey AS g, l_returnflag AS type, CAST(l_suppkey % 40 AS INT) AS s, CAST(l_suppkey % 40 + least(l_quantity, 12) AS INT) AS e FROM lineitem), c AS (SELECT g, type, s, e, unnest(range(s, e)) AS pos FROM s) SELECT g, CAST(pos AS INT) AS pos, arg_max(CASE WHEN pos = s THEN 'B-' WHEN pos = e - 1 THEN 'E-' ELSE 'I-' END || type, (e - s, -s, type)) AS tag FROM c GROUP BY 1, 2")
def char_bioe(t, spark):
    """A tag for each covered place; the longest span's tag wins."""
    s = (F.col("l_suppkey") % 40).cast("int")
    spans = t("lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("type"), s.alias("s"), (s + F.least("l_quantity", F.lit(12.0))).cast("int").alias("e"))
    # lines are dealt out by their order once, so that the places made of them aren't
    spans = spans.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g")
    c = spans.withColumn("pos", F.explode(F.sequence("s", F.col("e") - 1)))
    tag = F.concat(F.when(F.col("pos") == F.col("s"), "B-").when(F.col("pos") == F.col("e") - 1, "E-").otherwise("I-"), "type")
    return c.groupBy("g", "pos").agg(F.max_by(tag, F.struct(F.col("e") - F.col("s"), F.negative("s"), "type")).alias("tag"))


@query("bioe_decode")
def bioe_decode(t, spark):
    """Spans from a sequence of tags; a span ends at its end tag, or before anything that doesn't go on with it."""

    w = Window.partitionBy("g").orderBy("pos")
    parts = F.split("tag", "-", 2)
    tags = char_bioe(t, spark).select("g", "pos", F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("type"))
    before = F.lag(F.struct("pos", "head", "type")).over(w)
    # all tags of a span have its type, so that the tag before tells whether one goes on with it
    goes_on = (before["head"] != "E") & (F.col("head") != "B") & (before["type"] == F.col("type")) & (before["pos"] + 1 == F.col("pos"))
    runs = tags.withColumn("first", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("g", "run", "type").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e")).select("g", "type", "s", "e")


@query("episodic_recall", f"WITH q AS (SELECT item_id, list_distinct({_TOK}) AS w FROM benchmark), x AS (SELECT item_id, unnest(w) AS term FROM q), c AS (SELECT conv_id, turn, unnest(list_distinct({_TOK})) AS term FROM conversations), s AS (SELECT item_id, conv_id, turn, count(*) AS n FROM x JOIN c USING (term) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, conv_id, turn) AS rn FROM s) SELECT item_id, conv_id, turn, n FROM r WHERE rn <= 3")
def episodic_recall(t, spark):
    """Turns that share the most words with a question."""
    words = lambda name, *keys: t(name).select(*keys, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    n = words("benchmark", "item_id").join(words("conversations", "conv_id", "turn"), "term").groupBy("item_id", "conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "conv_id", "turn"))
    return n.withColumn("rn", rn).where("rn <= 3").drop("rn")


@query("value_binding", r"SELECT doc_id, strpos(text, ' of ') AS at, nullif(regexp_extract(substr(text, strpos(text, ' of ') + 4, 40), '([0-9]+)', 1), '') AS value FROM documents WHERE strpos(text, ' of ') > 0")
def value_binding(t, spark):
    """The nearest number in the forty characters after a metric's name."""
    at = F.instr("text", " of ")
    value = F.nullif(F.regexp_extract(F.expr("substring(text, instr(text, ' of ') + 4, 40)"), "([0-9]+)", 1), F.lit(""))
    return t("documents").select("doc_id", at.cast("long").alias("at"), value.alias("value")).where("at > 0")


@query("confidence_gates", "WITH s AS (SELECT user_id, min(value) AS lo, list_sort(list(value))[CAST(count(*) // 2 AS INT) + 1] AS med, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round(med, 4) AS med, CASE WHEN lo < 0.5 THEN 'margin' WHEN med < 10 THEN 'median' ELSE 'kept' END AS gate FROM s")
def confidence_gates(t, spark):
    """All values above a margin, and their upper median above another; the median by counts of values."""
    from ..operators.sampling import percentile_places

    med = percentile_places(t("events"), "user_id", "value", {"med": lambda n: F.floor(n / 2)})
    s = t("events").groupBy("user_id").agg(F.min("value").alias("lo")).join(med, "user_id")
    return s.select("user_id", F.round("med", 4).alias("med"), F.when(F.col("lo") < 0.5, "margin").when(F.col("med") < 10, "median").otherwise("kept").alias("gate"))


@query("compare_models", "WITH p AS (SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1) SELECT * FROM p WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL AND greatest(f, o, p) - least(f, o, p) >= 1e-9")
def compare_models(t, spark):
    """Keys that all models have and on which they differ."""
    p = t("orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice")).toDF("o_custkey", "f", "o", "p").dropna()
    return p.where(F.greatest("f", "o", "p") - F.least("f", "o", "p") >= 1e-9)


@query("family_split", "SELECT p_partkey, CASE WHEN CAST('0x' || substr(md5(regexp_extract(p_name, '^([a-z]+)', 1)), 1, 8) AS BIGINT) % 100 < 70 THEN 'train' ELSE 'val' END AS split FROM part")
def family_split(t, spark):
    """All members of a name's family fall on one side."""
    from ..operators.sampling import hash_split

    return t("part").select("p_partkey", hash_split(F.regexp_extract("p_name", "^([a-z]+)", 1), {"train": 70, "val": 30}).alias("split"))


@query("risk_rates", "WITH g AS (SELECT o_orderkey, upper(replace(o_orderpriority, ' ', '')) AS frag FROM orders), r AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS found FROM lineitem GROUP BY 1) SELECT frag, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(found, FALSE)) AS missed, round(count(*) FILTER (WHERE NOT coalesce(found, FALSE)) / CAST(count(*) AS DOUBLE), 6) AS fnr FROM g LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1")
def risk_rates(t, spark):
    """Share of expected findings without a finding, by kind."""
    r = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("found"))
    j = t("orders").select("o_orderkey", F.upper(F.regexp_replace("o_orderpriority", " ", "")).alias("frag")).join(r, "o_orderkey", "left")
    missed = ~F.coalesce("found", F.lit(False))
    return j.groupBy("frag").agg(F.count(F.lit(1)).alias("n"), F.count_if(missed).alias("missed"), F.round(F.count_if(missed) / F.count(F.lit(1)), 6).alias("fnr"))


@query("pair_margins", "SELECT l_orderkey, round(1 / (1 + exp(-(max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') - max(l_extendedprice) FILTER (WHERE l_returnflag <> 'R')) / 10000)), 6) AS margin FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND count(*) FILTER (WHERE l_returnflag <> 'R') > 0")
def pair_margins(t, spark):
    """Sigmoid of the best positive's lead over the best negative."""
    best = lambda c: F.max(F.when(c, F.col("l_extendedprice")))
    pos = F.col("l_returnflag") == "R"
    m = t("lineitem").groupBy("l_orderkey").agg(best(pos).alias("p"), best(~pos).alias("n")).dropna()
    return m.select("l_orderkey", F.round(1 / (1 + F.exp(-(F.col("p") - F.col("n")) / 10000)), 6).alias("margin"))


@query("conflict_route", "WITH x AS (SELECT doc_id, quality, toxic, lang, md5(text) AS h FROM labels JOIN documents USING (doc_id)), g AS (SELECT h FROM x GROUP BY 1 HAVING count(DISTINCT quality) > 1) SELECT doc_id, CASE WHEN h IN (SELECT h FROM g) THEN 'drop' WHEN toxic = 1 THEN 'fix' WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) % 100 < 10 THEN 'val' ELSE 'train' END AS route FROM x")
def conflict_route(t, spark):
    """Equal texts with different labels are dropped; the rest is routed by one expression."""
    x = t("labels").join(t("documents").select("doc_id", F.md5("text").alias("h")), "doc_id")
    bad = x.groupBy("h").agg(F.countDistinct("quality").alias("k")).where("k > 1").select("h", F.lit(1).alias("bad"))
    slot = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % 100
    return x.join(bad, "h", "left").select("doc_id", F.when(F.col("bad").isNotNull(), "drop").when(F.col("toxic") == 1, "fix").when(slot < 10, "val").otherwise("train").alias("route"))


@query("audit_bands", "SELECT l_returnflag, CASE WHEN l_discount > 0.08 AND l_tax < 0.02 THEN 'implausible' WHEN l_quantity = 0.1 THEN 'sentinel' ELSE 'ok' END AS audit, count(*) AS n FROM lineitem GROUP BY 1, 2")
def audit_bands(t, spark):
    audit = F.when((F.col("l_discount") > 0.08) & (F.col("l_tax") < 0.02), "implausible").when(F.col("l_quantity") == 0.1, "sentinel").otherwise("ok")
    return t("lineitem").groupBy("l_returnflag", audit.alias("audit")).agg(F.count(F.lit(1)).alias("n"))


@query("section_report", "SELECT r_name, string_agg(n_name, ';' ORDER BY n_name) AS nations, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def section_report(t, spark):
    j = t("nation").join(t("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("nations"), F.count(F.lit(1)).alias("n"))


@query("hash_vectors")
def hash_vectors(t, spark):
    """256 hashed counts of letters and letter pairs, scaled to length 1, for each turn."""
    import numpy as np
    import pyarrow as pa

    from ..functions.batches import in_parts

    def places(low: str) -> np.ndarray:
        """Weights of the hashed letters and letter pairs: h * 33 + code point from 5381, over all places at once."""
        c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        one = (5381 * 33 + c) & np.uint64(0xFFFFFFFF)
        two = (one[:-1] * np.uint64(33) + c[1:]) & np.uint64(0xFFFFFFFF)
        v = 0.5 * np.bincount((one % np.uint64(256)).astype(np.int64), minlength=256) + np.bincount((two % np.uint64(256)).astype(np.int64), minlength=256)
        size = np.linalg.norm(v)
        return v / size if size else v

    def run(batches):
        for batch in in_parts(batches, rows=1_000):
            flat = np.concatenate([places((x or "").lower()) for x in batch.column("text").to_pylist()] or [np.zeros(0)])
            vector = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 256), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), vector], names=["conv_id", "turn", "vector"])

    own = t("conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
    return own.mapInArrow(run, "conv_id long, turn long, vector array<double>")
