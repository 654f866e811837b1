"""Queries over answers, steps and codes of agents: rewards, status of dependent steps, valid ends, risk rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators import lineage
from ..operators.rewards import rewarded
from .measures import _CHECKS, _CLAUSES, _MUST, _REF, _WITHDRAWN, _plans
from .registry import query


def answers(turns: DataFrame) -> DataFrame:
    """An answer and what it is judged by for each turn, of twelve kinds: whole, without steps, in a text, broken,
    free, empty, and so on. The words are the turn's own."""
    k = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(12))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("leer"))
    mode = F.element_at(F.array(*map(F.lit, ("exact", "set_match", "numeric", "contains"))), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) + 1).cast("int"))
    value = (F.col("turn") % 23 + 1).cast("string")
    expect = F.when(mode == "set_match", F.concat(word(0), F.lit("，第"), value, F.lit("条、"), word(2))).when(mode == "numeric", F.concat(value, F.lit("Ω"))).otherwise(word(0))
    numeral = F.element_at(F.array(*(F.lit(n) for n in ("一", "二", "十", "十二", "二十", "二十三", "〇九"))), (F.col("turn") % 7 + 1).cast("int"))
    good = F.when(mode == "numeric", F.concat(F.lit("约４"), F.lit("．"), value, F.lit("Ω"))).otherwise(F.concat(word(0), F.lit(" 第"), numeral, F.lit("条"), word(1)))
    basis = F.concat(F.lit("建办质〔2018〕31号 第"), numeral, F.lit("条"))
    steps = F.array(F.concat(F.lit("核对："), word(0)), F.concat(F.lit("因此 "), word(1)), F.lit(" "))
    whole = F.to_json(F.struct(steps.alias("cot_steps"), good.alias("conclusion"), F.array(basis).alias("basis"), word(3).alias("explanation")))
    stepless = F.to_json(F.struct(good.alias("conclusion"), F.array(basis, F.lit("GB 99999-2099")).alias("basis"), word(3).alias("explanation")))
    lacking = F.to_json(F.struct(steps.alias("cot_steps"), good.alias("conclusion")))
    single = F.to_json(F.struct(F.slice(steps, 2, 1).alias("cot_steps"), word(5).alias("conclusion"), F.array(F.lit("GB 11111-1111")).alias("basis"), word(3).alias("explanation")))
    chained = F.to_json(F.struct(F.array(F.lit("核对规范库：该标准已废止"), F.lit("结论：引用不合规")).alias("cot_steps"), good.alias("conclusion"), F.array(basis, F.lit("JGJ/T 46-2024")).alias("basis"), F.lit("").alias("explanation")))
    kinds = [whole, stepless, lacking, single, chained, F.concat(F.lit("So: "), whole, F.lit(" end.")), F.concat(F.lit("{"), word(0), F.lit("} 。")), F.concat(F.lit("依据 JGJ/T 46-2024 与 建办质〔2018〕31号，答案是4.4Ω，"), word(0)), F.lit(""), F.lit(None).cast("string"), F.lit("[1, 2]"), F.concat(F.lit(" \n"), word(0))]
    response = F.element_at(F.array(*kinds), (k + 1).cast("int"))
    third = F.col("conv_id") % 3
    return turns.select(
        "conv_id",
        "turn",
        response.alias("response"),
        mode.alias("mode"),
        expect.alias("expect"),
        F.when(third == 0, F.array(F.lit("－"), word(1))).otherwise(F.array().cast("array<string>")).alias("alias"),
        F.when(third == 1, F.array(good, F.lit("no"))).alias("options"),
        F.when(F.col("turn") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(basis, "〇", "零"), F.lit("JGJ/T 46-2024"))).alias("golden_basis"),
        F.when(third != 2, F.array(F.lit("核对规范库：该标准已废止"), F.lit("结论：引用不合规"))).alias("golden_steps"),
        F.when(F.col("turn") % 2 == 0, 2.5).alias("tolerance"),
        (F.col("turn") % 3 != 0).alias("require_steps"),
    )


@query("answer_rewards")
def answer_rewards(t, spark):
    """The four parts of each answer's reward, and the weighted total."""
    return rewarded(answers(t("conversations"))).select("conv_id", "turn", "format", "steps", "basis", "answer", "total")


_STEPS = """s AS (SELECT l_orderkey AS graph, l_linenumber AS step, min(CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_quantity > 45 THEN 'timeout' ELSE 'success' END) AS outcome FROM lineitem GROUP BY 1, 2),
e AS (SELECT a.graph, a.step, b.step AS other, b.step = a.step // 2 AS hard FROM s a JOIN s b ON a.graph = b.graph AND (b.step = a.step // 2 OR b.step = a.step - 1)
      UNION ALL SELECT graph, min(step), max(step), TRUE FROM s WHERE graph % 97 = 0 GROUP BY 1)"""


@query("step_status", f"""WITH RECURSIVE {_STEPS},
reach AS (SELECT graph, step AS a, other AS b FROM e UNION SELECT r.graph, r.a, e.other FROM reach r JOIN e ON e.graph = r.graph AND e.step = r.b),
cyc AS (SELECT DISTINCT graph FROM reach WHERE a = b),
ok AS (SELECT * FROM s ANTI JOIN cyc USING (graph)),
cut AS (SELECT graph, step FROM ok WHERE outcome <> 'success' UNION SELECT e.graph, e.step FROM cut JOIN e ON e.graph = cut.graph AND e.other = cut.step AND e.hard),
skipped AS (SELECT DISTINCT e.graph, e.step FROM cut JOIN e ON e.graph = cut.graph AND e.other = cut.step AND e.hard),
depth AS (SELECT graph, step, 0 AS d FROM ok UNION SELECT e.graph, e.step, d + 1 FROM depth JOIN e ON e.graph = depth.graph AND e.other = depth.step)
SELECT s.graph, s.step, CASE WHEN cyc.graph IS NOT NULL THEN 'refused' WHEN skipped.step IS NOT NULL THEN 'skipped' ELSE s.outcome END AS status, CAST((SELECT max(d) FROM depth WHERE depth.graph = s.graph AND depth.step = s.step) AS INT) AS wave
FROM s LEFT JOIN cyc USING (graph) LEFT JOIN skipped USING (graph, step)""")
def step_status(t, spark):
    """Lines of an order as steps: each needs the step of half its number and waits for the one before; every
    97th order waits for itself."""
    flag = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_quantity") > 45, "timeout").otherwise("success")
    steps = t("lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("step"), flag.alias("outcome"))
    own = steps.select("graph", "step").distinct()
    half, before = F.floor(F.col("step") / 2), F.col("step") - 1
    wanted = own.select("graph", "step", F.explode(F.array_distinct(F.array(half.cast("long"), before.cast("long")))).alias("other")).withColumn("hard", F.col("other") == half)
    there = own.select("graph", F.col("step").alias("other"))
    loops = own.where("graph % 97 = 0").groupBy("graph").agg(F.min("step").alias("step"), F.max("step").alias("other")).withColumn("hard", F.lit(True))
    needs = wanted.join(there, ["graph", "other"], "left_semi").select("graph", "step", "other", "hard").unionByName(loops.select("graph", "step", F.col("other").cast("long"), "hard"))
    return lineage.step_status(steps, needs)


_LINKS = """l AS (SELECT o_orderkey AS code, lead(o_orderkey) OVER w AS nx, lead(o_orderdate) OVER w AS since, first(o_orderkey) OVER w AS head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT code, coalesce(nx, CASE WHEN o_custkey % 50 = 0 AND head <> code THEN head END) AS nx, coalesce(since, o_orderdate) AS since FROM l JOIN orders ON o_orderkey = code)"""


def _links(t):
    """Orders of a customer as codes, each replaced by the next one; every 50th customer's go round."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    nx, since, head = F.lead("o_orderkey").over(w), F.lead("o_orderdate").over(w), F.first("o_orderkey").over(w)
    own = t("orders").select(F.col("o_orderkey").alias("code"), nx.alias("nx"), F.coalesce(since, F.col("o_orderdate")).alias("since"), head.alias("head"), "o_custkey")
    return own.select("code", F.coalesce("nx", F.when((F.col("o_custkey") % 50 == 0) & (F.col("head") != F.col("code")), F.col("head"))).alias("next"), "since")


_WALK = """walk AS (SELECT code, nx AS cur, since, 1 AS hops, CAST(nx AS VARCHAR) AS path FROM k WHERE nx IS NOT NULL
    UNION ALL SELECT w.code, k.nx, k.since, w.hops + 1, w.path || ' ' || k.nx FROM walk w JOIN k ON k.code = w.cur AND k.nx IS NOT NULL WHERE w.hops < 200),
far AS (SELECT code, arg_max(struct_pack(cur := cur, since := since, hops := hops, path := path), hops) AS f FROM walk GROUP BY 1),
named AS (SELECT code FROM k WHERE nx IS NOT NULL UNION SELECT nx FROM k WHERE nx IS NOT NULL),
ends AS (SELECT named.code, CASE WHEN f IS NULL THEN named.code WHEN f.hops < 200 THEN f.cur END AS valid_end, CASE WHEN f IS NULL THEN 0 WHEN f.hops < 200 THEN f.hops END AS hops, CASE WHEN f.hops < 200 THEN f.since END AS since, CASE WHEN f IS NULL THEN '' WHEN f.hops < 200 THEN f.path END AS path, CASE WHEN f IS NULL THEN 'valid' WHEN f.hops < 200 THEN 'superseded' ELSE 'cycle' END AS status FROM named LEFT JOIN far ON far.code = named.code)"""


@query("valid_ends", f"WITH RECURSIVE {_LINKS}, {_WALK} SELECT code, valid_end, CAST(hops AS INT) AS hops, since, path, status FROM ends")
def valid_ends(t, spark):
    """The code that holds in place of each, since when, and the way there; cycles are found."""
    return lineage.chain_ends(_links(t)).withColumn("path", F.array_join("path", " "))


@query("alias_validity", f"""WITH RECURSIVE {_LINKS}, {_WALK}, a AS (SELECT o_custkey AS alias, min(o_orderkey) AS code FROM orders WHERE o_totalprice > 1000 GROUP BY 1)
SELECT alias, a.code, coalesce(status, 'valid') AS status, CASE WHEN status IS NULL THEN a.code ELSE valid_end END AS valid_end, since FROM a LEFT JOIN ends ON ends.code = a.code""")
def alias_validity(t, spark):
    """What an alias stands for, and what holds in its place now. Of several meanings the smallest counts."""
    aliases = t("orders").where("o_totalprice > 1000").groupBy(F.col("o_custkey").alias("alias")).agg(F.min("o_orderkey").alias("code"))
    j = aliases.join(lineage.chain_ends(_links(t)), "code", "left")
    return j.select("alias", "code", F.coalesce("status", F.lit("valid")).alias("status"), F.when(F.col("status").isNull(), F.col("code")).otherwise(F.col("valid_end")).alias("valid_end"), "since")


@udtf
class RiskRows:
    """TABLE(id, text) PARTITION BY id: a row for each finding in the texts of a key, the gravest first. Its columns
    are the key's, named as there, then chk, severity, what and place. A null text has no findings of words that
    are there, and lacks what every text must have."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or len(table.dataType.fields) != 2 or table.dataType.fields[1].dataType != StringType():
            raise ValueError("RiskRows takes a table of a key and a text")
        key = table.dataType.fields[0]
        out = StructType().add(key.name, key.dataType)
        for name, kind in (("chk", StringType()), ("severity", StringType()), ("what", StringType()), ("place", IntegerType())):
            out = out.add(name, kind)
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(table.dataType.fields[1].name)])

    def __init__(self):
        self.key, self.found = None, []

    def eval(self, row):
        self.key = row[0]
        text = row[1] or ""
        for raw in dict.fromkeys(m[0] for m in re.finditer(_REF, text)):
            norm, at = raw.upper().replace(" ", ""), text.upper().index(raw.upper())
            near = text[max(0, at - 40) : at + len(raw) + 60]
            cited = set(re.findall(r"第 *([0-9]+(?:\.[0-9]+)*) *条", near))
            if norm in _WITHDRAWN or norm in _CLAUSES:
                self.found.append(("C1", "HIGH" if norm in _WITHDRAWN or cited & set(_CLAUSES[norm]) else "LOW", raw))
        if "建质〔2009〕87号" in text:
            self.found.append(("C1", "HIGH", "建质〔2009〕87号"))
        musts = [m for words, needed in _MUST.values() if any(w in text for w in words) for m in needed]
        self.found += [("C2", "MEDIUM", m) for m in musts if m not in text]
        self.found += [("C4", "MEDIUM", w) for w in ("应急", "依据") if w not in text]

    def terminate(self):
        grave = {"HIGH": 0, "MEDIUM": 1}
        for place, (chk, severity, what) in enumerate(sorted(self.found, key=lambda f: (grave.get(f[1], 2), f[0], f[2])), 1):
            yield self.key, chk, severity, what, place


@query("risk_rows", f"WITH {_CHECKS} SELECT p_partkey, chk, severity, what, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, chk, what) AS INT) AS place FROM a")
def risk_rows(t, spark):
    """The findings of run_checks by a table function over each text's partition."""
    spark.udtf.register("tessera_risk_rows", RiskRows)
    return spark.sql("SELECT * FROM tessera_risk_rows(TABLE({plans}))", plans=_plans(t))
