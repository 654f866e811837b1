"""Reports: a frame of sections for each question, and findings as Markdown lines and as a sheet.

Defined results: a question without a known category has empty lists; null fields are left out of lines; a report
without findings has its head only; empty tables give empty reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: Fixed values of the report's form.
_TITLE_END, _NO_SUBJECT, _FRAME = "危大工程", "该工程", " — 管理框架（结构化问答）"
_SOURCES = {"risks": "风险源知识库（工程管理框架）", "plan": "建办质〔2018〕31号 九章 + 建办质〔2021〕48号 细化要素", "controls": "风险源知识库（管控要点）", "acceptance": "分阶段验收规则模板"}
_PASSAGES, _EXPERTS = " + RAG 条文", "（超规模）专家论证"
_HEAD = ("# 施工方案合规自查报告", "", "> ", "", "## 风险清单", "| 级别 | 检查项 | 风险 | 依据/建议 |", "| --- | --- | --- | --- |")


def _lists(rows: DataFrame, name: str, line: Column) -> DataFrame:
    """Lines of (category, place, ...), in order, one row a category: a knowledge base holds dozens of them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("category").agg(ordered.alias(name))


def frames(slots: DataFrame, risks: DataFrame, extras: DataFrame, checks: DataFrame, passages: DataFrame, chapters: list[str], labels: dict[str, str]) -> DataFrame:
    """item, title, sections (key, label, items, source) and markdown of each slot (item, category, subject, equipment,
    capacity, unit, is_super, wants), with the sections that it wants, in the order of ``labels``. risks: category,
    place, source, hazard, control. extras, checks, passages: category, place, line."""
    s = F.col
    told = F.concat(s("source"), F.lit("："), s("hazard"), F.lit("（管控："), s("control"), F.lit("）"))
    j = slots
    for part in (_lists(risks, "_risks", told), _lists(risks, "_controls", F.concat(s("source"), F.lit(" → "), s("control"))), _lists(extras, "_extras", s("line")), _lists(checks, "_checks", s("line")), _lists(passages, "_passages", s("line"))):
        j = j.join(part, "category", "left")
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(s(c), none)
    first = [*map(F.lit, chapters)]
    experts = F.when(s("is_super") & ~F.lit("专家论证" in chapters), F.array(F.lit(_EXPERTS))).otherwise(none)
    items = {"risks": of("_risks"), "plan": F.concat(F.array(*first) if first else none, experts, of("_extras")), "controls": F.concat(of("_controls"), of("_passages")), "acceptance": F.concat(of("_checks"), of("_passages"))}
    more = F.when(F.size(of("_passages")) > 0, _PASSAGES).otherwise("")
    sections = []
    for key, label in labels.items():
        source = F.concat(F.lit(_SOURCES[key]), more) if key in ("controls", "acceptance") else F.lit(_SOURCES[key])
        sections.append(F.when(F.array_contains("wants", key), F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), items[key].alias("items"), source.alias("source"))))
    subject, equipment = F.coalesce(F.nullif("subject", F.lit("")), F.lit(_NO_SUBJECT)), F.coalesce("equipment", F.lit(""))
    capacity = F.when(F.coalesce("capacity", F.lit(0)) != 0, F.concat(s("capacity").cast("string"), F.coalesce("unit", F.lit("")))).otherwise("")
    lead = F.when((equipment != "") | (capacity != ""), F.concat(capacity, F.lit(" "), equipment, F.lit(" "))).otherwise("")
    own = j.withColumns({"title": F.concat(lead, subject, F.lit(f" {_TITLE_END}{_FRAME}")), "sections": F.array_compact(F.array(*sections))})
    degree = F.when(s("is_super"), "（**超规模，需专家论证**）").otherwise("（危大级别）")
    body = F.flatten(F.transform("sections", lambda x: F.concat(F.array(F.concat(F.lit("### "), x["label"], F.lit("（"), F.size(x["items"]).cast("string"), F.lit(" 项）")), F.concat(F.lit("> 来源："), x["source"])), F.transform(x["items"], lambda i: F.concat(F.lit("- "), i)), F.array(F.lit("")))))
    head = F.array(F.concat(F.lit("## "), s("title")), F.lit(""), F.concat(F.lit("- 危大类别："), F.coalesce("category", F.lit("未识别")), degree), F.lit(""))
    return own.select("item", "title", "sections", F.array_join(F.concat(head, body), "\n").alias("markdown"))


def finding_lines(cases: DataFrame, findings: DataFrame, case: str) -> DataFrame:
    """case, pos, line: each report's Markdown, line by line, from cases (case, summary) and findings (case, severity,
    check, title, suggestion, description, basis). The gravest come first, then by check and title. Lines are rows,
    so a case may have any number of findings."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    advice = F.coalesce(F.nullif("suggestion", F.lit("")), F.substring("description", 1, 60), F.lit(""))
    # a case's head is one row behind its findings, so that both are grouped once; lines are made of the parts then
    parts = findings.select(case, rank.alias("rank"), "severity", "check", "title", F.concat(advice, F.lit(" "), F.coalesce(F.get("basis", F.lit(0)), F.lit(""))).alias("tail"))
    none = [F.lit(None).cast("string").alias(c) for c in ("severity", "check", "title")]
    heads = cases.select(case, F.lit(3).alias("rank"), *none, F.col("summary").cast("string").alias("tail"))
    place = F.row_number().over(Window.partitionBy(case).orderBy("rank", "check", "title", "severity", "tail"))
    placed = parts.unionByName(heads).withColumn("pos", place + len(_HEAD) - 1)
    head = F.array(*(F.struct(F.lit(k).alias("pos"), (F.concat(F.lit(x), F.coalesce("tail", F.lit(""))) if x == "> " else F.lit(x)).alias("line")) for k, x in enumerate(_HEAD)))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "check", "title", "tail"), F.lit(" |"))
    lines = F.when(F.col("rank") == 3, head).otherwise(F.array(F.struct(F.col("pos").alias("pos"), row.alias("line"))))
    return placed.select(case, F.explode(lines).alias("l")).select(case, "l.pos", "l.line")


def export(lines: DataFrame, findings: DataFrame, case: str) -> tuple[str, str]:
    """Writes reports as Markdown files, each report's lines together and in order, and the findings as a sheet (CSV
    with a head, which spreadsheets open; Spark has no writer of their own format), both compressed (gzip), as texts of
    reports repeat themselves. Gives both folders."""
    spark = lines.sparkSession
    md, sheet = scratch(spark, "reports"), scratch(spark, "sheet")
    lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), case).sortWithinPartitions(case, "pos").select(F.col("line").alias("value")).write.text(md, compression="gzip")
    findings.select(case, "severity", "check", "title", "description", "suggestion").write.options(compression="gzip", header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(sheet)
    return md, sheet
