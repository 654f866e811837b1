"""Sections of plain texts: headings and their scopes, and fragments around lines with quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a heading begins with, what makes a line a citation, and the sizes of fragments.
HEADING = r"^\s*(?:第?[一二三四五六七八九十]+[、.．]|[0-9]+(?:[.．][0-9]+)*\s*[、.．]?)\s*\S"
CITATION = r"[《》“”(（]|[A-Z]{2,}\s*[0-9]"
PER_FRAGMENT, CONTEXT, LEAST, MERGED = 6, 12, 200, 600


def is_heading(line: Column) -> Column:
    """A numbered line that doesn't name a book or a standard."""
    return line.rlike(HEADING) & ~line.rlike(CITATION)


def section_scope(lines: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, heads (number of headings) and scope: the different lines, sorted, of the sections whose heading has
    one of the terms, each from its heading to the next one. Null if there is no such section: the whole text
    counts then. lines: doc_id, pos, line."""
    line = F.trim("line")
    head = F.last(F.when(is_heading(line), line), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    named = F.lit(False)
    for term in terms:
        named |= F.contains("head", F.lit(term))
    own = lines.select("doc_id", line.alias("line"), head.alias("head"), is_heading(line).alias("is_head"))
    inside = F.when(F.coalesce(named, F.lit(False)) & (F.col("line") != ""), F.col("line"))
    out = own.groupBy("doc_id").agg(F.count_if("is_head").alias("heads"), F.array_sort(F.collect_set(inside)).alias("scope"))
    return out.withColumn("scope", F.when(F.size("scope") > 0, F.col("scope")))


def fragments(text: Column, pattern: str, *, per: int = PER_FRAGMENT, context: int = CONTEXT, least: int = LEAST, merged: int = MERGED) -> Column:
    """Array of (body, n): lines with ``pattern`` are taken ``per`` at a time, with ``context`` lines on both sides and
    without blank ones; bodies of fewer than ``least`` characters go. A fold then carries the open fragment: while it
    has fewer than ``merged`` characters the next one is joined to it. A null text has none."""
    lines = F.transform(F.split(text, "\n"), F.trim)

    def cut(all_lines: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(all_lines) - 1), lambda i: F.get(all_lines, i).rlike(pattern))
        starts = F.when(F.size(places) > 0, F.sequence(F.lit(0), F.size(places) - 1, F.lit(per))).otherwise(F.array().cast("array<int>"))

        def fragment(s: Column) -> Column:
            group = F.slice(places, s + 1, F.lit(per))
            lo = F.greatest(F.lit(0), F.get(group, F.lit(0)) - context)
            hi = F.element_at(group, -1) + context + 1
            body = F.array_join(F.filter(F.slice(all_lines, lo + 1, hi - lo), lambda x: x != ""), "\n")
            return F.struct(body.alias("body"), F.size(group).alias("n"))

        return F.filter(F.transform(starts, fragment), lambda f: F.length(f["body"]) >= least)

    found = F.get(F.transform(F.array(lines), cut), F.lit(0))
    empty = F.array().cast("array<struct<body:string,n:int>>")
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, f: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.concat(last(acc)["body"], F.lit("\n"), f["body"]).alias("body"), (last(acc)["n"] + f["n"]).alias("n"))))
    step = lambda acc, f: F.when((F.size(acc) > 0) & (F.length(F.get(acc, F.size(acc) - 1)["body"]) < merged), join(acc, f)).otherwise(F.concat(acc, F.array(f)))
    return F.aggregate(found, empty, step)
