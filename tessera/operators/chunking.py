"""Chunks of texts: recursive separators, fixed strides, windows around a span, rising runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import in_parts

#: From the strongest to the weakest separator; a separator stays with the text before it.
SEPARATORS = ("\n\n", "\n", "。", "；", "！", "？", ";", "，", "、", " ")
SIZE, OVERLAP, WHOLE = 700, 100, 1200


def _pieces(text: str, start: int, end: int, size: int, level: int) -> list[int]:
    """Ends of pieces of at most size characters, cut at the strongest separator that will do."""
    if end - start <= size:
        return [end]
    if level == len(SEPARATORS):
        return [*range(start + size, end, size), end]
    ends, at, sep = [], start, SEPARATORS[level]
    while at < end:
        cut = text.find(sep, at, end)
        to = end if cut < 0 else min(end, cut + len(sep))
        ends += [to] if to - at <= size else _pieces(text, at, to, size, level + 1)
        at = to
    return ends


def recursive_spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open spans: pieces are joined while they fit; the next span starts overlap characters
    before the last one's end, if that is past the last one's start. Behind a full piece a span is longer than
    ``size`` by the overlap, so that every border is overlapped: 2,500 letters without a separator are
    (0, 700), (600, 1400), (1300, 2100), (2000, 2500)."""
    spans, start, last = [], 0, 0
    for end in _pieces(text, 0, len(text), size, 0) if text else []:
        if end - start > size and last > start:
            spans.append((start, last))
            start = last - overlap if last - overlap > start else last
        last = end
    if last > start:
        spans.append((start, last))
    return spans


_UNIT = "uid string, clause_id string, source string, text string, start int, end int, parent_len int"


def units(clauses: DataFrame, size: int = SIZE, overlap: int = OVERLAP, whole: int = WHOLE) -> DataFrame:
    """Child chunks of clause_id, text, source: one if the text has at most ``whole`` characters.
    Blank chunks are left out but keep their number."""

    kinds = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (x.split() for x in _UNIT.split(", "))])

    def split(batches):
        for batch in in_parts(batches):
            rows = []
            for clause, text, source in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                text = text or ""
                spans = [(0, len(text))] if len(text) <= whole else recursive_spans(text, size, overlap)
                rows += [(f"{clause}#{k}", clause, source, text[s:e], s, e, len(text)) for k, (s, e) in enumerate(spans) if text[s:e].strip()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*rows)) or [()] * len(kinds), kinds.types, strict=True)], schema=kinds)

    return clauses.select("clause_id", "text", "source").mapInArrow(split, _UNIT)


def unit_texts(docs: DataFrame, key: str, size: int = SIZE, overlap: int = OVERLAP, whole: int = WHOLE) -> DataFrame:
    """key and units, the texts of the same chunks in a text's own row, so that nothing is grouped again. Null and
    blank texts have none."""

    def split(batches):
        for batch in in_parts(batches):
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = [(0, len(text))] if len(text) <= whole else recursive_spans(text, size, overlap)
                out.append([part for s, e in spans if (part := text[s:e]).strip()])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.string()))], names=[key, "units"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(split, f"{key} {kind}, units array<string>")


def strides(text: Column, size: int = SIZE, overlap: int = OVERLAP, whole: int = WHOLE) -> tuple[Column, Column]:
    """Where the fixed windows of a text start (array of int), and how long they are at most."""
    n, step = F.length(text), size - overlap
    starts = F.when(n <= whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(1), n - overlap) - 1, F.lit(step)))
    return starts, F.when(n <= whole, n).otherwise(F.lit(size))


def stride_units(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, whole: int = WHOLE) -> DataFrame:
    """Fixed windows by built-in functions alone: doc_id, k, start, end, text."""
    starts, width = strides(F.col("text"), size, overlap, whole)
    s = docs.select("*", F.posexplode(starts).alias("k", "start"), width.alias("width"))
    end = F.least(F.length("text"), F.col("start") + F.col("width"))
    return s.withColumn("end", end.cast("long")).withColumn("start", F.col("start").cast("long")).withColumn("text", F.expr("substring(text, cast(start + 1 as int), width)")).drop("width")


def window_around(start: Column, end: Column, total: Column, limit: int) -> tuple[Column, Column]:
    """A window of ``limit`` characters centred on a span and kept inside the text."""
    half = F.floor((F.lit(limit) - (end - start)) / 2)
    lo = F.greatest(F.lit(0), F.least(start - half, total - limit))
    return F.when(total <= limit, 0).otherwise(lo), F.when(total <= limit, total).otherwise(F.least(total, lo + limit))


def monotone_runs(rows: DataFrame, key: str, order: list[str], value: str, least: int) -> DataFrame:
    """Strictly rising runs of a value within a key: key, run, n, first (a struct of the order columns)."""
    w = Window.partitionBy(key).orderBy(*order)
    breaks = F.when(F.col(value) > F.lag(value).over(w), 0).otherwise(1)
    runs = rows.withColumn("_b", breaks).withColumn("run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")).where(F.col("n") >= least)
