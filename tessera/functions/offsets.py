"""Cleaning that keeps where each character came from, and marks set into a text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import in_parts

# Characters that stand for others or go, and what marks a copy's origin.
REPLACED = str.maketrans({" ": " ", "　": " ", "（": "(", "）": ")", "，": ",", "\t": " ", **{chr(0xFF10 + d): str(d) for d in range(10)}})
DROPPED = "[â\x00�]"
WATERMARK = r"(?i:www\.[a-z0-9\-]+\.(?:com|cn|net)|免费下载|标准下载|建工之家|工标网|道客巴巴|豆丁网|文档来源为.*?下载)"

#: In this order: what to take away. A rule with a group takes the group away, else the whole match; blanks are
#: single spaces by then, as REPLACED has been applied.
RULES = tuple(
    re.compile(p)
    for p in (
        DROPPED,
        WATERMARK,
        r"(?<= ) +",  # all blanks but one
        r"(?<=[一-鿿]) +(?=[一-鿿])",
        r"(?<=\d)(\s+)(?=\.\s*\d)",  # 5. 1 . 1
        r"(?<=\d\.)(\s+)(?=\d)",
        r"(?<=[A-Za-z0-9])(\s)(?=[A-Za-z0-9]\b)",  # see _spaced
        r"\A[\s\-–—·•*#]+",
        r"[\s\-–—·•*#]+\Z",
        r"(?<=\n\n)\n+",
        r"\A\s+|\s+\Z",
    )
)
_SPACED = RULES[6]
_LETTERS = re.compile(r"(?<![.\d])(?:[A-Za-z0-9]\s){2,}[A-Za-z0-9]")


def _cuts(rule: re.Pattern, text: str) -> list[tuple[int, int]]:
    if rule is _SPACED:  # J G J 2 1 5: the blanks of three and more single letters in a row
        return [(m.start() + k, m.start() + k + 1) for m in _LETTERS.finditer(text) for k, c in enumerate(m[0]) if c == " "]
    return [m.span(1 if rule.groups else 0) for m in rule.finditer(text)]


def clean_with_offsets(text: str | None) -> tuple[str, np.ndarray]:
    """The cleaned text, and for each of its characters the place it had. Every rule only takes characters away, so
    that what is left keeps its place."""
    now = (text or "").translate(REPLACED)
    places = np.arange(len(now), dtype=np.int32)
    for rule in RULES:
        cuts = [c for c in _cuts(rule, now) if c[1] > c[0]]
        if cuts:
            keep = np.ones(len(now), dtype=bool)
            for s, e in cuts:
                keep[s:e] = False
            places = places[keep]
            now = "".join([now[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(now)], strict=True)])
    return now, places


_CLEANED = "doc_id long, clean string, offsets array<int>, spans array<struct<s:int,e:int>>"


def cleaned(docs: DataFrame, term: str | None = None) -> DataFrame:
    """doc_id, clean, offsets and the spans of ``term`` (a pattern) in the text as it was: they are found in the
    clean one and carried back. A null text counts as empty."""

    def run(batches):
        found = re.compile(term) if term else None
        for batch in in_parts(batches):
            clean, offsets, spans = [], [], []
            for text in batch.column("text").to_pylist():
                now, places = clean_with_offsets(text)
                clean.append(now)
                offsets.append(places)
                spans.append([{"s": int(places[m.start()]), "e": int(places[m.end() - 1]) + 1} for m in found.finditer(now) if m.end() > m.start()] if found else [])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(clean, pa.string()), pa.array(offsets, pa.list_(pa.int32())), pa.array(spans, kind)], names=["doc_id", "clean", "offsets", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CLEANED)


def marked(text: Column, spans: Column, left: str, right: str) -> Column:
    """A text with marks around its spans (s, e), set in from the last to the first so that places stay true. Of
    overlapping spans the first counts, of equal starts the longest."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<s:int,e:int>>").alias("kept"))
    step = lambda acc, x: F.when(x["s"] >= acc["end"], F.struct(x["e"].alias("end"), F.concat(acc["kept"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))).alias("kept"))).otherwise(acc)
    apart = F.aggregate(ordered, start, step, lambda acc: F.reverse(acc["kept"]))
    # the text before the next span to the left, and what is done
    whole = F.struct(text.alias("head"), F.lit("").alias("tail"))
    put = lambda acc, x: F.struct(F.substring(acc["head"], F.lit(1), x["s"]).alias("head"), F.concat(F.lit(left), F.substring(acc["head"], x["s"] + 1, x["e"] - x["s"]), F.lit(right), F.substring(acc["head"], x["e"] + 1, F.length(acc["head"])), acc["tail"]).alias("tail"))
    return F.aggregate(apart, whole, put, lambda acc: F.concat(acc["head"], acc["tail"]))
