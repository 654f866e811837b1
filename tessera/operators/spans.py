"""Labelled spans: tagging by a dictionary, overlap, votes, one-to-one matches. Spans are half-open."""

from __future__ import annotations

import re
from collections import deque

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import in_parts


def overlaps(s1: str, e1: str, s2: str, e2: str) -> Column:
    return (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1))


def tag(docs: DataFrame, lexicon: list[tuple[str, str, int]], patterns: list[tuple[str, str]]) -> DataFrame:
    """doc_id, type, start, end, term: patterns first, then the longest terms; what is taken stays taken.
    All terms are looked for in one pass over a text."""
    kinds = [(name, re.compile(p)) for name, p in patterns]
    rank = {term: (k, kind) for k, (term, kind, _) in reversed([*enumerate(sorted(lexicon, key=lambda x: (-len(x[0]), x[2], x[0])))])}

    def run(batches):
        finder = ahocorasick.Automaton()
        for term, (k, kind) in rank.items():
            finder.add_word(term, (k, kind, len(term)))
        if len(finder):
            finder.make_automaton()
        for batch in in_parts(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text, taken = text or "", bytearray(len(text or ""))
                found = [(name, m.start(), m.end()) for name, p in kinds for m in p.finditer(text)]
                met = [(k, end + 1 - n, end + 1, kind) for end, (k, kind, n) in finder.iter(text)] if len(finder) else []
                found += [(kind, s, e) for _, s, e, kind in sorted(met)]
                for kind, s, e in found:
                    if not any(taken[s:e]):
                        taken[s:e] = b"\1" * (e - s)
                        rows.append((doc, kind, s, e, text[s:e]))
            columns = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*rows)) or [()] * 5, columns, strict=True)], names=["doc_id", "type", "start", "end", "term"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, type string, start int, end int, term string")


class Scan:
    """What one key's rows do, one at a time, in order: take() gives rows for each, end() those for the
    last. Only what a subclass keeps is held, not the key's rows."""

    def __init__(self, key: tuple):
        self.key = key

    def take(self, *row) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def in_order(rows: DataFrame, keys: list[str], columns: list[str], scan: type[Scan], schema: str) -> DataFrame:
    """The rows of all scans. Keys stream through tasks in order, so that many small ones cost no
    frame each, and a large one no memory."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        now, out = None, []
        for frame in frames:
            for row in zip(*(frame[c] for c in (*keys, *columns)), strict=True):
                if now is None or row[: len(keys)] != now.key:
                    out += now.end() if now else []
                    now = scan(row[: len(keys)])
                out += now.take(*row[len(keys) :])
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        out += now.end() if now else []
        yield pd.DataFrame(out, columns=names)

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns).mapInPandas(run, schema)


def sanitize(spans: DataFrame, group: str, limit: int, types: list[str] | None = None) -> DataFrame:
    """Clamps to [0, limit], drops empty spans and other types than the given ones, and keeps a span if
    it starts at or after the last kept one's end; order: start, then the longest."""

    class Apart(Scan):
        last = -1

        def take(self, s, n, i, p):
            if s < self.last:
                return []
            self.last = -n
            return [(*self.key, i, p, s, -n)]

    known = spans if types is None else spans.where(F.col("type").isin(*types))
    clamped = known.select(group, F.greatest("s", F.lit(0)).alias("s"), F.negative(F.least("e", F.lit(limit))).alias("n"), "id", "p").where("s < -n")
    return in_order(clamped, [group], ["s", "n", "id", "p"], Apart, f"{group} long, id int, p long, s int, e int")


def vote(spans: DataFrame, group: str) -> DataFrame:
    """Votes of experts: spans of one type that overlap the first one not yet used (by start, end);
    the longest stands for its group. In this order a group is a run, which ends where one starts at
    or behind its first one's end."""

    class Votes(Scan):
        seed = None

        def take(self, s, e):
            if self.seed is not None and s < self.seed:
                self.n += 1
                self.best = max(self.best, (s, e), key=lambda x: x[1] - x[0])
                return []
            out = self.end()
            self.seed, self.best, self.n = e, (s, e), 1
            return out

        def end(self):
            return [] if self.seed is None else [(*self.key, *self.best, self.n)]

    return in_order(spans, [group, "type"], ["s", "e"], Votes, f"{group} long, type string, s int, e int, n_votes long")


def relaxed_counts(spans: DataFrame, group: str) -> DataFrame:
    """tp, fp, fn of each group: gold spans in order take the first free model span of their type that
    overlaps. Model spans wait no longer than a gold span may meet them."""

    class Matches(Scan):
        def __init__(self, key):
            super().__init__(key)
            self.gold, self.free, self.counts = deque(), [], [0, 0, 0]

        def settle(self, upto):
            while self.gold and (upto is None or self.gold[0][1] <= upto):
                s, e = self.gold.popleft()
                past = [m for m in self.free if m[1] <= s]
                self.counts[1] += len(past)
                self.free = [m for m in self.free if m[1] > s]
                k = next((k for k, m in enumerate(self.free) if m[0] < e), None)
                self.counts[2 if k is None else 0] += 1
                if k is not None:
                    del self.free[k]

        def take(self, s, e, who):
            self.settle(s)
            (self.gold if who == "gold" else self.free).append((s, e))
            return []

        def end(self):
            self.settle(None)
            return [(self.key[0], self.counts[0], self.counts[1] + len(self.free), self.counts[2])]

    each = in_order(spans, [group, "type"], ["s", "e", "who"], Matches, f"{group} long, tp long, fp long, fn long")
    return each.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def allocate(docs: DataFrame, fragments: list[str]) -> DataFrame:
    """doc_id, places (array of int): for each fragment the first place (0-based) that touches none of
    an earlier one's, or -1."""

    def places(text: str) -> list[int]:
        used: list[tuple[int, int]] = []
        for fragment in fragments:
            at = text.find(fragment)
            while at >= 0 and any(at < e and s < at + len(fragment) for s, e in used):
                at = text.find(fragment, at + 1)
            used.append((at, at + len(fragment)) if at >= 0 else (-1, -1))
        return [s for s, _ in used]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "places": [places(x or "") for x in frame["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, places array<int>")
