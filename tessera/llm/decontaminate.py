"""Benchmark decontamination by spaced-seed hashing.

A mask lays a few fixed places over a run of words and ignores the others, so that words changed at
ignored places don't change the hash. Every mask is laid at every word of the benchmark items and
of the documents. Document hashes that no item can have are thinned out by a bitmap of fixed size;
the rest are joined with the items' hashes by a shuffled join. A hit gives a document, an item and
a diagonal (by how many words they are shifted). Around the hits, document and item are compared
word by word: stretches of at least ``stretch`` equal words with at most ``gap`` different ones in
a row, and two thirds equal in all, count as overlap; so do parts of a sparser stretch that are
dense enough themselves. A document is contaminated by an item if at
least ``coverage`` of the item's words lie in overlaps as equal words.

A word is a run of letters, digits and non-ASCII characters, A-Z in lower case.

Defined results: null or wordless texts and items overlap with nothing; an item of fewer than six
words (the shortest mask) is not searched, as so few words are no evidence; equal rows are reported
once; a null doc_id or item_id is reported as null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import list_array
from .shared import Bitmap, build_bitmap, cut, in_sizes, table
from .words import MARKS, Words, mix

#: 1: a place that counts, 0: one that is ignored.
#: Every stretch of more than 60 words with two thirds equal and at most ``GAP`` different ones in a
#: row holds one of them somewhere (by enumeration; a test repeats it).
MASKS = ("111111", "11011011", "101101101", "1110000111", "1110111", "101011011", "1011111", "1101111", "10011111", "10101111", "11010111", "11001111")
COVERAGE = 0.5
GAP = 3
STRETCH = 6
_PART = 1 << 20  # bytes of texts handled together, for memory
_K = np.uint64(0x9E3779B97F4A7C15)


def seeds(words: Words, near: Bitmap | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, place of the first word in all words) of all masks at all words; with ``near``, those
    that it may have. One mask's hashes are held at a time, and what is returned."""
    h, text = words.hash, words.text_of()
    out, at = [], []
    for number, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, number + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, place in enumerate(mask):
                if place == "1":
                    total += h[k : k + n]
                    total *= _K
        inside = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
        total = mix(total[inside])
        if near is not None:
            hit = near.has(total)
            total, inside = total[hit], inside[hit]
        out.append(total)
        at.append(inside)
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _keys(words: Words) -> list[bytes]:
    return [hashlib.md5(words.hash[a:b].tobytes()).digest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _item_seeds(batches):
    for batch in in_sizes(batches, "text", _PART // 8):  # all seeds are returned
        words = Words(batch.column("text"), MARKS)
        keys = _keys(words)
        h, at = seeds(words)
        of = words.text_of()[at] if len(at) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array([keys[k] for k in of], pa.binary()), pa.array((at - words.first[of]).astype(np.int64))],
            names=["seed", "item_key", "item_at"],
        )


def _item_words(batches):
    for batch in in_sizes(batches, "text", _PART):
        words = Words(batch.column("text"), MARKS)
        own = [words.hash[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(_keys(words), pa.binary()), pa.array(own, pa.binary())], names=["item_id", "item_key", "item_words"])


def _hits(near):
    """Documents with at least one hash that an item may have: their words and those hashes."""

    def run(batches):
        for part in in_sizes(batches, "text", _PART):
            words = Words(part.column("text"), MARKS)
            h, at = seeds(words, near.value)
            if not len(h):
                continue
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            of = words.text_of()[at]
            docs, starts = np.unique(of, return_index=True)
            own = [words.hash[words.first[k] : words.first[k + 1]].tobytes() for k in docs]
            first = np.r_[starts, len(of)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(docs)),
                    pa.array([hashlib.md5(w).digest() for w in own], pa.binary()),
                    pa.array(own, pa.binary()),
                    list_array(h, first),
                    list_array((at - words.first[of]).astype(np.int64), first),
                ],
                names=["doc_id", "text_key", "words", "seeds", "places"],
            )

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, *, gap: int = GAP, stretch: int = STRETCH) -> np.ndarray:
    """Places of the item whose words lie, equal, in an overlap with the document shifted by shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < stretch:
        return np.zeros(0, np.int64)
    equal = lo + np.flatnonzero(item[lo:hi] == doc[lo + shift : hi + shift])
    if len(equal) < stretch:
        return equal[:0]
    runs = np.split(equal, np.flatnonzero(np.diff(equal) > gap + 1) + 1)
    kept = [_dense(r, stretch) for r in runs if len(r) >= stretch]
    return np.concatenate(kept) if kept else equal[:0]


def _dense(run: np.ndarray, stretch: int) -> np.ndarray:
    """The places of a run that lie in a part of it, from place i to place j, of at least
    ``stretch`` places and two thirds equal: 3 * (j - i + 1) >= 2 * (run[j] - run[i] + 1)."""
    n = len(run)
    value = 3 * np.arange(n) - 2 * run
    most = np.maximum.accumulate(value[::-1])[::-1]  # of all later places; falls
    last = n - 1 - np.searchsorted(most[::-1], value - 1)  # the farthest j for each i
    first = np.flatnonzero(last - np.arange(n) + 1 >= stretch)
    depth = np.bincount(first, minlength=n + 1) - np.bincount(last[first] + 1, minlength=n + 1)
    return run[np.cumsum(depth)[:n] > 0]


_CHECK = "text_key binary, item_key binary, matched long, item_length long, first_word long, end_word long"


def _check(coverage: float):
    """Rows in order of texts: a text's words first, then each item that it met, with the diagonals.
    No more than one text and one item are held at a time."""
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        key, doc = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for text, item_key, words, shifts in zip(batch.column("text_key").to_pylist(), batch.column("item_key").to_pylist(), batch.column("words"), batch.column("shifts").to_pylist(), strict=True):
                own = np.frombuffer(words.as_py(), dtype=np.uint64)
                if item_key is None:
                    key, doc = text, own
                    continue
                if text != key:
                    raise ValueError("a text's words don't come first")
                found = [(p, s) for s in shifts if len(p := overlap(doc, own, s))]
                places = np.unique(np.concatenate([p for p, _ in found])) if found else ()
                if found and len(places) >= coverage * len(own):
                    rows.append((text, item_key, len(places), len(own), min(int(p[0]) + s for p, s in found), max(int(p[-1]) + s for p, s in found) + 1))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _CHECK.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, bitmap_bits: int = 1 << 25) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, matched (words
    of the item found), item_words, coverage, first_word and end_word (in the document)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    item_seeds = cut(items.select("text").distinct().mapInArrow(_item_seeds, "seed long, item_key binary, item_at long").distinct())
    words = cut(items.mapInArrow(_item_words, "item_id long, item_key binary, item_words binary").distinct())
    near = spark.sparkContext.broadcast(build_bitmap(item_seeds, "seed", bitmap_bits))  # bits / 8 bytes, whatever the benchmark
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = cut(own.mapInArrow(_hits(near), "doc_id long, text_key binary, words binary, seeds array<long>, places array<long>"))
    # Texts are compared once, whatever the number of their copies.
    texts = hits.groupBy("text_key").agg(F.any_value(F.struct("words", "seeds", "places")).alias("t")).select("text_key", "t.*")
    texts = cut(texts)
    each = texts.select("text_key", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("text_key", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    shifts = each.join(item_seeds, "seed").select("text_key", "item_key", (F.col("place") - F.col("item_at")).cast("int").alias("shift")).distinct()
    met = shifts.groupBy("text_key", "item_key").agg(F.collect_list("shift").alias("shifts"))  # not more than the words of both
    asked = met.join(words.select("item_key", F.col("item_words").alias("words")).distinct(), "item_key").select("text_key", "item_key", "words", "shifts")
    held = texts.select("text_key", F.lit(None).cast("binary").alias("item_key"), "words", F.lit(None).cast("array<int>").alias("shifts")).join(met.select("text_key").distinct(), "text_key", "left_semi")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.unionByName(held).repartition(n, "text_key").sortWithinPartitions("text_key", F.col("item_key").asc_nulls_first())
    found = dealt.mapInArrow(_check(coverage), _CHECK)
    named = found.join(words.select("item_id", "item_key"), "item_key")
    return named.join(hits.select("doc_id", "text_key").distinct(), "text_key").select(
        "doc_id", "item_id", "matched", F.col("item_length").alias("item_words"), (F.col("matched") / F.col("item_length")).alias("coverage"), "first_word", "end_word"
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, by their text: other rows of the same doc_id stay."""
    dirty = contaminated(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("text_key")).distinct().alias("dirty")
    return docs.alias("docs").join(dirty, F.xxhash64("docs.text") == F.col("dirty.text_key"), "left_anti")
