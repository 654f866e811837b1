"""Substring dedup by paragraph MinHash banding: passages that repeat across documents.

Paragraphs are compared by the Jaccard similarity of their five-word shingles. They are

* the lines of a text of at least five words;
* the pieces of its lines of at least ``LONG`` words, cut where a word group has the smallest hash
  among the ``REACH`` groups before and after it. What stands elsewhere in the line doesn't move such
  a cut, so a passage inside a long line has its own pieces wherever it stands.

24 bands of 3 rows make candidates (a pair of similarity 0.75 is missed once in 500,000 times), which
are verified on their full sets. Linked paragraphs form components.

In addition, windows of ``window`` words are taken as paragraphs where they start at a word group with
the smallest hash among ``spread`` neighbours; of these only equal ones are linked. Any run of
``window + spread - 1`` words (50) that two documents share holds one at the same place in both.

Of a component that occurs in at least two documents, the first occurrence (smallest doc_id, then
place) is kept and the others are removals. Those of a text that touch or overlap become one span, so
that repeated short lines one after another are a passage; spans of ``least_words`` words or more are
reported.

Most paragraphs repeat nowhere. What may repeat is found from their 64-bit keys alone (``repeats``),
and bitmaps of bounded size tell the second pass over the texts which rows to write, and the third
which sets. Above 128 MB of bitmap more rows are written that repeat nowhere, and later joins drop them.

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower case. Rows of one
doc_id count as one document.

Defined results: null, empty or short texts have no paragraphs; repeated rows add nothing; a null
doc_id is a document of its own that comes before all others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import band_keys, busy_buckets, link_classes, list_array, node_hash, sketch
from .repeats import Repeats
from .shared import bitmap_bits, build_bitmap, cut, drop_with_shuffles, in_parts, table
from .words import MARKS, Words, distinct, mix, shingles, unique

LEAST_WORDS = 40
LONG = 100
REACH = 25
WINDOW = 40
SPREAD = 11
BANDS, ROWS = 24, 3
PERCENT = 75
_PART = 500
_NO_ID = -(1 << 63)
_K = np.uint64(0x9E3779B97F4A7C15)
_SET, _WINDOW = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)


def _groups(h: np.ndarray) -> np.ndarray:
    """A hash of each five words in a row."""
    out = np.zeros(max(0, len(h) - 4), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(5):
            out = (out + h[j : len(out) + j]) * _K
    return mix(out)


def _slide(pick: np.ufunc, values: np.ndarray, n: int) -> np.ndarray:
    """The least or greatest of each n values in a row."""
    width = 1
    while 2 * width <= n:
        values, width = pick(values[:-width], values[width:]), 2 * width
    return pick(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


def windows(words: Words, window: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word in all words, two 64-bit hashes (n, 2)) of the marked windows."""
    h, n = words.hash, len(words.hash)
    reach = window + spread - 1  # words of a row of neighbours and of the windows that start there
    if n < reach:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    text, group = words.text_of(), _groups(h)
    least = _slide(np.minimum, group[: n - window + 1], spread)
    least[text[: len(least)] != text[reach - 1 :][: len(least)]] = 0
    most = _slide(np.maximum, np.r_[np.zeros(spread - 1, np.uint64), least, np.zeros(spread - 1, np.uint64)], spread)
    at = np.flatnonzero(most == group[: len(most)])
    both = np.zeros((len(at), 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            w = h[at + j]
            both[:, 0] = (both[:, 0] + w) * _K
            both[:, 1] = mix(both[:, 1] + w)
    return at, both


def _lines(words: Words, least: int):
    """(first word, end word) of the lines of at least ``least`` words."""
    starts = np.flatnonzero(np.r_[True, words.raw[:-1] == 10]) if len(words.raw) else np.zeros(0, np.int64)
    edges = unique(np.r_[starts, words.at])
    first = np.searchsorted(words.start, edges)
    end = np.r_[first[1:], len(words.start)]
    long = np.flatnonzero(end - first >= least)
    return first[long], end[long]


class _Runs:
    """Runs of words as the texts of Words, for shingles()."""

    def __init__(self, words: Words, first: np.ndarray, end: np.ndarray):
        size = end - first
        self.first = np.r_[0, np.cumsum(size)]
        self.place = np.repeat(first - self.first[:-1], size) + np.arange(self.first[-1])  # in all words
        self.hash = words.hash[self.place] if len(size) else words.hash[:0]

    def counts(self):
        return np.diff(self.first)

    def text_of(self):
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def __len__(self):
        return len(self.first) - 1


def pieces(words: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of the pieces of the lines of at least ``LONG`` words."""
    long = end - first >= LONG
    lines = _Runs(words, first[long], end[long])
    if not len(lines):
        return first[:0], end[:0]
    line, group = lines.text_of(), _groups(lines.hash)
    least = _slide(np.minimum, group, REACH)
    at = np.arange(REACH, len(group) - REACH)
    marked = (group[at] < least[: len(at)]) & (group[at] < least[REACH + 1 :][: len(at)]) & (line[at - REACH] == line[at + REACH + 4])
    starts = unique(np.r_[at[marked], lines.first[:-1]])
    size = np.diff(np.r_[starts, len(line)])
    whole = size == lines.counts()[line[starts]]  # is a line already
    return lines.place[starts][~whole], (lines.place[starts] + size)[~whole]


class _Paragraphs:
    """Lines and pieces: ``first`` and ``end`` word, and the set ``values[at[k]:at[k + 1]]`` of each;
    ``node``: two 64-bit hashes (n, 2) of the set."""

    def __init__(self, words: Words):
        first, end = _lines(words, 5)
        more, ends = pieces(words, first, end)
        self.first, self.end = np.r_[first, more], np.r_[end, ends]
        self.values, self.at = distinct(*shingles(_Runs(words, self.first, self.end)), len(self.first))
        self.node = np.zeros((len(self.first), 2), np.uint64)
        if len(self.first):
            with np.errstate(over="ignore"):
                self.node[:, 0] = mix(np.add.reduceat(mix(self.values), self.at[:-1]))
                self.node[:, 1] = mix(np.add.reduceat(mix(self.values * _K + np.uint64(1)), self.at[:-1]))

    def once(self) -> np.ndarray:
        """The first place of each set."""
        return np.unique(self.node[:, 0], return_index=True)[1]

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Band keys (n, BANDS) of some paragraphs."""
        size = np.diff(self.at)[rows]
        first = np.r_[0, np.cumsum(size)]
        own = np.repeat(self.at[:-1][rows] - first[:-1], size) + np.arange(first[-1])
        return band_keys(sketch(self.values[own], first, BANDS * ROWS), BANDS, ROWS)


def _owners(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _all_keys(window: int, spread: int):
    """Band keys with the paragraphs' sets as owners; sets and windows with documents as owners."""

    def run(batches):
        for batch in in_parts(batches, _PART):
            words = Words(batch.column("text"), MARKS)
            if not len(words.start):
                continue
            doc, text, own = mix(_owners(batch).view(np.uint64)), words.text_of(), _Paragraphs(words)
            rows = own.once()
            yield True, own.keys(rows).reshape(-1), np.repeat(own.node[rows, 0], BANDS)
            yield False, own.node[:, 0] ^ _SET, doc[text[own.first]]
            at, both = windows(words, window, spread)
            yield False, both[:, 0] ^ _WINDOW, doc[text[at]]

    return run


_HIT = "doc_id long, text_key long, first_word int, n_words int, node binary, buckets array<long>"


def _hits(near_keys, near_sets, repeats: Repeats, window: int, spread: int):
    """The paragraphs and windows with a key that repeats; the first of a set has its repeated band
    keys."""

    def run(batches):
        for batch in in_parts(batches, _PART):
            words = Words(batch.column("text"), MARKS)
            if not len(words.start):
                continue
            has = lambda keys, owned=False: near_keys.value.has(repeats.key_of(keys, owned).view(np.uint64))
            own, text = _Paragraphs(words), words.text_of()
            rows = own.once()
            rows = rows[near_sets.value.has(repeats.owner_of(own.node[rows, 0]).view(np.uint64))]
            keys = own.keys(rows)
            again = has(keys.reshape(-1), True).reshape(keys.shape)
            hit = has(own.node[:, 0] ^ _SET) | np.isin(own.node[:, 0], own.node[rows, 0])
            hit[rows] = False
            hit = np.flatnonzero(hit)
            at, both = windows(words, window, spread)
            shared = has(both[:, 0] ^ _WINDOW)
            at, both = at[shared], both[shared]
            first = np.r_[own.first[rows], own.first[hit], at]
            size = np.r_[(own.end - own.first)[rows], (own.end - own.first)[hit], np.full(len(at), window)]
            packed = np.concatenate([own.node[rows], own.node[hit], both]).astype(">u8").tobytes()
            counts = np.r_[0, np.cumsum(again.sum(axis=1)), np.full(len(first) - len(rows), again.sum())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_owners(batch)[text[first]]),
                    batch.column("text_key").take(pa.array(text[first])),
                    pa.array((first - words.first[text[first]]).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array([packed[16 * k : 16 * k + 16] for k in range(len(first))], pa.binary()),
                    list_array(repeats.key_of(keys[again], True), counts),
                ],
                names=[x.split()[0] for x in _HIT.split(", ")],
            )

    return run


def _elements(near):
    """The sets of the paragraphs whose first eight bytes are in a bitmap."""

    def run(batches):
        for batch in in_parts(batches, _PART):
            own = _Paragraphs(Words(batch.column("text"), MARKS))
            rows = own.once()
            rows = rows[near.value.has(own.node[rows, 0])]
            packed = own.node[rows].astype(">u8").tobytes()
            nodes = [packed[16 * k : 16 * k + 16] for k in range(len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([own.values[own.at[k] : own.at[k + 1]].tobytes() for k in rows], pa.binary())], names=["node", "elements"])

    return run


_SPAN = "doc_id long, text_key long, kept boolean, first_word int, end_word int, from_id long"


def _merged(batches):
    """Spans from the paragraphs of each text in order: those that touch or overlap become one. The last
    span of a batch is met by the next batch as if it were a paragraph."""
    names = [x.split()[0] for x in _SPAN.split(", ")]
    last = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        cols = [np.r_[a, b] for a, b in zip(last, cols, strict=True)] if last else cols
        if not len(cols[0]):
            continue
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)]  # another text
        first, end = cols[3].astype(np.int64), cols[4].astype(np.int64)
        over = np.cumsum(new) << 32
        reach = np.maximum.accumulate(end + over) - over
        at = np.flatnonzero(new | np.r_[True, first[1:] > reach[:-1]])
        spans = [*(c[at] for c in cols[:4]), np.maximum.reduceat(cols[4], at), np.minimum.reduceat(cols[5], at)]
        last = [c[-1:] for c in spans]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in spans], names=names)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)


def _spans(docs: DataFrame, *, least_words: int, window: int, spread: int, percent: int) -> DataFrame:
    """Spans with the hash of their text, text_key."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))
    repeats = Repeats(own)
    found = cut(repeats.find(own, _all_keys(window, spread)))
    counts = found.agg(F.count_if(~F.col("owner")), F.count_if("owner")).first()
    near = [spark.sparkContext.broadcast(build_bitmap(found.where(F.col("owner") == is_owner), "value", bitmap_bits(n))) for is_owner, n in zip((False, True), counts, strict=True)]  # 128 MB each at most
    drop_with_shuffles(found)
    hits = cut(own.mapInArrow(_hits(*near, repeats, window, spread), _HIT))
    each = cut(hits.select("node", F.explode("buckets").alias("bucket")).distinct())
    places = hits.drop("buckets")
    members = cut(busy_buckets(each))
    drop_with_shuffles(each)
    nodes = cut(members.select("node").distinct())
    met = spark.sparkContext.broadcast(build_bitmap(nodes.select(node_hash("node").alias("h")), "h", bitmap_bits(nodes.count())))  # 128 MB at most
    sets = own.select("text").mapInArrow(_elements(met), "node binary, elements binary").join(nodes, "node", "left_semi")
    sets = cut(sets.groupBy("node").agg(F.any_value("elements").alias("elements")))
    drop_with_shuffles(nodes)
    roots = link_classes(members, sets, percent=percent, prune_first=False)
    place = F.struct("doc_id", "text_key", "first_word")
    classes = places.groupBy("node").agg(F.min(place).alias("lo"), F.max("doc_id").alias("hi"))
    rooted = cut(classes.join(roots, "node", "left"))
    drop_with_shuffles(roots)
    # Most nodes have no links and are their own components: only the others are grouped once more.
    alone, linked = rooted.where("root IS NULL AND lo.doc_id < hi").select("node", F.col("lo").alias("least")), rooted.where("root IS NOT NULL")
    met = linked.groupBy("root").agg(F.min("lo").alias("least"), F.max("hi").alias("hi")).where("least.doc_id < hi").select("root", "least")
    shared = cut(alone.unionByName(linked.join(met, "root").select("node", "least")))
    drop_with_shuffles(rooted)
    again = places.join(shared, "node").select(
        "doc_id", "text_key", "first_word", (F.col("first_word") + F.col("n_words")).alias("end_word"), (F.col("least") == place).alias("kept"), F.col("least.doc_id").alias("from_id")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = again.repartition(n, "doc_id", "text_key", "kept").sortWithinPartitions("doc_id", "text_key", "kept", "first_word", "end_word")
    spans = dealt.mapInArrow(_merged, _SPAN)
    named = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    long = spans.where(F.col("end_word") - F.col("first_word") >= least_words)
    return long.select(named("doc_id").alias("doc_id"), "text_key", "first_word", "end_word", "kept", named("from_id").alias("component_id"))


def repeated_passages(docs: DataFrame, *, least_words: int = LEAST_WORDS, window: int = WINDOW, spread: int = SPREAD, percent: int = PERCENT) -> DataFrame:
    """Spans of words that repeat across documents: doc_id, first_word, end_word, kept (whether
    the span is made of first occurrences), component_id (the smallest doc_id that the span's
    paragraphs occur in)."""
    return _spans(docs, least_words=least_words, window=window, spread=spread, percent=percent).drop("text_key")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


_REMOVED = "_removed_spans_of_words"


def _stripped(batches):
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(_REMOVED).to_pylist(), strict=True):
            if text is not None and spans:
                raw, w = text.encode("utf-8"), Words(pa.array([text]), MARKS)
                out, at = [], 0
                for a, b in sorted((s["first_word"], s["end_word"]) for s in spans):
                    out.append(raw[at : w.start[a]])
                    at = int(w.start[b]) if b < len(w.start) else len(raw)
                text = b"".join([*out, raw[at:]]).decode("utf-8")
            texts.append(text)
        cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n != _REMOVED]
        yield pa.RecordBatch.from_arrays(cols, names=[n for n in batch.schema.names if n != _REMOVED])


def strip_repeats(docs: DataFrame, *, least_words: int = LEAST_WORDS, window: int = WINDOW, spread: int = SPREAD, percent: int = PERCENT) -> DataFrame:
    """docs without the removals, from each one's first word to the word after its last. Rows are
    told apart by doc_id and text."""
    spans = _spans(docs, least_words=least_words, window=window, spread=spread, percent=percent).where(~F.col("kept"))
    removed = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first_word", "end_word")).alias(_REMOVED)).alias("removed")
    on = F.col("docs.doc_id").cast("long").eqNullSafe(F.col("removed.doc_id")) & (F.xxhash64("docs.text") == F.col("removed.text_key"))
    joined = docs.alias("docs").join(removed, on, "left").select("docs.*", F.col(f"removed.{_REMOVED}"))
    return joined.mapInArrow(_stripped, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
