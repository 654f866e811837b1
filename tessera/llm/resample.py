"""Importance resampling towards a target distribution over hashed word runs.

``resample`` weighs every row of a corpus by how much likelier its features are among the texts of a
target table, adds a Gumbel number of its id, and draws the rows of the highest scores:

* Features are all runs of one to three consecutive words; each falls into a bucket by its CRC-32. The
  buckets of a batch come from arrays: a run's CRC is that of its first words, shifted over the length
  of the next, so no run is ever made as a string. Tasks sum arrays of bucket counts, for the corpus and
  for the target; the logarithm of the two shares is the bucket's gain.
* A row's weight is the sum of its gains. Scores are written once, as a narrow table.
* The cutoff is found by bisection: exact count jobs over that table, each for a few thresholds, halve
  the range of scores again and again until one score is left; then the same among rows tied at it, by
  doc_id. Nothing is sorted for it, and the driver sees counts only.
* The drawn rows alone are partitioned by ranges of score and doc_id; each partition numbers its own.

Defined results: a null or empty text, or one without a word, has no features and the weight 0; it is
scored, and drawn only if ``least_words`` is 0. A null doc_id is hashed as "null" and comes last among
ties. Rows equal in doc_id and score tie further by n_features; of rows equal in that too any comes
first. Where nothing is to be drawn (an empty table, few rows) all ranks are null. An empty target
leaves the gains of an all-zero count. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, in_sizes, table
from .words import MARKS, Words

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = "42"
#: Thresholds that one count job tries.
WAYS = 15
#: Bytes of text whose features are in memory together.
BLOCK = 1 << 22

_POLYNOMIAL = 0xEDB88320
#: Lengths with a table of their own; longer shifts are composed of powers of two.
_SHORT = 64


def _step_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_STEP = _step_table()


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as four tables of 256, one for each byte."""
    out = operator[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ operator[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps of a CRC to what it adds to that of the same bytes with l more: for l up to _SHORT + 1, and for
    powers of two."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    short = [now]
    for _ in range(_SHORT + 1):
        now = _STEP[now & np.uint32(255)] ^ (now >> np.uint32(8))
        short.append(now)
    powers = [short[1]]
    for _ in range(40):
        powers.append(np.stack([_apply(powers[-1], row) for row in powers[-1]]))
    return np.stack(short), powers


_SHIFT, _POWERS = _shift_tables()
_FLAT = _SHIFT.reshape(-1)
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the CRC of the same bytes followed by ``length`` others."""
    own = np.minimum(length, _SHORT + 1) * 1024
    out = _FLAT[own + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= _FLAT[own + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    far = np.flatnonzero(length > _SHORT + 1)
    if len(far):
        x, n = crc[far], length[far]
        for k in range(int(n.max()).bit_length()):
            bit = (n >> k) & 1 == 1
            x[bit] = _apply(_POWERS[k], x[bit])
        out[far] = x
    return out


def word_crcs(words: Words) -> np.ndarray:
    """CRC-32 of each word's bytes, A-Z lowered: all words take one byte a step, longer ones are left to
    zlib."""
    raw = words.raw
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    length = words.end - words.start
    order = np.argsort(-np.minimum(length, _SHORT + 1).astype(np.int8), kind="stable")
    start, size = words.start[order], length[order]
    far = int(np.searchsorted(-size, -_SHORT, side="left")) if len(size) and size[0] > _SHORT else 0
    crc = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    counts = np.bincount(np.minimum(size, _SHORT), minlength=_SHORT + 1)
    active = len(size) - np.cumsum(counts)  # words longer than k
    for k in range(_SHORT):
        m = int(active[k])
        if m == 0:
            break
        c = crc[:m]
        crc[:m] = _STEP[(c ^ raw[start[:m] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for j in range(far):
        crc[j] = zlib.crc32(raw[start[j] : start[j] + size[j]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def feature_buckets(words: Words, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one word, of two, and so on: (bucket, number of the text) of every one of them."""
    own, length, text = word_crcs(words), words.end - words.start, words.text_of()
    # CRC of a space and the word, to be added to the shifted CRC of what stands before.
    after = shifted(np.full(len(own), _SPACE, dtype=np.uint32), length) ^ own
    runs = own
    for n in range(1, longest + 1):
        if n > 1:
            runs = shifted(runs[: len(own) - n + 1], length[n - 1 :] + 1) ^ after[n - 1 :]
        whole = text[: len(runs)] == text[n - 1 :] if n > 1 else slice(None)
        yield (runs[whole] % np.uint32(buckets)).astype(np.int64), text[: len(runs)][whole]
        if len(own) <= n:
            return


def bucket_counts(texts: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array in each task, then sums of them. The
    driver gets ``buckets`` numbers, whatever the size of the table."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in in_sizes(batches, "text", BLOCK):
            for bucket, _ in feature_buckets(Words(batch.column("text"), MARKS), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(total[has], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    per_task = texts.where("text IS NOT NULL").select("text").mapInArrow(count, "bucket long, n long")
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the ratio of smoothed shares, rounded down."""
    all_corpus, all_target, k = float(corpus.sum()), float(target.sum()), len(corpus)
    ratios = (((t + 1.0) * (all_corpus + k)) / ((s + 1.0) * (all_target + k)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def gumbel(doc_id: int | None, seed: str) -> int:
    name = "null" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scores(docs: DataFrame, gains: np.ndarray, *, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def score(batches):
        for batch in in_sizes(batches, "text", BLOCK):
            words = Words(batch.column("text"), MARKS)
            n = len(words)
            features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for bucket, text in feature_buckets(words, longest, len(gains)):
                features += np.bincount(text, minlength=n)
                upto = np.r_[0, np.cumsum(gains[bucket])]
                ends = np.searchsorted(text, np.arange(n + 1))
                weight += upto[ends[1:]] - upto[ends[:-1]]
            noise = np.fromiter((gumbel(i, seed) for i in batch.column("doc_id").to_pylist()), dtype=np.int64, count=n)
            cols = (words.counts().astype(np.int64), features, weight, weight + noise)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=[x.split()[0] for x in _SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, _SCORED)


def least_value(rows: DataFrame, column: Column, low: int, high: int, wanted: int) -> tuple[int, int]:
    """The least value v in low..high of an integer column for which at least ``wanted`` rows have one of
    at most v, and how many rows have less than v. Each job counts the rows up to ``WAYS`` thresholds,
    exactly; the range between the two next to the answer is the next job's. ``high`` must do."""
    below = 0
    while low < high:
        steps = min(WAYS + 1, high - low + 1)
        tries = [low + (high - low + 1) * k // steps - 1 for k in range(1, steps)]
        counts = rows.agg(*(F.count_if(column <= t).alias(f"c{k}") for k, t in enumerate(tries))).first()
        for t, count in zip(tries, counts, strict=True):
            if count >= wanted:
                high = t
                break
            low, below = t + 1, count
    return low, below


def _drawn(rows: DataFrame, wanted: int) -> Column:
    """Which rows are among the ``wanted`` highest scores, ties to the smaller doc_id. Rows equal in both
    all are, if one is."""
    ends = rows.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    # Rows are counted from the highest score down: -score rises.
    score, above = least_value(rows, -F.col("score"), -ends["high"], -ends["low"], wanted)
    tied = rows.where(F.col("score") == -score)
    ids = tied.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    if ids["n"] < wanted - above:  # rows without a doc_id come last
        return F.col("score") >= -score
    last, _ = least_value(tied, F.col("doc_id"), ids["low"], ids["high"], wanted - above)
    return (F.col("score") > -score) | ((F.col("score") == -score) & F.coalesce(F.col("doc_id") <= last, F.lit(False)))


def _ranked(rows: DataFrame, wanted: int) -> DataFrame:
    """rows with rank: their places (from 1), by score and then doc_id; null after ``wanted``. Ranges of both
    split many rows of one score as well."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    place = F.col("_before") + F.col("_row") - F.col("_first") + 1
    out = placed.join(counts.select("_part", "_first", before.alias("_before")), "_part")
    return out.withColumn("rank", F.when(place <= wanted, place)).drop("_part", "_row", "_first", "_before")


def resample(
    docs: DataFrame, target: DataFrame, *, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs. Of the N rows with at least
    ``least_words`` words, floor(share[0] * N / share[1]) are drawn and have a rank. ``target`` and docs
    have a column text."""
    gains = bucket_gains(bucket_counts(docs, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets))
    scored = cut(scores(docs, gains, longest=longest, seed=seed))
    fit = scored.where(F.col("n_words") >= least_words)
    wanted = share[0] * fit.count() // share[1]
    if wanted == 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    drawn = (F.col("n_words") >= least_words) & _drawn(fit, wanted)
    return _ranked(scored.where(drawn), wanted).unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
