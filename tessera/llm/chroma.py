"""Chroma audio fingerprints of a column of recordings, and a search that aligns them.

A recording (16-bit mono PCM) becomes frames; a frame's spectrum is folded into the energies of
the twelve pitch classes. Over the image of frames and pitch classes, sums of rectangles come from
an integral image: sixteen filters compare halves, thirds and quarters of rectangles, and each
gives two bits (Gray code of where its value lies between three thresholds), 32 bits for a place.

``search`` aligns recordings: places that hold the smallest hash among ``spread`` neighbours are
keys; equal keys of a query and a recording vote for the offset between them, and for each offset
with ``votes`` votes the fingerprints are laid over each other and their different bits counted.

Defined results: null, empty or too short audio has an empty fingerprint and matches nothing;
equal fingerprints are searched once and share the result; silence is a recording like others;
repeated rows have equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table
from .words import mix

RATE = 8_000
FRAME, HOP = 2_048, 512
LOW_HZ, HIGH_HZ = 110.0, 1_800.0
SPAN = 8  # frames that a place's filters cover
#: (kind, first pitch class, height, frames, step between thresholds): kinds are 0 all against the image's mean, 1 upper
#: against lower half, 2 earlier against later half, 3 diagonal quarters, 4 middle third of the
#: pitch classes against the others, 5 middle third of the frames against the others.
FILTERS = (
    (0, 0, 4, 4, 0.20), (0, 4, 4, 6, 0.11), (0, 8, 4, 8, 0.13), (1, 0, 8, 6, 0.23), (1, 4, 8, 8, 0.17), (1, 2, 4, 4, 0.45),
    (2, 0, 6, 8, 0.17), (2, 6, 6, 8, 0.18), (2, 3, 4, 4, 0.20), (3, 0, 8, 8, 0.22), (3, 4, 8, 8, 0.22), (3, 2, 6, 4, 0.18),
    (4, 0, 9, 6, 0.25), (4, 3, 9, 8, 0.20), (5, 0, 12, 6, 0.09), (5, 6, 6, 6, 0.09),
)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
SPREAD = 1
APART = (1, 2)
MAX_ERROR = 0.15
LEAST_OVERLAP = 16


def _fold() -> np.ndarray:
    """(bins, 12): which pitch class a bin of the spectrum counts for."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), dtype=np.float32)
    for k in np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ)):
        out[k, int(round(12 * np.log2(hz[k] / 440.0))) % 12] = 1
    return out


_FOLD = _fold()
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(audio: np.ndarray) -> np.ndarray:
    """(frames, 12) energies of the pitch classes, each frame scaled to length 1 (silence: 0)."""
    if len(audio) < FRAME:
        return np.zeros((0, 12), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(audio, FRAME)[::HOP]
    parts = [np.abs(np.fft.rfft(frames[k : k + 256] * _HANN, axis=1)) ** 2 @ _FOLD for k in range(0, len(frames), 256)]
    energy = np.sqrt(np.concatenate(parts))
    size = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return energy / np.maximum(size, 1e-6)


def fingerprint(audio: np.ndarray) -> np.ndarray:
    """32-bit integers, one for each place."""
    image = chroma(audio)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def box(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        """Mean of frames x0 to x1 after each place and pitch classes y0 to y1."""
        s = whole[x1 : x1 + n, y1] - whole[x0 : x0 + n, y1] - whole[x1 : x1 + n, y0] + whole[x0 : x0 + n, y0]
        return s / ((x1 - x0) * (y1 - y0))

    bits = np.zeros(n, dtype=np.uint32)
    for k, (kind, y, h, w, step) in enumerate(FILTERS):
        y = min(y, 12 - h)
        if kind == 0:
            a, b = box(0, w, y, y + h), box(0, SPAN, 0, 12)
        elif kind == 1:
            a, b = box(0, w, y, y + h // 2), box(0, w, y + h // 2, y + h)
        elif kind == 2:
            a, b = box(0, w // 2, y, y + h), box(w // 2, w, y, y + h)
        elif kind == 3:
            a = box(0, w // 2, y, y + h // 2) + box(w // 2, w, y + h // 2, y + h)
            b = box(w // 2, w, y, y + h // 2) + box(0, w // 2, y + h // 2, y + h)
        elif kind == 4:
            a, b = box(0, w, y + h // 3, y + 2 * h // 3), (box(0, w, y, y + h // 3) + box(0, w, y + 2 * h // 3, y + h)) / 2
        else:
            a, b = box(w // 3, 2 * w // 3, y, y + h), (box(0, w // 3, y, y + h) + box(2 * w // 3, w, y, y + h)) / 2
        value = np.log((a + 0.02) / (b + 0.02))
        bits |= _GRAY[np.searchsorted((-step, 0.0, step), value)] << np.uint32(2 * k)
    return bits


def keys(prints: np.ndarray, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): a key is made of the integers of a place and of another ``APART`` later; of
    equal ones in a row the first. Those with the smallest hash among ``spread`` neighbours."""
    at, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for apart in APART:
        if len(prints) <= apart:
            continue
        with np.errstate(over="ignore"):
            both = mix(((prints[:-apart].astype(np.uint64) << np.uint64(32)) | prints[apart:].astype(np.uint64)) + np.uint64(apart))
        near = np.lib.stride_tricks.sliding_window_view(both, min(spread, len(both)))
        own = np.unique(np.arange(len(near)) + near.argmin(axis=1))
        own = own[np.r_[True, both[own[1:]] != both[own[:-1]]]]
        at.append(own)
        out.append(both[own])
    return np.concatenate(at), np.concatenate(out).view(np.int64)


def _print(batches):
    for batch in batches:
        out = []
        for audio in batch.column("audio"):
            raw = audio.as_buffer() if audio.is_valid else b""
            pcm = np.frombuffer(raw, dtype="<i2", count=len(raw) // 2) if len(raw) else np.zeros(0, "<i2")
            out.append(fingerprint(pcm.astype(np.float32)).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(out, pa.binary())], names=["media_id", "prints"])


def fingerprints(media: DataFrame) -> DataFrame:
    """media_id and packed 32-bit integers of every row of media(media_id, audio)."""
    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("audio").cast("binary").alias("audio")).mapInArrow(_print, "media_id long, prints binary")


def _keys(batches):
    for batch in batches:
        ids, values, places = [], [], []
        for node, prints in zip(batch.column("node").to_pylist(), batch.column("prints").to_pylist(), strict=True):
            own = np.frombuffer(prints, dtype="<u4")
            at, both = keys(own)
            ids += [node] * len(at)
            values.append(both)
            places.append(at.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(np.concatenate(values) if values else [], pa.int64()), pa.array(np.concatenate(places) if places else [], pa.int32())],
            names=["node", "key", "place"],
        )


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(different bits, places) where b lies offset places after a's start."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()), hi - lo


def _align(batches):
    for batch in batches:
        errors, places = [], []
        for a, b, offset in zip(batch.column("a"), batch.column("b"), batch.column("offset").to_pylist(), strict=True):
            e, n = bit_errors(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4"), offset)
            errors.append(e)
            places.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("q"), batch.column("node"), batch.column("offset"), batch.column("n_votes"), pa.array(errors, pa.int64()), pa.array(places, pa.int64())],
            names=["q", "node", "offset", "n_votes", "errors", "places"],
        )


def search(prints: DataFrame, queries: DataFrame, *, votes: int = 1, max_error: float = MAX_ERROR, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """The best alignment of each query class with each other class: q and node (MD5 of the
    fingerprints), offset, n_votes, errors, places. prints and queries: media_id, prints."""
    classes = cut(prints.where(F.length("prints") > 0).select(F.unhex(F.md5("prints")).alias("node"), "prints").groupBy("node").agg(F.any_value("prints").alias("prints")))
    asked = queries.where(F.length("prints") > 0).select(F.unhex(F.md5("prints")).alias("node")).distinct()
    keyed = cut(classes.mapInArrow(_keys, "node binary, key long, place int"))
    mine = keyed.join(asked, "node").select(F.col("node").alias("q"), "key", F.col("place").alias("at"))
    met = mine.join(keyed, "key").where("q <> node").select("q", "node", (F.col("at") - F.col("place")).alias("offset"))
    tally = met.groupBy("q", "node", "offset").agg(F.count(F.lit(1)).alias("n_votes")).where(F.col("n_votes") >= votes)
    sides = tally.join(classes.select("node", F.col("prints").alias("b")), "node").join(classes.select(F.col("node").alias("q"), F.col("prints").alias("a")), "q")
    aligned = sides.mapInArrow(_align, "q binary, node binary, offset int, n_votes long, errors long, places long")
    good = aligned.where((F.col("places") >= least_overlap) & (F.col("errors") <= F.col("places") * 32 * max_error))
    rate = (F.col("errors") / F.col("places")).alias("rate")
    best = F.min(F.struct(rate, F.abs("offset"), "offset", "n_votes", "errors", "places")).alias("best")
    return good.groupBy("q", "node").agg(best).select("q", "node", "best.offset", "best.n_votes", "best.errors", "best.places")


def links(prints: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """One row for each row of queries: media_id, class_id (the smallest media_id with an equal
    fingerprint), n_places, n_links (other classes that align with it), and the best of them:
    best_id, offset, bit_error_rate."""
    named = prints.groupBy(F.unhex(F.md5("prints")).alias("node")).agg(F.min("media_id").alias("class_id"))
    found = search(prints, queries, **options).join(named.withColumnRenamed("class_id", "other"), "node")
    rate = F.col("errors") / (32 * F.col("places"))
    best = found.groupBy("q").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct(rate.alias("rate"), "other", "offset")).alias("best"))
    own = queries.select("media_id", F.unhex(F.md5("prints")).alias("node"), (F.length("prints") / 4).cast("long").alias("n_places"))
    return own.join(named, "node").join(best.withColumnRenamed("q", "node"), "node", "left").select(
        "media_id", "class_id", "n_places", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("best.other").alias("best_id"), F.col("best.offset").alias("offset"), F.col("best.rate").alias("bit_error_rate"),
    )


SEGMENTS, SEGMENT = 16, 2_048


def _sound(batches):
    """A vector as sound: in each of 16 segments the twelve pitch classes sound as loud as twelve
    of its values say, so that close vectors sound alike."""
    t = np.arange(SEGMENT) / RATE
    tones = np.sin(2 * np.pi * (220.0 * 2 ** (np.arange(12) / 12))[:, None] * t).astype(np.float32)
    for batch in (b.slice(k, 100) for b in batches for k in range(0, len(b), 100)):
        out = []
        for vector in batch.column("embedding"):
            v = np.array(vector.as_py() or [], dtype=np.float32)
            if not len(v):
                out.append(None)
                continue
            at = (np.arange(SEGMENTS)[:, None] * len(v) // SEGMENTS + np.arange(12)) % len(v)
            loud = np.exp(np.clip(np.nan_to_num(v)[at] * np.sqrt(len(v)), -4, 4))
            wave = ((loud / loud.sum(axis=1, keepdims=True)) @ tones).reshape(-1)
            out.append((wave * 20_000).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(out, pa.binary())], names=["media_id", "audio"])


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so the vectors of ``embeddings`` are made into sound. Every
    recording whose id is divisible by 20 is searched among all."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("media_id"), "embedding")
    # Sound and fingerprint in one pass, a hundred recordings at a time: the sound is far larger than either.
    prints = cut(vectors.mapInArrow(lambda batches: _print(_sound(batches)), "media_id long, prints binary"))
    return links(prints, prints.where("media_id % 20 = 0"))
