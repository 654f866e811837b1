"""Token ids of all documents in raw shards, with a minimal perfect hash index for keyed access.

Shards. ``write_tokens`` deals documents by ranges of doc_id, encodes them, and appends an end id to each.
Ids are little-endian integers (two bytes where the vocabulary has at most 65,536 ids, else four), one
document after another in ascending doc_id order. A shard file is

    page MARK page MARK ... footer MARK

with MARK two bytes 0A. A page holds whole documents: it is closed when it has PAGE bytes. A shard has at
most SHARD_PAGES pages, so that no file grows with the input. The footer lists the documents of the shard
(their ids, byte offsets, counts of ids before them and of their own) and ends in its own length, as
16 digits. Spark's text sink writes the bytes, with its commit protocol, on any file system it knows; a lost
task's files are written again.

Index. ``build_index`` maps a key (doc_id, occurrence; repeated doc_ids are counted from 0) to a slot without
storing keys: keys are dealt into buckets by their hash; within a bucket they are hashed into a bitmap, those
that meet another one go on to the next, smaller bitmap, until all have a bit of their own; a key's slot is
the number of bits before its own (a minimal perfect hash: n keys, slots 0 to n - 1). At its slot a key has a
32-bit fingerprint, shard, offset, start and count. ``lookup`` finds keys in constant time each: bucket, bits,
slot, fingerprint; a key that isn't stored is found by mistake once in four billion times. ``fetch`` reads
the ids at such entries from the raw payloads, shard by shard.

Encoding. Texts are cut before single spaces, and between an ASCII letter and a mark other than an
apostrophe: no pretoken spans these, whatever stands around. Arrow numbers the different units of a batch; the
library encodes those that a bounded table of earlier ones lacks. Texts with a special token's name are
encoded whole.

Defined results: null and empty texts have the end id alone; a null doc_id comes last and is a key like others;
rows with one doc_id are in the order of the table's files and are told apart by occurrence, many of them may
fill any number of shards; an empty table gives a store without shards; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, free_shuffles, in_sizes, scratch, table
from .words import mix, text_bytes

PAGE = 1 << 20
SHARD_PAGES = 32
#: Bytes of text in one range of doc_ids.
RANGE_BYTES = 32 << 20
MARK = b"\n\n"
KEYS_PER_BUCKET = 1 << 15
#: Bits of a bitmap for each key that is left.
SPARE = 2
#: Units whose ids a worker keeps; the table is emptied when it is full.
KEPT_UNITS = 400_000
#: Units that are encoded as one text.
JOINED_UNITS = 4_096
BLOCK = 1 << 22

_LETTER, _MARK, _BEGINS = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
#: First bytes of characters that aren't white space, whatever follows: white space outside ASCII starts with
#: C2, E1, E2 or E3.
_BEGINS[[*range(33, 127), *(b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3))]] = True


#: Units that begin with a cut before a space, and those that begin with a cut before a mark.
_SPACED, _MARKED = r"\A [!-~\x{C0}-\x{FFF}\x{4000}-\x{10FFFF}]", r"\A[!-&(-/:-@\[-`{-~]"


class UnitCoder:
    """A byte-level vocabulary file's encoder, for cut texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or spec["normalizer"]:
            raise ValueError("the vocabulary must be byte-level, without a normalizer or a leading space")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        # each character of a token's name stands for a byte
        self.lengths = np.array([len(self.lib.id_to_token(i) or "") for i in range(self.lib.get_vocab_size())], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.units, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _joined(self, units: pa.Array, before: str) -> pa.Array:
        """The packed ids of units, encoded as one text with ``before`` ahead of each. No token spans a unit and what
        stands around it, so that the tokens' bytes tell where its own begin and end."""
        raw, ends = text_bytes(pc.binary_replace_slice(units, 0, 0, before) if before else units)
        ids = np.array(self.lib.encode_batch_fast([raw.tobytes().decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
        upto = np.r_[0, np.cumsum(self.lengths[ids])]
        wanted = np.stack([ends[:-1] + len(before), ends[1:]])
        start, end = np.searchsorted(upto, wanted)
        if not np.array_equal(upto[np.minimum([start, end], len(ids))], wanted):
            raise ValueError("a token spans two units")
        step = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, end, -1)
        own, places = ids[np.cumsum(step)[:-1] > 0], np.r_[0, np.cumsum(end - start)] * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(places), pa.py_buffer(own)])

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """An order of different units, and their packed ids in it."""
        spaced, marked = (pc.match_substring_regex(units, r) for r in (_SPACED, _MARKED))
        for content in self.special:
            has = pc.match_substring(units, content)
            spaced, marked = pc.and_not(spaced, has), pc.and_not(marked, has)
        order = [np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (pc.invert(pc.or_(spaced, marked)), spaced, marked)]
        alone = self.lib.encode_batch_fast(units.take(pa.array(order[0])).to_pylist(), add_special_tokens=False)
        out = [pa.array([np.array(e.ids, dtype=self.dtype).tobytes() for e in alone], pa.large_binary())]
        # Cuts before a space, and those between a letter and a mark, hold whatever stands around.
        for which, before in zip(order[1:], ("", " a"), strict=True):
            out += [self._joined(units.take(pa.array(which[at : at + JOINED_UNITS])), before) for at in range(0, len(which), JOINED_UNITS)]
        return np.concatenate(order), out

    def _ids_of(self, units: pa.Array) -> pa.Array:
        """The packed ids of different units."""
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy()
        if len(self.units) + (at < 0).sum() > KEPT_UNITS:
            self._forget()
            at = np.full(len(units), -1)
        new, at = np.flatnonzero(at < 0), at.copy()
        order, ids = self._encoded(units.take(pa.array(new)))
        at[new[order]] = len(self.units) + np.arange(len(new))
        self.units = pa.concat_arrays([self.units, units.take(pa.array(new[order]))])
        self.ids = pa.concat_arrays([self.ids, *ids])
        return self.ids.take(pa.array(at))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of every text; null counts as empty."""
        raw, at = text_bytes(texts)
        if len(raw) == 0:
            return [b""] * len(texts)
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[1:-2] = (raw[1:-1] == 32) & _BEGINS[raw[2:]]
        edge[1:-1] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]
        for content in self.special:
            for k in np.flatnonzero([t.as_py() is not None and content in t.as_py() for t in texts]) if content.encode() in raw.tobytes() else ():
                edge[at[k] : at[k + 1]] = False
        edge[at] = True
        cuts = np.flatnonzero(edge)
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw))
        numbered = units.dictionary_encode()
        every = self._ids_of(numbered.dictionary).take(numbered.indices)
        _, offsets, data = every.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64, count=len(cuts))[np.searchsorted(cuts, at)].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


_CODERS: dict[str, UnitCoder] = {}


def unit_coder(path: str) -> UnitCoder:
    if path not in _CODERS:
        _CODERS[path] = UnitCoder(path)
    return _CODERS[path]


class _Shard:
    """The documents of a shard that is being written."""

    def __init__(self, number: int, width: int):
        self.number, self.width = number, width
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.places: list[int] = []
        self.size = self.pages = 0
        self.page: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // self.width)
        self.places.append(self.size + self.held)
        self.page.append(ids)
        self.held += len(ids)

    def close_page(self) -> bytes:
        out = b"".join(self.page)
        self.size, self.pages = self.size + len(out) + len(MARK), self.pages + 1
        self.page, self.held = [], 0
        return out

    def footer(self) -> bytes:
        n = len(self.doc_ids)
        has = np.array([i is not None for i in self.doc_ids], dtype=np.uint8)
        numbers = ([i or 0 for i in self.doc_ids], self.places, self.sizes)
        body = b"".join([np.array([self.number, n], "<i8").tobytes(), *(np.array(x, "<i8").tobytes() for x in numbers), has.tobytes()])
        return body + b"%016d" % len(body)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, *, page: int = PAGE, shard_pages: int = SHARD_PAGES, range_bytes: int = RANGE_BYTES) -> None:
    """Writes the shards of all rows of docs into the folder ``path``."""

    def shards(batches):
        c = unit_coder(tokenizer)
        end = np.array([end_id], dtype=c.dtype).tobytes()
        base, number = TaskContext.get().partitionId() << 32, 0
        shard = _Shard(base, c.dtype.itemsize)

        def row(value):
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        for batch in in_sizes(batches, "text", BLOCK):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), c.encode(batch.column("text")), strict=True):
                shard.add(doc_id, ids + end)
                if shard.held >= page:
                    yield row(shard.close_page())
                    if shard.pages == shard_pages:
                        yield row(shard.footer())
                        number += 1
                        shard = _Shard(base + number, c.dtype.itemsize)
        if shard.doc_ids:
            if shard.page:
                yield row(shard.close_page())
            yield row(shard.footer())

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    # Many rows of one doc_id are split by their places in the table.
    own = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("place"))
    order = [F.asc_nulls_last("doc_id"), F.asc("place")]
    rows = own.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(shards, "value binary")
    # A shard is a file: its pages and its footer.
    rows.select(F.col("value").cast("string")).write.option("lineSep", MARK.decode()).option("maxRecordsPerFile", shard_pages + 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """footer and content of every shard."""
    tail = 16 + len(MARK)
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > tail).select("content")
    size = F.substring("content", -tail, 16).cast("string").cast("int")
    footer = F.col("content").substr(F.length("content") - tail + 1 - size, size)
    return files.select("content", footer.alias("footer"))


def _footer(footer: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """shard, doc_id, has doc_id, offset, n_tokens of a shard's documents."""
    shard, n = np.frombuffer(footer, "<i8", 2).tolist()
    doc_id, place, size = np.frombuffer(footer, "<i8", 3 * n, 16).reshape(3, n)
    return shard, doc_id, np.frombuffer(footer, np.uint8, n, 16 + 24 * n), place, size


_LISTED = "shard long, doc_id long, occurrence long, offset long, before long, n_tokens long, place long, shard_tokens long"


def _list_documents(batches):
    for batch in batches:
        for footer in batch.column("footer"):
            shard, doc_id, has, place, size = _footer(footer.as_py())
            n = len(doc_id)
            new = np.r_[True, (doc_id[1:] != doc_id[:-1]) | (has[1:] != has[:-1])]
            at = np.arange(n)
            occurrence = at - at[new][np.cumsum(new) - 1]
            cols = (np.full(n, shard), pa.array(doc_id, mask=has == 0), occurrence, place, np.cumsum(size) - size, size, at, np.full(n, size.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in _LISTED.split(", ")])


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for every document of a store, from the shards' footers: shard, doc_id, occurrence (among equal
    doc_ids, from 0), offset (bytes), start (ids of all documents before it) and n_tokens. Counts of ids and
    of equal doc_ids run on from shard to shard: a row for each shard is summed for that."""
    listed = cut(_files(spark, path).select("footer").mapInArrow(_list_documents, _LISTED))
    shards = listed.groupBy("shard").agg(F.min_by(F.struct("doc_id"), "place").alias("first"), F.max("shard_tokens").alias("n"), F.max_by(F.struct("doc_id", (F.col("occurrence") + 1).alias("count")), "place").alias("last"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    tail = shards.select("shard", F.col("last.doc_id").alias("tail_id"), F.col("last.count").alias("tail"))
    before_own = Window.partitionBy("tail_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = tail.withColumn("upto", F.sum("tail").over(before_own))
    # the rows of a shard's first doc_id in earlier shards: those shards end in it
    place = Window.orderBy("shard")
    previous = tails.select("shard", F.lag("tail_id").over(place).alias("p_id"), F.lag("upto").over(place).alias("p_upto"))
    base = shards.join(previous, "shard").select(
        "shard",
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"),
        F.col("first.doc_id").alias("first_id"),
        F.when((F.row_number().over(place) > 1) & F.col("p_id").eqNullSafe(F.col("first.doc_id")), F.col("p_upto")).otherwise(0).alias("earlier"),
    )
    rows = listed.join(base, "shard")
    occurrence = F.col("occurrence") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("earlier")).otherwise(0)
    return rows.select("shard", "doc_id", occurrence.alias("occurrence"), "offset", (F.col("base") + F.col("before")).alias("start"), "n_tokens")


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with two hashes of their key, and its bucket."""
    one, two = F.xxhash64("doc_id", "occurrence"), F.xxhash64(F.lit("two"), "occurrence", "doc_id")
    return rows.withColumns({"h1": one, "h2": two}).withColumn("bucket", F.pmod("h1", F.lit(buckets)))


def _spot(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h1 + mix(h2 + np.uint64(level + 1))) % np.uint64(bits)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h2 ^ (h1 * np.uint64(3))) >> np.uint64(32)).astype("<u4")


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bitmaps in which each of these different keys has a bit of its own, in the first one where it meets no
    other."""
    levels = []
    while len(h1):
        if len(levels) == 256:
            raise ValueError("two keys have the same hashes")
        bits = -(-SPARE * len(h1) // 8) * 8
        spot = _spot(h1, h2, len(levels), bits)
        alone = np.bincount(spot.astype(np.int64), minlength=bits)
        levels.append(alone == 1)
        left = alone[spot.astype(np.int64)] > 1
        h1, h2 = h1[left], h2[left]
    return levels


def slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's slot: how many bits are set before its own. -1 if no bit is set for it."""
    out, open_, before = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for k, bitmap in enumerate(levels):
        rank = np.cumsum(bitmap)
        spot = _spot(h1[open_], h2[open_], k, len(bitmap)).astype(np.int64)
        hit = bitmap[spot]
        out[open_[hit]] = before + rank[spot[hit]] - 1
        before += int(rank[-1])
        open_ = open_[~hit]
    return out


_ENTRY = ("shard", "offset", "start", "n_tokens")
_INDEX = "bucket long, n_keys long, level_bits array<long>, bitmaps binary, fingerprints binary, " + ", ".join(f"{c} binary" for c in _ENTRY)


def _hashes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))


def _build_bucket(rows: pa.Table) -> pa.Table:
    h1, h2 = _hashes(rows)
    levels = perfect_hash(h1, h2)
    place = np.argsort(slots(levels, h1, h2))
    packed = [rows.column(c).to_numpy()[place].astype("<i8").tobytes() for c in _ENTRY]
    bits, bitmaps = [len(x) for x in levels], b"".join(np.packbits(x).tobytes() for x in levels)
    values = [rows.column("bucket")[0].as_py(), len(rows), bits, bitmaps, _fingerprint(h1, h2)[place].tobytes(), *packed]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * (2 + len(_ENTRY))]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["bucket", "n_keys", "level_bits", "bitmaps", "fingerprints", *_ENTRY])


def build_index(documents: DataFrame, *, keys_per_bucket: int = KEYS_PER_BUCKET) -> tuple[DataFrame, int]:
    """The index of stored documents, a row for each bucket, and the number of buckets."""
    buckets = max(1, -(-documents.count() // keys_per_bucket))
    keyed = _keyed(documents, buckets).select("bucket", "h1", "h2", *_ENTRY)
    return cut(keyed.groupBy("bucket").applyInArrow(_build_bucket, _INDEX)), buckets


_FOUND = "doc_id long, occurrence long, " + ", ".join(f"{c} long" for c in _ENTRY)


def _probe(keys: pa.Table, index: pa.Table) -> pa.Table:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    if len(index) == 0 or len(keys) == 0:
        return pa.table([pa.array([], pa.int64())] * len(names), names=names)
    one = index.to_pylist()[0]
    bitmap, levels, at = np.unpackbits(np.frombuffer(one["bitmaps"], np.uint8)).astype(bool), [], 0
    for bits in one["level_bits"]:
        levels.append(bitmap[at : at + bits])
        at += bits
    h1, h2 = _hashes(keys)
    slot = slots(levels, h1, h2)
    found = np.flatnonzero((slot >= 0) & (np.frombuffer(one["fingerprints"], "<u4")[slot] == _fingerprint(h1, h2)))
    cols = [keys.column(c).take(pa.array(found)).combine_chunks() for c in ("doc_id", "occurrence")]
    cols += [pa.array(np.frombuffer(one[c], "<i8")[slot[found]]) for c in _ENTRY]
    return pa.table(cols, names=names)


def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """doc_id, occurrence, shard, offset, start and n_tokens of the keys (doc_id, occurrence) that are stored."""
    asked = _keyed(keys.select(F.col("doc_id").cast("long"), F.col("occurrence").cast("long")), buckets)
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_probe, _FOUND)


def _shard_number(batches):
    for batch in batches:
        shard = pa.array([int.from_bytes(f.as_py()[:8], "little") for f in batch.column("footer")], pa.int64())
        yield pa.RecordBatch.from_arrays([shard, batch.column("content")], names=["shard", "content"])


def fetch(spark: SparkSession, path: str, entries: DataFrame, *, width: int, digest: bool = False) -> DataFrame:
    """entries with the ids at their places in the shards, as ids (array of int); with ``digest`` their
    CRC-32 as 32-bit integers, ids_crc32, instead. ``width``: bytes of an id."""

    def read(asked: pa.Table, files: pa.Table) -> pa.Table:
        if len(files) == 0:
            asked = asked.slice(0, 0)
        content = memoryview(files.column("content")[0].as_buffer()) if len(asked) else memoryview(b"")
        places = zip(asked.column("offset").to_pylist(), asked.column("n_tokens").to_pylist(), strict=True)
        values = (np.frombuffer(content[a : a + n * width], f"<u{width}").astype("<u4") for a, n in places)
        if digest:
            out = pa.array([zlib.crc32(v.tobytes()) for v in values], pa.int64())
        else:
            out = pa.array([v.astype(np.int32) for v in values], pa.list_(pa.int32()))
        return asked.append_column("ids_crc32" if digest else "ids", out)

    files = _files(spark, path).select("content", F.substring("footer", 1, 8).alias("footer")).mapInArrow(_shard_number, "shard long, content binary")
    own = entries.select("doc_id", "occurrence", *_ENTRY)
    return own.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(read, f"{_FOUND}, {'ids_crc32 long' if digest else 'ids array<int>'}")


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer, path = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), tokenizer, 2, path)
    free_shuffles(spark)  # that of the texts is done
    documents = cut(stored_documents(spark, path))
    index, buckets = build_index(documents)
    entries = lookup(documents, index, buckets)
    free_shuffles(spark)
    return fetch(spark, path, entries, width=unit_coder(tokenizer).dtype.itemsize, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")
