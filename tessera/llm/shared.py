"""Helpers that several corpus operators use: the shared folder, row keys and bounded bitmaps."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap that bitmap_construct_agg makes (4,096 bytes).
BITS_PER_BITMAP = 32_768


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The session's spark.checkpoint.dir wins; a local
    folder is set only where a local session has none, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A new path inside the shared folder, which goes when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a table to the shared folder, so that later steps neither compute
    them again nor depend on the executors that made them."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() made and that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            fs, place = _file_system(df.sparkSession, path)
            fs.delete(place, True)


def drop_with_shuffles(*tables: DataFrame) -> None:
    """drop(), and the files of finished shuffles: Spark deletes a shuffle's files when the driver's
    garbage holds the last reference to it, so the garbage is collected. Where large shuffles follow
    each other, those that are done then don't fill the disks."""
    drop(*tables)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more. References of this side go
    by a thread of its own, so that one more collection follows a moment later."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap_bits(n: int) -> int:
    """Bits for n hashes: eight for each, at least 4 MB and at most 128 MB in all."""
    return 1 << min(30, max(25, (8 * n - 1).bit_length()))


class Bitmap:
    """A set of 64-bit hashes as a Bloom bitmap of bounded size: two bits for each hash. It may say
    yes wrongly, never no wrongly, so that it thins rows before an exact join. Spark builds it as
    partial bitmaps of 4 KB; at most ``bits / 8`` bytes ever reach the driver or a task, whatever
    the number of hashes (4 MB by default)."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.uint64, copy=False)
        m = np.uint64(self.bits - 1)
        a, b = h & m, (h >> np.uint64(32)) & m
        hit = (self.words[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        hit &= (self.words[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return hit.astype(bool)


def build_bitmap(hashes: DataFrame, column: str, bits: int = 1 << 25) -> Bitmap:
    """``hashes``: one row for each hash (long). ``bits``: a power of two, at most 2**32."""
    h = F.col(column)
    bit = F.explode(
        F.array(
            h.bitwiseAND(F.lit(bits - 1)),
            F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)),
        )
    )
    parts = (
        hashes.where(h.isNotNull())
        .select(bit.alias("bit"))
        .groupBy((F.col("bit") / BITS_PER_BITMAP).cast("long").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("bit") % BITS_PER_BITMAP).cast("long")).alias("bitmap"))
        .collect()  # at most bits / 32,768 rows of 4 KB
    )
    words = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts:
        at = row["part"] * (BITS_PER_BITMAP // 8)
        words[at : at + BITS_PER_BITMAP // 8] = np.frombuffer(bytes(row["bitmap"]), dtype=np.uint8)
    return Bitmap(words, bits)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows. What numpy and Arrow have freed goes back to the system
    after each whole batch: Python workers live on, and share an executor's memory."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        free_memory()


def free_memory() -> None:
    """Gives back to the system what numpy and Arrow have freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_sizes(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose texts (or bytes) in a column have about ``size`` bytes together; a larger
    one stands alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
            yield from in_parts([batch.slice(at, end - at)], end - at)
            at = end
