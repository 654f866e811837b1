"""Sharding by extendible hashing.

The directory is indexed by the first bits of a hash. It starts with one bucket; only a bucket
above the byte limit splits on one more bit, until every bucket fits. Spark does ``STEP`` bits at a
time: it sums the bytes of each prefix of STEP more bits (the sums are partial before the shuffle), rolls these
cells, not rows, up to all depths between, and reads off at which depth each prefix first fits. Only rows of
cells that are still too large after STEP bits, which takes more than 16 million buckets or many rows of one id,
go into another round. Rows then look up their prefix. Only ids, sizes and hashes are shuffled, never texts.

The hash has 60 bits of the id and 60 bits of the text, so rows of one id, however many, still
split. Rows equal in both can't be told apart: their bucket is left whole and marked oversize, as
is a bucket of one row above the limit.

Defined results: a null text has 0 bytes; a null id hashes as the text 'null'; repeated rows fall
into one shard; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table

SHARD_BYTES = 64 << 10
STEP = 24
_BITS = 60


def _bits(value):
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int):
    """The first depth bits as a text of 0 and 1."""
    return F.substring("bits", 1, depth)


def shards(docs: DataFrame, *, limit: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """One row for each row of docs: doc_id, bytes, shard (its bits), depth, shard_bytes, oversize."""
    text = F.coalesce("text", F.lit(""))
    first = F.lpad(F.bin(_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), _BITS, "0")
    second = F.lpad(F.bin(_bits(text)), _BITS, "0")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), first.alias("bits"), second.alias("more"))
    open_, depth, maps = rows.select("bytes", "bits"), 0, []
    while depth < 2 * _BITS:
        if depth == _BITS:  # the id's bits are used up: the text's follow
            deep = rows.withColumn("bits", F.concat("bits", "more"))
            open_ = deep.withColumn("cell", _prefix(depth)).join(open_cells.select("cell"), "cell", "left_semi").select("bytes", "bits")
        to = min(depth + step, _BITS if depth < _BITS else 2 * _BITS)
        cells = open_.groupBy(_prefix(to).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        depths = F.explode(F.expr(f"sequence({depth if depth == 0 else depth + 1}, {to})"))
        each = cells.select("cell", "bytes", "n", depths.alias("depth"))
        sums = each.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == 2 * _BITS))
        # Above the first depth at which a prefix fits, a few prefixes hold all cells: these don't look there.
        fits = cut(fits)
        first = fits.agg(F.min("depth")).first()[0]
        at = each.where(F.col("depth") >= (to + 1 if first is None else first)).withColumn("prefix", F.expr("substring(cell, 1, depth)")).select("cell", "depth", "prefix")
        leaf = at.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
        found = cut(cells.select("cell").join(leaf, "cell", "left").select("cell", "leaf.depth", "leaf.shard_bytes"))
        maps.append((to, found.where("depth IS NOT NULL")))
        open_cells = found.where("depth IS NULL")
        if open_cells.isEmpty():
            break
        open_ = open_.withColumn("cell", _prefix(to)).join(open_cells.select("cell"), "cell", "left_semi").select("bytes", "bits")
        depth = to
    out = rows if maps[-1][0] <= _BITS else rows.withColumn("bits", F.concat("bits", "more"))
    out = out.drop("more").withColumns({"depth": F.lit(None).cast("int"), "shard_bytes": F.lit(None).cast("long")})
    for to, found in maps:
        of = found.toDF("cell", "d", "b")
        out = out.withColumn("cell", _prefix(to)).join(of, "cell", "left").withColumns({"depth": F.coalesce("depth", "d"), "shard_bytes": F.coalesce("shard_bytes", "b")}).drop("cell", "d", "b")
    return out.select("doc_id", "bytes", F.expr("substring(bits, 1, depth)").alias("shard"), "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH own AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)), {_BITS}, '0') AS bits
  FROM documents),
sums AS (
  SELECT CAST(d.depth AS INTEGER) AS depth, substr(bits, 1, d.depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS n
  FROM own, (SELECT unnest(range(0, {_BITS + 1})) AS depth) d GROUP BY 1, 2),
leaf AS (
  SELECT o.doc_id, o.bytes, o.bits, min(s.depth) AS depth
  FROM own o JOIN sums s ON s.prefix = substr(o.bits, 1, s.depth) AND (s.shard_bytes <= {SHARD_BYTES} OR s.n = 1) GROUP BY ALL)
SELECT l.doc_id, l.bytes, s.prefix AS shard, l.depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes, s.shard_bytes > {SHARD_BYTES} AS oversize
FROM leaf l JOIN sums s ON s.depth = l.depth AND s.prefix = substr(l.bits, 1, l.depth)
"""
