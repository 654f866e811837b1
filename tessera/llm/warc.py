"""WARC archives as Spark tables: writing records with revisits, and reading them back in chunks.

``write_archives`` writes one record for each page, as gzip-compressed WARC 1.1 files made by
Spark's own file sink. Of records with equal payloads, the one with the smallest page_id carries
the payload (response), the others name it (revisit). A payload of more than ``chunk_bytes``
becomes a response and continuation records (WARC segments), so that no archive row is larger. A
response's block is an HTTP head and the payload; ids are UUIDs made of page, digest and chunk, and a
revisit refers to its response's id. gzip members are as the sink makes them: one a file.

``read_chunks`` reads archives as rows of (record, chunk number, bytes). Its parser streams: it
holds at most one segment, and it counts Content-Length, so that a payload may hold what looks
like a record's start. ``read_records`` orders the chunks of a record and carries its SHA-1 from
chunk to chunk; a whole payload is never put together.

Defined results: a null payload counts as empty; a null page_id stays null, counts as larger than
all others and never makes a revisit's target unless all equal payloads lack one; of repeated rows
with the smallest page_id each is a response, of one record id; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, scratch, table

CHUNK_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_START = "\r\n\r\nWARC/1.1\r\n"
#: What a response's block has before its payload.
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The 32 digits of conv(), and of base32.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base32 of 40 hex digits: 10 hex digits are 8 base32 digits."""
    eighth = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*eighth), _DIGITS, _BASE32)


def urn(*parts: Column) -> Column:
    """A record's id: a UUID made of what names the record."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, path: str, *, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = 0) -> None:
    """Columns read: page_id, url, html (text or binary)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # Digests and ids alone find each payload's first page. Rows with a payload are joined by both, so that
    # copies of one payload, however many, don't meet.
    thin = own.select("page_id", "digest").distinct()
    firsts = thin.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    named = thin.join(firsts, "digest").select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "digest", "first_id")
    rows = own.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).join(named, ["page", "digest"]).select(
        "*",
        ((F.col("n_bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))).alias("whole"),
        F.uuid().alias("row"),
    )
    chunks = F.when(F.col("whole"), F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes))).otherwise(1).cast("int")
    each = rows.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.expr("sequence(1, chunks)")))
    data = F.when(F.col("whole"), F.substring("payload", (F.col("chunk") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    kind = F.when(~F.col("whole"), "revisit").when(F.col("chunk") == 1, "response").otherwise("continuation")
    line = lambda name, value, shown=None: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) if shown is None else F.when(shown, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    split, last = F.col("chunks") > 1, (F.col("chunks") > 1) & (F.col("chunk") == F.col("chunks"))
    response = lambda page: urn(F.lit("response"), page, F.col("digest"))
    own_id = F.when(F.col("kind") == "response", response(F.col("page"))).otherwise(urn(F.col("kind"), F.col("page"), F.col("digest"), F.col("row"), F.col("chunk").cast("string")))
    each = each.withColumns({"data": data, "kind": kind}).withColumn("block", F.concat(F.when(F.col("kind") == "response", F.lit(_HTTP.encode())).otherwise(F.lit(b"")), F.col("data")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", own_id),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"), F.col("url").isNotNull()),
        line("Content-Type", F.lit("application/http; msgtype=response"), F.col("kind") == "response"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ~F.col("whole")),
        line("WARC-Refers-To", response(F.coalesce(F.col("first_id").cast("string"), F.lit(""))), ~F.col("whole")),
        line("WARC-Segment-Number", F.col("chunk").cast("string"), split),
        line("WARC-Segment-Origin-ID", response(F.col("page")), F.col("chunk") > 1),
        line("WARC-Segment-Total-Length", (F.col("n_bytes") + len(_HTTP)).cast("string"), last),
        line("X-Page", F.concat(F.lit("<urn:page:"), F.col("page"), F.lit(">"))),
        line("X-Row", F.col("row")),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("block"), F.lit(b"\r\n")).cast("string")  # the sink adds the last line end
    each.select(record.alias("value")).write.mode("errorifexists").option("lineSep", "\r\n").option("compression", "gzip").text(path)


_CHUNK = "row string, page_id long, url string, record_type string, chunk int, n_bytes long, payload_bytes long, header_digest string, record_id string, refers_to string, sha1 binary, data binary"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary())


def _number(urn: str | None) -> int | None:
    tail = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail else None


class _Parser:
    """Takes a file's stretches between record starts, in order; gives a row for each record."""

    def __init__(self):
        self.held: list[bytes] = []
        self.fields: dict[str, str] = {}
        self.missing = 0
        self.between = b""

    def take(self, stretch: bytes):
        if self.missing > 0:  # the last stretch ended inside a payload
            self.held += [self.between, stretch]
            self.missing -= len(self.between) + len(stretch)
            self.between = _START.encode()
        else:
            head, blank, body = stretch.removeprefix(b"WARC/1.1\r\n").partition(b"\r\n\r\n")
            # A payload that starts like a record: its head's blank line was taken for the record's end.
            self.between = _START.encode() if blank else _START.lstrip().encode()
            self.fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n") if ": " in x)
            self.held, self.missing = [body], int(self.fields["Content-Length"]) - len(body)
        if self.missing <= 0:
            return self.row()
        return None

    def row(self):
        f, n = self.fields, int(self.fields["Content-Length"])
        data = b"".join(self.held)[:n]
        if f["WARC-Type"] == "response":
            data = data[data.index(b"\r\n\r\n") + 4 :]  # the payload begins behind the HTTP head
        split = "WARC-Segment-Number" in f
        return (
            f["X-Row"], _number(f["X-Page"]), f.get("WARC-Target-URI"), f["WARC-Type"], int(f.get("WARC-Segment-Number", 1)), len(data),
            int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Record-ID"], f.get("WARC-Refers-To"),
            None if split else hashlib.sha1(data).digest(), data,
        )


def _parse(keep_single: bool):
    def run(batches):
        parser, path, rows, held = _Parser(), None, [], 0
        for batch in batches:
            for file, stretch in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
                if file != path:
                    parser, path = _Parser(), file
                row = parser.take(stretch.as_py())
                if row is not None:
                    rows.append(row if keep_single or row[10] is None else (*row[:11], None))
                    held += len(rows[-1][11] or b"")
                if held > 1 << 23 or len(rows) >= 10_000:
                    yield _batch(rows, _CHUNK, _KINDS)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _CHUNK, _KINDS)

    return run


def _batch(rows, schema: str, kinds) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_chunks(spark: SparkSession, path: str, *, single_data: bool = True) -> DataFrame:
    """A row for each record and chunk. Without ``single_data``, a record of one chunk carries the
    SHA-1 of its bytes instead of them."""
    lines = spark.read.option("lineSep", _START).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_parse(single_data), _CHUNK)


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to string, intact boolean"
_RECORD_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())


def _digests(batches):
    """Chunks by record and number: carries one SHA-1 state and one count from row to row."""
    now, sha, total, out = None, None, 0, []

    def done():
        _, page, url, kind, size, digest, own_id, refers = now
        found = base64.b32encode(sha).decode() if isinstance(sha, bytes) else base64.b32encode(sha.digest()).decode()
        revisit = kind == "revisit"
        return page, url, size if revisit else total, digest if revisit else found, kind, own_id, refers, revisit or (found == digest and total == size)

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in ("row", "page_id", "url", "record_type", "n_bytes", "payload_bytes", "header_digest", "record_id", "refers_to", "sha1")]
        for (row, page, url, kind, n, size, digest, own_id, refers, single), data in zip(zip(*cols, strict=True), batch.column("data"), strict=True):
            if now is None or row != now[0]:
                if now is not None:
                    out.append(done())
                now, total = (row, page, url, kind, size, digest, own_id, refers), n
                sha = single if single is not None else hashlib.sha1(data.as_py())
            else:
                total += n
                sha.update(data.as_py())
        if len(out) > 10_000:
            yield _batch(out, _RECORD, _RECORD_KINDS)
            out = []
    if now is not None:
        out.append(done())
    if out:
        yield _batch(out, _RECORD, _RECORD_KINDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page: what the archives say, with the digest and length of the bytes read, and
    the page of the record that a revisit refers to. ``intact``: digest and length are as the header says."""
    chunks = read_chunks(spark, path, single_data=False)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = cut(chunks.repartition(n, "row").sortWithinPartitions("row", "chunk").mapInArrow(_digests, _RECORD))
    pages = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id")).distinct()
    named = records.join(pages, "refers_to", "left")
    return named.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "record_id", F.col("first_id").alias("refers_to"), "intact")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP3_SQL = f"""
WITH own AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS h FROM own),
coded AS (
  SELECT page_id, payload_bytes, h, translate(
    {" || ".join(f"lpad(to_base(CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT), 32), 8, '0')" for k in range(4))},
    '{_DIGITS}', '{_BASE32}') AS payload_digest
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to,
  true AS intact
FROM coded
"""
