import base64
import gzip
import hashlib
import uuid

import duckdb
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import warc
from tessera.llm.shared import scratch


def expected(rows, least=0):
    first = {}
    for i, h in rows:
        k = (h or "").encode()
        if i is not None:
            first[k] = min(first.get(k, i), i)
    out = []
    for i, h in rows:
        k = (h or "").encode()
        whole = len(k) < least or i == first.get(k)
        out.append((i, len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "response" if whole else "revisit", None if whole else first[k], True))
    return sorted(out, key=str)


HARD = [
    (3, "x"), (1, "x"), (2, None), (7, ""), (None, "x"), (9, "é" * 1000), (10, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"), (11, "tail\r\n\r\nWARC/1.1\r\n"),
    (12, "ends\r\n"), (13, "\r\n"), (14, "\r\n\r\n" * 50), (15, "0123456789" * 5000), (16, "0123456789" * 5000), (17, "WARC/1.1\r\n"), (1, "x"),
]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_round_trip(spark, chunk):
    rows = HARD if chunk > 7 else [r for r in HARD if len(r[1] or "") < 3000]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n" if i != 7 else None, h, "x") for i, h in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path, chunk_bytes=chunk)
    got = warc.read_records(spark, path)
    assert sorted(map(tuple, got.drop("url").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=str) == expected(rows)
    chunks = warc.read_chunks(spark, path)
    assert chunks.agg({"n_bytes": "max"}).first()[0] <= chunk
    data = {}
    for c in sorted(chunks.where("record_type <> 'revisit'").collect(), key=lambda c: c.chunk):
        data[c.row] = data.get(c.row, b"") + bytes(c.data)
    assert {hashlib.sha1(d).digest() for d in data.values()} == {hashlib.sha1((h or "").encode()).digest() for _, h in rows}


def test_records_are_standard(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in HARD if i != 1], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path, chunk_bytes=20_000)
    kinds, ids, refers = {}, [], []
    for f in spark.read.format("binaryFile").load(f"{path}/*.gz").collect():
        raw = gzip.decompress(bytes(f.content))
        at = 0
        while at < len(raw):  # as any reader does: headers, then as many bytes as they say
            head, _, _ = raw[at:].partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block = raw[at + len(head) + 4 :][: int(fields["Content-Length"])]
            at += len(head) + 4 + len(block) + 4
            assert head.startswith(b"WARC/1.1\r\n") and raw[at - 4 : at] == b"\r\n\r\n"
            ids.append(uuid.UUID(fields["WARC-Record-ID"][10:-1]))
            kinds[fields["WARC-Record-ID"]] = fields["WARC-Type"]
            refers += [fields["WARC-Refers-To"]] if fields["WARC-Type"] == "revisit" else []
            if fields["WARC-Type"] == "response":
                assert fields["Content-Type"] == "application/http; msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert len(set(ids)) == len(ids) == len(HARD) - 2 + 2 and refers and {kinds[r] for r in refers} == {"response"}


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path, least_bytes=3)
    assert {(r.page_id, r.record_type) for r in warc.read_records(spark, path).collect()} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_whole_table_by_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    want = sorted(con.sql(warc.OP3_SQL).fetchall())
    got = warc.op3_warc(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0
