import hashlib

import duckdb
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import sharding as S


def brute(rows, limit):
    own = []
    for i, t in rows:
        bits = "".join(bin(int(hashlib.md5(x.encode()).hexdigest()[:15], 16))[2:].zfill(60) for x in (str(i) if i is not None else "null", t or ""))
        own.append((i, len((t or "").encode()), bits))
    out = []

    def split(part, depth):
        size = sum(p[1] for p in part)
        if size <= limit or len(part) == 1 or depth == 120:
            out.extend((i, b, bits[:depth], depth, size, size > limit) for i, b, bits in part)
            return
        for bit in "01":
            half = [p for p in part if p[2][depth] == bit]
            if half:
                split(half, depth + 1)

    if own:
        split(own, 0)
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100, 3000, 10**9])
def test_against_brute_force(spark, limit):
    rows = [(k, "é" * (k % 37)) for k in range(400)] + [(5, f"hot {k} " * 9) for k in range(60)] + [(None, "n" * 500), (None, None), (9, "big" * 2000), (11, "same" * 30), (11, "same" * 30), (11, "same" * 30)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    assert sorted(map(tuple, S.shards(docs, limit=limit).collect()), key=str) == brute(rows, limit)


def test_by_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    for limit in (S.SHARD_BYTES, 40_000):
        want = con.sql(S.OP9_SQL.replace(str(S.SHARD_BYTES), str(limit))).fetchall()
        got = S.shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), limit=limit)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty(spark):
    assert S.shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_splits(spark):
    rows = S.shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), limit=64 << 10).collect()
    shards = {r.shard for r in rows}
    assert len(shards) > 20 and len({len(s) for s in shards}) > 1 and not any(r.oversize and sum(x.shard == r.shard for x in rows) > 1 for r in rows)
