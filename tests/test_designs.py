"""Tiers hold floors and caps together; numbers stand for each combination once."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import designs as D
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_allocation_carries_over():
    full = dict.fromkeys(("appendix", "floor", "cold", "plain", "fuzzy", "pair"), 1000)
    a = D.tier_allocation(full | {"floor": 6}, 100)
    assert a == {"appendix": 16, "floor": 6, "cold": 18, "plain": 0, "fuzzy": 30, "pair": 30} and sum(a.values()) == 100
    a = D.tier_allocation({"floor": 2, "plain": 5, "fuzzy": 1000}, 100)
    assert a == {"appendix": 0, "floor": 2, "cold": 0, "plain": 5, "fuzzy": 63, "pair": 0}
    assert D.tier_allocation({"floor": 90, "plain": 10}, 100)["floor"] == 90
    assert sum(D.tier_allocation({"plain": 500}, 100).values()) == 100 and sum(D.tier_allocation({}, 100).values()) == 0


def test_floors_and_caps_of_the_documents(spark):
    got = QUERIES["tier_quota"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "n_chars").collect()}
    total = len(docs) // 4
    assert len(got) == len({r.doc_id for r in got}) and len(got) <= total + sum(r.tier == "floor" for r in got)
    assert sum(r.tier == "appendix" for r in got) <= int(0.4 * int(0.4 * total))
    short = {}
    for d in docs.values():
        short.setdefault(d.source, []).append(d.n_chars <= 1500)
    mean = sum(map(sum, short.values())) / len(short)
    cold = {s for s, flags in short.items() if sum(flags) < 0.9 * mean}
    assert cold
    for s in cold:
        assert sum(r.source == s and r.tier == "floor" for r in got) == min(2, sum(short[s]))


@pytest.mark.parametrize(("n", "size"), [(0, 2), (1, 2), (2, 2), (40, 2), (2, 3), (3, 3), (41, 3)])
def test_every_combination_once(spark, n, size):
    values = spark.range(n).select((F.col("id") * 3).alias("v")).union(spark.range(n).select((F.col("id") * 3).alias("v"))).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    got = sorted(map(tuple, D.combinations_of(values, "v", size).collect()))
    assert got == sorted(combinations([3 * k for k in range(n)], size))


def test_numbers_far_out(spark):
    big = [10**15, 10**15 - 1, 166167000, 166167001, 166166999, 0, 1, 2, 3, 4]
    rows = spark.createDataFrame([(b,) for b in big], "n long")
    a, b, c = D.triple_of(F.col("n"))
    for n, x, y, z in rows.select("n", a, b, c).collect():
        assert 0 <= x < y < z and z * (z - 1) * (z - 2) // 6 + y * (y - 1) // 2 + x == n
    a, b = D.pair_of(F.col("n"))
    assert all(0 <= x < y and y * (y - 1) // 2 + x == n for n, x, y in rows.select("n", a, b).collect())


def test_pairs_are_made_where_their_values_meet(spark, tmp_path):
    """Without broadcasts, values are shuffled and pairs are not; files of pairs take a fraction of a byte for each."""
    values = spark.range(2000).select((F.col("id") * 3).alias("v"))
    at, was = str(tmp_path / "pairs"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        D.combinations_of(values, "v", 2).write.parquet(at)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    rows = spark.read.parquet(at)
    assert rows.count() == rows.distinct().count() == 2000 * 1999 // 2 and rows.where("first >= second OR first % 3 > 0 OR second % 3 > 0").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < rows.count() // 2
