"""Ties, short passages and plans of retrieval and graph operators."""

import re

from pyspark.sql import functions as F

from tessera.operators import graph, retrieval

SF = "/root/testdata/sf0.001"


def test_equal_vectors_are_ranked_by_id(spark):
    rows = [(k, [1.0, 0.0]) for k in range(60)] + [(99, [0.9999999, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    for block in (7, 4096):
        got = retrieval.blocked_top_k(v, v.where("id = 0 or id = 30"), 5, block=block).collect()
        assert sorted((r.q, r.rank, r.id) for r in got) == [(0, k, k) for k in range(1, 6)] + [(30, k + 1, k) for k in range(5)]


def test_passages_of_any_length_are_found(spark):
    texts = [(1, "one two three four five six"), (2, "xone twox"), (3, None), (4, ""), (5, "two three four fiveish")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    passages = [(10, "two"), (11, "one two"), (12, "two three four"), (13, "two three four five"), (14, "one two three four five"), (15, None), (16, "absent"), (17, "two"), (18, "")]
    got = retrieval.holders(docs, spark.createDataFrame(passages, "item_id long, text string"), "doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, d) for i, p in passages for d, t in texts if p is not None and t is not None and p in t)


def test_ranked_in_groups_equals_ranked_at_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.select("doc_id", F.array(retrieval.tokens(F.col("text"))).alias("units"))
    asked = retrieval.tokenised(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id")
    once = sorted(map(tuple, retrieval.ranked(texts, asked, "doc_id", "item_id", 3).collect()))
    monkeypatch.setattr(retrieval, "ASKED_PAIRS", 5_000)
    assert once and sorted(map(tuple, retrieval.ranked(texts, asked, "doc_id", "item_id", 3).collect())) == once
    assert retrieval.ranked(texts, asked.where("item_id < 0"), "doc_id", "item_id", 3).count() == 0


def test_hops_read_few_tables(spark):
    edges = spark.createDataFrame([(f"{k}", f"{k + 1}", "T") for k in range(6)], "src string, dst string, type string")
    seeds = spark.createDataFrame([("2",)], "id string")
    out = graph.k_hop(edges, seeds, 3)
    assert {(r.id, r.hop) for r in out.collect()} == {("2", 0), ("1", 1), ("3", 1), ("0", 2), ("4", 2), ("5", 3)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 4 and "NestedLoop" not in plan
    assert graph.k_hop(edges, seeds, 1, filters={"type": ["X"]}).count() == 1
