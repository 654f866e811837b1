"""Every query with SQL gives the same rows in both engines; the others are compared with plain Python."""

import re

import pytest
from compare import difference

from tessera.operators import chunking, sampling, spans
from tessera.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert difference(name, QUERIES, ORACLE_SQL, spark, SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_recursive_spans():
    assert chunking.recursive_spans("") == [] and chunking.recursive_spans("short") == [(0, 5)]
    plain = chunking.recursive_spans("x" * 2500)
    assert plain == [(0, 700), (600, 1400), (1300, 2100), (2000, 2500)]
    text = "One two three. " * 300
    got = chunking.recursive_spans(text)
    assert all(0 < e - s <= 700 for s, e in got) and got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(got, got[1:], strict=False))


def test_units_keep_numbers(spark):
    docs = spark.createDataFrame([("a", "x" * 1200, "s"), ("b", "y " * 700, "s"), ("c", None, "s"), ("d", "z" * 690 + "\n\n" + " " * 800 + "\n\nend", "s")], "clause_id string, text string, source string")
    got = {r.uid: (r.start, r.end) for r in chunking.units(docs).collect()}
    assert got["a#0"] == (0, 1200) and "b#1" in got and not any(u.startswith("c#") for u in got)


def test_window_around(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(100, 200, 800), (1000, 1100, 5000), (4900, 5000, 5000)], "s int, e int, n int")
    a, b = chunking.window_around(F.col("s"), F.col("e"), F.col("n"), 1500)
    assert [tuple(r) for r in rows.select(a, b).collect()] == [(0, 800), (300, 1800), (3500, 5000)]


def test_tag_longest_term_wins(spark):
    docs = spark.createDataFrame([(1, "then the 12.5 end"), (2, None)], "doc_id long, text string")
    got = {(r.type, r.start, r.end, r.term) for r in spans.tag(docs, [("the", "A", 1), ("then", "B", 2)], [("N", r"[0-9]+(?:\.[0-9]+)?")]).collect()}
    assert got == {("N", 9, 13, "12.5"), ("B", 0, 4, "then"), ("A", 5, 8, "the")}


def _spans(spark, rows):
    return spark.createDataFrame(rows, "g long, type string, id int, s int, e int, who string, p long")


def test_vote_sanitize_and_relaxed(spark):
    s = _spans(spark, [(1, "R", 1, 0, 5, "gold", 1), (1, "R", 2, 3, 9, "model", 1), (1, "R", 3, 8, 12, "model", 1), (1, "A", 4, 0, 5, "gold", 1), (2, "R", 5, -3, 80, "gold", 1)])
    assert {tuple(r) for r in spans.vote(s, "g").collect()} == {(1, "R", 3, 9, 2), (1, "R", 8, 12, 1), (1, "A", 0, 5, 1), (2, "R", -3, 80, 1)}
    assert {tuple(r) for r in spans.relaxed_counts(s, "g").collect()} == {(1, 1, 1, 1), (2, 0, 0, 1)}
    assert {(r.g, r.s, r.e) for r in spans.sanitize(s, "g", 60).collect()} == {(1, 0, 5), (1, 8, 12), (2, 0, 60)}


def test_loop_guard_and_bucket(spark):
    from datetime import datetime, timedelta

    from tessera.streaming import guards

    at = datetime(2024, 1, 1)
    kinds = ["a", "a", "a", "b", "a", "a", "a", "a", "a", "a"]
    e = spark.createDataFrame([(1, at + timedelta(minutes=k), k, x) for k, x in enumerate(kinds)], "user_id long, ts timestamp, event_id long, event_type string")
    got = {r.event_id: r.state for r in guards.loop_guard(e).collect()}
    assert [got[k] for k in range(10)] == ["admitted"] * 2 + ["blocked"] + ["admitted"] * 3 + ["blocked"] + ["admitted"] * 2 + ["degraded"]
    taken = {r.event_id: r.admitted for r in guards.token_bucket(e, rate=1 / 120, capacity=2).collect()}
    assert [taken[k] for k in range(6)] == [True, True, True, False, True, False]


def test_stream_counts(spark, tmp_path):
    from tessera.streaming.guards import stream_counts

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    q = stream_counts(spark, str(tmp_path / "in"), events.schema).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


def test_chinese_numbers_and_ngrams(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    rows = spark.createDataFrame([("二十一",), ("十",), ("三百零五",), ("x",)], "t string")
    assert [r[0] for r in rows.select(T.chinese_number(F.col("t"))).collect()] == [21, 10, 305, None]
    grams = spark.createDataFrame([("混凝土a的",)], "t string").select(T.char_ngrams(F.col("t"), "的")).first()[0]
    assert grams == ["混", "凝", "土", "混凝", "凝土"]


def test_percentiles_and_bootstrap(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in [5, 1, 1, 9, 7]], "g string, v double")
    from pyspark.sql import functions as F

    got = sampling.percentile_places(rows, "g", "v", {"p": lambda n: F.least(n - 1, F.floor(n * 50 / 100)), "last": lambda n: n - 1}).first()
    assert (got.p, got["last"]) == (5.0, 9.0)
    ci = QUERIES["bootstrap_f1"](spark, SF).first()
    assert 0 < ci.lo <= ci.f1 <= ci.hi < 1


def test_sql_names_no_file():
    assert not any(re.search(r"read_parquet|/root", q) for q in ORACLE_SQL.values())
