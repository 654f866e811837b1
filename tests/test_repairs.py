"""Row-by-row zips that must fail, escaped lines, and pairs counted without making them."""

import pytest
from compare import difference
from pyspark.sql import functions as F

from tessera.operators import clauses as C
from tessera.operators import sampling as S
from tessera.plans.registry import ORACLE_SQL, QUERIES
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def test_zip_of_a_permuted_copy_fails(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id")
    own = S.numbered(labels, "doc_id")
    assert S.zipped(own, own, "i", "doc_id").count() == labels.count()
    other = own.withColumn("doc_id", F.when(F.col("i") == 3, -1).otherwise(F.col("doc_id")))
    for wrong in (other, own.where("i <> 5"), S.numbered(labels.withColumn("doc_id", -F.col("doc_id")), "doc_id")):
        with pytest.raises(Exception, match="the tables differ"):
            S.zipped(own, wrong, "i", "doc_id").collect()


def test_lines_with_carriage_returns(spark, tmp_path):
    texts = ["a\rb", "\\r", "\\\r\\\\", "", "plain", "\\", "x\\ry\r"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows.select(F.concat_ws("\t", F.col("k").cast("string"), files.escaped_line(F.col("t"))).alias("v")).write.text(str(tmp_path / "x"))
    back = files.read_lines(spark, str(tmp_path / "x")).select(F.split("line", "\t", 2).alias("x"))
    got = {int(r[0]): r[1] for r in back.select(F.get("x", F.lit(0)), files.plain_line(F.get("x", F.lit(1)))).collect()}
    assert got == dict(enumerate(texts))


def test_judged_pairs_make_no_pairs(spark):
    plan = QUERIES["judged_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_appendix_rules():
    doc = lambda *lines: C.Document(list(lines), C.Heads())
    own = ("表A 数据",)
    assert doc("附录A 试验方法", *own).appendix(0) == ("A", "试验方法") and doc("附录B", "试验", *own).appendix(0) == ("B", "试验")
    assert doc("附录A 的规定", *own).appendix(0) is None  # a reference
    assert doc("附录A 试验……9", *own).appendix(0) is None and doc("附录A", "总则……3", *own).appendix(0) is None  # the contents
    assert doc("附录A", "附录B", *own).appendix(0) is None  # a list
    assert doc("附录A", "no table").appendix(0) is None and doc("附录A", "A.0.1 x").appendix(0) is not None
    assert set(C.APPENDIX_RULES) == {"is no reference", "isn't in the contents", "isn't in a list of appendices", "has tables or numbers of its own"}


def test_rising_runs():
    assert C.rising_runs([]) == [] and C.rising_runs([(1,), (2,), (2,), (1,), (5,)]) == [(0, 2), (2, 3), (3, 5)]


def test_passages_held_make_no_rows_per_copy(spark):
    from tessera.operators import retrieval as R

    plan = QUERIES["leak_substring"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "Join Inner" not in plan
    texts = spark.createDataFrame([("a b c",), (None,), ("ab",)] * 3, "text string")
    for words, want in ((["a b", "ab", "ab", "bc", "abc", "", None], {"a b", "ab", ""}), ([None], set()), ([""], {""}), (["zz"], set())):
        got = [r[0] for r in R.held(texts, spark.createDataFrame([(w,) for w in words], "text string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert R.held(texts.where("text IS NULL"), spark.createDataFrame([("",)], "text string")).count() == 0


def test_first_words_end_at_letters_of_any_script(spark, tmp_path):
    texts = {"In\u00f6zust": 0, "In der": -6, "The": -6, "In\n": -6, "In1": 0, "In_a": 0, "In\u0301": 0, "The\u00e4ter": 0, "In\u4e2d": 0, "Then": 0, "In-": -6, " In": 0, "": 0}
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    assert [r.score for r in QUERIES["info_score"](spark, str(tmp_path)).orderBy("doc_id").collect()] == list(texts.values())
    assert difference("info_score", QUERIES, ORACLE_SQL, spark, str(tmp_path)) == ""


def test_batches_in_parts():
    import pyarrow as pa

    from tessera.functions.batches import in_parts

    texts = ["x" * (k % 7) * 100 for k in range(500)] + ["y" * 5_000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(503)), pa.array(texts), pa.array([[[t or ""], []] for t in texts])], names=["k", "text", "units"])
    for most, rows in ((2_000, 10_000), (1 << 20, 7), (1, 1)):
        parts = list(in_parts([batch, batch.slice(0, 0)], most, rows))
        assert all(len(p) <= max(1, rows) and (p.nbytes <= most or len(p) <= 1) for p in parts)
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_counts_of_words_in_parts_of_batches(monkeypatch):
    import pyarrow as pa

    from tessera.functions import batches
    from tessera.operators import retrieval as R

    class Words:
        value = type("Asked", (), {"words": ["a", "b"]})

    units = pa.array([[["a", "b", "a"], ["c"]], [], [["b"]], [["a"], [], ["b", "b"]]] * 40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(160)), units], names=["key", "units"])
    whole = pa.Table.from_batches(R._count_words(Words)([batch])).to_pylist()
    monkeypatch.setattr(R, "in_parts", lambda x: batches.in_parts(x, 200))
    parts = list(R._count_words(Words)([batch]))
    assert len(parts) > 20 and pa.Table.from_batches(parts).to_pylist() == whole
    assert whole[3] == {"key": 3, "dl": [1, 1, 2], "unit": [0, 2], "word": [0, 1], "tf": [1, 2]}


def test_best_rows_are_thinned_early():
    from tessera.operators import retrieval as R

    assert R._Best(10, 5).most <= 1 << 16 and R._Best(1 << 20, 5).most == 5 << 20


def test_decoded_tags_need_no_python(spark):
    plan = QUERIES["bioe_decode"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
