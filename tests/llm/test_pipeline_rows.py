import pytest

pytest.importorskip("tessera.llm")
import corpus_pipeline
from tessera.llm import decontaminate as D


def test_rows_of_one_id_are_dropped_alone(spark):
    text = lambda k: " ".join(f"{k}{n}" for n in range(60))
    rows = [(1, text("a")), (None, text("a") + " more"), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("d")), (7, text("e")), (5, text("e") + " more"), (7, text("f")), (None, text("g")), (None, text("g")), (3, " "), (3, " "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (5, text("e") + " more"), (7, text("f")), (None, text("g")), (3, " "), (3, " "), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_clean_rows_of_a_contaminated_id_stay(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (1, "other"), (None, "a b c d e f g h"), (None, "z"), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    want = [(1, "other"), (None, "z"), (None, None)]
    assert sorted(map(tuple, D.clean_only(docs, b).collect()), key=str) == sorted(want, key=str)
