"""Columns with the names of helpers, null and repeated ids, in every stage that returns its input's columns."""

import pytest

pytest.importorskip("tessera.llm")
import corpus_pipeline
from tessera.llm import decontaminate, secrets, substring_dedup

EXTRA = ["_id", "_key", "_spans", "_dirty", "_gone", "_text", "text_key", "spans", "component_id", "node", "row"]


def frame(spark, rows):
    names = ", ".join(f"`{n}` string" for n in EXTRA)
    return spark.createDataFrame([(i, t, "en", None if t is None else len(t), *(f"{n} {k}" for n in EXTRA)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, lang string, n_chars long, {names}")


def same(got, docs):
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text, r["_id"], r["row"]) for r in got.collect()), key=str)


def test_stages_keep_other_columns(spark):
    words = lambda k: " ".join(f"{k}{n}" for n in range(70))
    rows = [(1, words("a")), (None, words("b")), (None, words("b") + " z"), (None, "a secret=abcdefgh12 z"), (2, None), (2, ""), (2, words("c")), (None, words("d"))]
    docs = frame(spark, rows)
    own = [(i, t, f"_id {k}", f"row {k}") for k, (i, t) in enumerate(rows)]
    key = lambda x: sorted(x, key=str)
    assert same(corpus_pipeline.drop_near_copies(spark, docs, ""), docs) == key(own[:2] + own[3:])
    bench = spark.createDataFrame([(1, words("d")), (2, words("q"))], "item_id long, text string")
    assert same(decontaminate.clean_only(docs, bench), docs) == key(own[:-1])
    assert same(secrets.redact(docs), docs) == key([(i, "a <assign> z" if t and "secret" in t else t, a, b) for i, t, a, b in own])
    stripped = same(substring_dedup.strip_repeats(docs), docs)
    assert len(stripped) == len(own) and sum(a[1] != b[1] for a, b in zip(key(own), stripped, strict=True)) <= 2


def test_empty_tables(spark):
    docs = frame(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
