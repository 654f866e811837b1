import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import language as L


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = L.op4_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) / len(out) > 0.96
    assert all(0 <= r.score <= 1 for r in got)


def test_hard_rows(spark):
    lines = {"en": "the cat sat on the mat and then it was the end of it", "de": "der hund und die katze sind nicht in einem haus", "fr": "le chat est dans la maison avec une autre", "es": "el perro que los niños tienen en su casa"}
    train = spark.createDataFrame([(f"{t} {i}", k) for k, t in lines.items() for i in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = L.train(train, per_language=5)
    rows = [(i, t, "zz") for i, t in enumerate([*lines.values(), None, "", "123 !!", "a\0b the cat sat on the mat", "the mat and " * 60_000])] + [(None, lines["de"], None), (0, lines["en"], "q")]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in range(9)] == ["en", "de", "fr", "es", "und", "und", "und", "en", "en"] and by[None] == "de"
    assert len(got) == len(rows) and L.known_only(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).count() == 8
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and set(model.lines) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(none)
    assert L.identify(none, model).count() == 0
    one = L.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), model).first()
    assert (one.lang_pred, one.score) == ("und", 0.0)


def test_one_language(spark):
    docs = spark.createDataFrame([("word one", "xx"), ("word two", "xx")], "text string, lang string")
    assert L.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), L.train(docs)).first().lang_pred == "xx"


def test_copies_and_long_texts_in_the_sample(spark):
    copied = [(t, "xx") for t in ("kala puu maja", "kivi meri tuul", "lumi jaa talv") for _ in range(1_000)]
    docs = spark.createDataFrame([*copied, *((f"zq zqw wqz {i} {chr(97 + i % 26)}", "yy") for i in range(500)), ("abc " * 5_000 + "ggh " * 5_000, "ww"), ("abc " * 5_000 + "ppo " * 5_000, "vv")], "text string, lang string")
    rows = L.sample(docs, 5).collect()
    assert sorted(r.lang for r in rows) == ["vv", "ww", *["xx"] * 3, *["yy"] * 5] and len({(r.lang, r.text) for r in rows}) == 10
    ranked = docs.where("lang = 'yy'").selectExpr("xxhash64(text) AS h").distinct().orderBy("h").limit(5).collect()
    assert {r.row_hash for r in rows if r.lang == "yy"} == {r.h for r in ranked}
    got = L.identify(spark.createDataFrame([(1, "puu meri maja"), (2, "zqw wqz"), (3, "ggh ggh"), (4, "ppo ppo")], "doc_id long, text string"), L.train(docs, per_language=5))
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "xx", 2: "yy", 3: "ww", 4: "vv"}


def test_texts_in_no_learned_language_go(spark):
    """More than a filter for letters: other scripts and random letters have letters too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs)
    rows = [(10**6 + k, t) for k, t in enumerate(["Это русский текст, которого модель не видела", "日本語のテキストです。これは学習されていない", "Καλημέρα κόσμε, τι κάνεις σήμερα", "qzxw vkjq wxzq pqkz zzkx"])]
    mixed = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id for r in L.known_only(mixed, model).collect()}
    assert not kept & {i for i, _ in rows}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
    assert L.known_only(mixed, model, least_fit=0.0).count() == len(kept) + len(rows)
    assert L.known_only(mixed, L.train(docs.limit(0))).count() == 0


def test_training_holds_counts_above_zero_only(spark):
    """2,000 texts as dense half floats would be 16 MB, and were held twice."""
    docs = spark.range(2_000).selectExpr("concat('word ', id, if(id % 2 = 0, ' und', ' and')) AS text", "if(id % 2 = 0, 'de', 'en') AS lang").cache()
    texts = [r.text for r in docs.limit(50).collect()]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50, "row_hash": list(range(50, 0, -1)), "text": texts})
    held = L.Counts(r for b in L._count_rows([batch]) for r in b.to_pylist())
    dense = L.counts(texts).astype(np.float16).astype(np.float32)[::-1]
    assert held.shape == (50, L.DIMENSIONS) and np.array_equal(held[np.arange(50)], dense) and np.array_equal(held[7], dense[7])
    tracemalloc.start()
    try:
        model = L.train(docs)
        assert tracemalloc.get_traced_memory()[1] < 14_000_000
    finally:
        tracemalloc.stop()
    assert model.languages == ["de", "en"]
