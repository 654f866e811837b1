import pytest

pytest.importorskip("tessera.llm")
import corpus_pipeline
from .test_bpe import expected
from .test_near_dedup import brute as near_brute
from .test_secrets import ASSIGN

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    english = next(r for r in rows if r.lang == "en")
    extra = spark.createDataFrame([(10**6, "123 456", "en", "x", 7), (10**6 + 1, None, None, "x", 0), (10**6 + 2, english.text + " one", "en", "x", 1)], docs.schema)
    docs = docs.unionByName(extra)
    out, got = [docs], {}
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
        got[name] = out[-1].collect()
        if name != "bpe":
            assert sorted(out[-1].columns) == sorted(columns)
    known = {r.doc_id for r in got["language_id"]}
    assert known == {r.doc_id for r in rows if r.lang in corpus_pipeline.WANTED} | {10**6 + 2}
    lettered = {r.doc_id for r in rows if any(c.isalpha() for c in r.text)}
    assert known < lettered | {10**6 + 2} and len(known) < 0.8 * len(lettered)  # it isn't a filter of letters
    kept = {i for i, _, c, k in near_brute([(r.doc_id, r.text) for r in got["language_id"]]) if k}
    assert {r.doc_id for r in got["near_dedup"]} == kept and len(kept) < len(known)
    passages = [b.text for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in got["near_dedup"] if not any(p in r.text for p in passages)}
    assert {r.doc_id for r in got["decontamination"]} <= clean and len(clean) - len(got["decontamination"]) <= 3
    assert {r.doc_id for r in got["secret_scan"]} == {r.doc_id for r in got["decontamination"]}
    assert not any(len(m[2]) >= 8 for r in got["secret_scan"] for m in ASSIGN.finditer(r.text))
    assert all(r.n_chars == len(r.text) for r in got["secret_scan"] if "<" in r.text)
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got["bpe"]} == {(r.doc_id, *expected(r.text)) for r in got["secret_scan"]}


def test_run_gives_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert [len(STAGE) for STAGE in corpus_pipeline.STAGES] == [2] * 5
