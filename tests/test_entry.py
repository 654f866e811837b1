import importlib
import sys

import __spark_entry__


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_corpus_operators():
    """As if the folder and the pipeline file were gone."""
    gone = {k: sys.modules[k] for k in list(sys.modules) if k == "corpus_pipeline" or k.startswith("tessera.llm")}
    try:
        for k in [*gone, "corpus_pipeline", "tessera.llm.queries"]:
            sys.modules[k] = None
        again = importlib.reload(__spark_entry__)
        assert len(again.queries()) > 90 and not any(k.startswith("op") and k[2].isdigit() for k in again.queries()) and "pipeline" not in again.queries()
    finally:
        for k in ["corpus_pipeline", "tessera.llm.queries"]:
            sys.modules.pop(k, None)
        sys.modules.update(gone)
        importlib.reload(__spark_entry__)
