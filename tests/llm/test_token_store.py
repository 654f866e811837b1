"""op13 against the tokenizers library and a round trip through the files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

pytest.importorskip("tessera.llm")
from tessera.llm import token_store as T
from tessera.llm.shared import scratch

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def library(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = [], 0
    for i, text in docs:
        ids = np.array([*library(text), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, T.op13_tokens(spark, SF).collect())) == want


def encoded(texts):
    return [np.frombuffer(b, "<u2").tolist() for b in T.unit_coder(PATH).encode(pa.array(texts, pa.string()))]


PIECES = ["a", "Z", "é", "İ", "ß", "漢", "0", "12", "'", "'s", "'ll", ".", ",", "!!", "-", "_", "<", "<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "\r\n", "\u0085", " ", " ", "　", " ", "​", "\x1c", "\x00", "́", "👍", "word", "the"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.text(max_size=30)), min_size=1, max_size=5))
def test_cut_texts_have_the_librarys_ids(texts):
    assert encoded(texts) == [library(t) for t in texts]


def test_many_random_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(6000)]
    assert encoded(texts) == [library(t) for t in texts]


def test_units_are_encoded_together(monkeypatch):
    """Different words go to the library as few texts, whatever stands around them, and a full table is emptied."""
    rng = random.Random(6)
    texts = ["".join(rng.choices([*PIECES, " é", " 漢x", " a", "a", ".\nB"], k=rng.randint(0, 25))) + f" w{k}x, y{k}! é{k}." for k in range(3000)]
    want = [library(t) for t in texts]
    coder, calls = T.UnitCoder(PATH), []
    lib = coder.lib

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return lib.encode_batch_fast(texts, **options)

    monkeypatch.setattr(coder, "lib", Counted())
    for size in (T.KEPT_UNITS, 5000):
        monkeypatch.setattr(T, "KEPT_UNITS", size)
        for at in range(0, 3000, 1000):
            assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(pa.array(texts[at : at + 1000]))] == want[at : at + 1000]
    plain = T.UnitCoder(PATH)
    calls.clear()
    lib = plain.lib
    monkeypatch.setattr(plain, "lib", Counted())
    plain.encode(pa.array([" ".join(f"q{chr(97 + k % 26)}z{k}" for k in range(9000))]))
    assert sum(calls) < 10


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 40_000):
        h1, h2 = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        levels = T.perfect_hash(h1, h2)
        assert sorted(T.slots(levels, h1, h2).tolist()) == list(range(n))  # minimal and perfect
        assert sum(map(len, levels)) <= 5 * n + 300
    with pytest.raises(ValueError, match="same hashes"):
        T.perfect_hash(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_hard_rows(spark):
    """Nulls, empty and long texts, one doc_id for a third of all rows over many shards, clashing columns."""
    rows = [(k, f"Text {k}, it's here. " * (k % 9)) for k in range(300)] + [(50, f"hot {k} " * 20) for k in range(200)] + [(None, "no id")] * 3 + [(7, None), (8, ""), (7, "w" * 300_000), (301, "some words " * 30_000), (-5, "first")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, start int")
    path = scratch(spark, "test-tokens")
    T.write_tokens(docs, PATH, 2, path, page=2_000, shard_pages=2, range_bytes=20_000)
    documents = T.stored_documents(spark, path).cache()
    listed = sorted(documents.collect(), key=lambda r: r.start)
    assert len(listed) == len(rows) and len({r.shard for r in listed}) > 20 and len({r.shard for r in listed if r.doc_id == 50}) > 2
    ids = [r.doc_id for r in listed]
    assert ids == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    assert [r.start for r in listed] == np.cumsum([0, *(r.n_tokens for r in listed)])[:-1].tolist()
    keys = [(r.doc_id, r.occurrence) for r in listed]
    assert keys == [(i, ids[:k].count(i)) for k, i in enumerate(ids)]
    index, buckets = T.build_index(documents, keys_per_bucket=100)
    assert buckets == 6 and index.count() == 6
    asked = spark.createDataFrame([*keys, (50, 201), (999, 0), (None, 3)], "doc_id long, occurrence long")
    found = T.lookup(asked, index, buckets)
    read = sorted(T.fetch(spark, path, found, width=2).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.occurrence) for r in read] == keys
    assert sorted((str(r.doc_id), r.ids) for r in read) == sorted((str(i), [*library(t), 2]) for i, t in rows)
    hot = [LIB.decode(r.ids[:-1]) for r in read if r.doc_id == 50]
    assert sorted(hot) == sorted(t for i, t in rows if i == 50)
    some = T.lookup(spark.createDataFrame([(301, 0), (None, 1)], "doc_id long, occurrence int"), index, buckets)
    crcs = {r.doc_id: r.ids_crc32 for r in T.fetch(spark, path, some, width=2, digest=True).collect()}
    assert crcs == {301: zlib.crc32(np.array([*library("some words " * 30_000), 2], "<u4").tobytes()), None: zlib.crc32(np.array([*library("no id"), 2], "<u4").tobytes())}


def test_empty(spark):
    docs, path = spark.createDataFrame([], "doc_id long, text string"), scratch(spark, "test-tokens")
    T.write_tokens(docs, PATH, 2, path)
    documents = T.stored_documents(spark, path)
    index, buckets = T.build_index(documents)
    assert T.fetch(spark, path, T.lookup(documents, index, buckets), width=2).count() == 0
