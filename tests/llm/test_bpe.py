import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm")
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def expected(text):
    lib = library()
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def texts():
    r = random.Random(5)
    return [
        None, "", " \n\t ", "Hello, it's A test!! don't", "a b c", "x<|endoftext|>y <|startoftext|>", "İstanbul ΑΣ é ́x",
        "a" * 3000, "".join(r.choice("abcdefghinteros") for _ in range(2500)), "".join(r.choice("ab1é!世") for _ in range(1500)) + " end",
        "Word, WORD... wörd; É! it's, <|ENDOFTEXT|>, x&&& ÀB%%% don't. I'LL" * 40, "a, b. " * 700 + "\tç\n\n" * 300,
        "w " * 500 + "z" * 777 + "<|endoftext|>" + "q" * 600 + " tail", "ß" * 400 + "'s" * 200, "日本語" * 300, "\x1cab\x1f" * 200,
    ]


def test_equals_the_library_on_hard_texts(spark):
    rows = [(i, t, "extra") for i, t in enumerate(texts())] + [(None, "b" * 900, None), (7, "a" * 3000, "again"), (7, "a" * 3000, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for leaf in (16, 100, 4096):
        got = sorted(map(tuple, bpe.encode_documents(docs, PATH, leaf=leaf, digest=True).collect()), key=str)
        assert got == sorted([(i, *expected(t)) for i, t, _ in rows], key=str)


def test_random_texts_with_letters_whose_lower_case_ends_in_a_mark(spark):
    r = random.Random(11)
    pieces = ["İ", "ß", "\u0301", "\u0307", "\u0085", "É", "a", "Word", "K", "ŉ", "ǰ", "!", ".", "#", "*", "%", "&", "'s", " ", "\u00a0", "1", "<", "|>", "世", "ΑΣ", "\x1c"]
    rows = [(i, "".join(r.choices(pieces, k=r.randrange(16)))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: expected(t) for i, t in rows}
    for leaf in (bpe.LEAF, 7):
        got = {x.doc_id: tuple(x)[1:] for x in bpe.encode_documents(docs, PATH, leaf=leaf, digest=True).collect()}
        assert [t for i, t in rows if got[i] != want[i]] == []


def test_join_agrees_with_one_piece():
    c, r = bpe.coder(PATH), random.Random(1)
    for _ in range(300):
        symbols = [r.choice("thein anred".replace(" ", "")) for _ in range(r.randrange(2, 120))]
        symbols[-1] += c.suffix
        leaves, k = [], 0
        while k < len(symbols):
            n = r.randrange(1, 12)
            leaves.append(c.merge(symbols[k : k + n]))
            k += n
        assert bpe.tree(leaves, c.join) == c.merge(symbols)


def test_whole_table_and_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op5_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: expected(r.text) for r in docs.collect()}


def test_long_texts_of_the_table_are_joined(spark):
    """Halving every text at places that may lie in a word gives the library's ids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    c, joins = bpe.coder(PATH), 0
    for d in docs:
        if len(d.text) > bpe.LEAF:
            leaves = bpe.halves(d.text, bpe.LEAF)
            joins += len(leaves) - 1
            assert "".join(leaves) == d.text and max(map(len, leaves)) <= bpe.LEAF
    assert joins > 0
    frame = spark.createDataFrame([(d.doc_id, d.text) for d in docs if len(d.text) > 3000], "doc_id long, text string")
    for leaf in (999, bpe.LEAF):
        got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_documents(frame, PATH, leaf=leaf, digest=True).collect()}
        assert got == {d.doc_id: expected(d.text) for d in docs if len(d.text) > 3000}
    full = {r.doc_id: r for r in bpe.encode_documents(frame, PATH, leaf=999).collect()}
    assert all(c.lib.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) == r.decoded for r in full.values())


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_short_texts_are_encoded_a_mebibyte_at_a_time(monkeypatch):
    """2,000 texts of 4 KB, and a batch of empty ones."""
    c, asked = bpe.coder(PATH), []
    known = c.known
    monkeypatch.setattr(c, "known", lambda words: (asked.append(sum(map(len, words))), known(words))[1])
    texts = [" ".join(f"w{k}x{j}" for j in range(500)) for k in range(2000)]
    for some in (texts, [""] * 3):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some)], names=["doc_id", "text"])
        got = pa.Table.from_batches(bpe._short(PATH, True)([batch])).to_pylist()
        assert [r["doc_id"] for r in got] == list(range(len(some)))
        assert [tuple(r.values())[1:] for r in got[:3]] == [expected(t) for t in some[:3]]
    assert max(asked) <= 1 << 20
    assert all(isinstance(ids, bytes) for ids in c.words.values())
