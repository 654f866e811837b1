"""op11 against plain Python: for every period, stretches of words that equal those one period on."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import runs as R

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, least=6, power=4):
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w = np.array([number[x] for x in words], np.int64)
    found = {}
    for q in range(1, len(w) // power + 1):
        same = np.r_[False, w[:-q] == w[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in edges.reshape(-1, 2).tolist():
            if e - s + q >= max(least, power * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    out = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *out, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(brute_row(r.doc_id, r.text) for r in docs)
    got = sorted(map(tuple, R.op11_runs(spark, SF).collect()))
    assert got == want and sum(r[1] > 0 for r in got) > len(got) // 20


def found(texts, **kw):
    words, first = R.text_words(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for s, e, q in R.batch_runs(words, first, **kw).tolist():
        k = int(np.searchsorted(first, s, side="right")) - 1
        got[k].append((s - int(first[k]), e - s, q))
    return got


word = st.sampled_from(["a", "b", "c", "é", "\x1c"])
stretch = st.builds(lambda w, n: w * n, st.lists(word, min_size=1, max_size=7), st.integers(1, 12))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(stretch, max_size=6), min_size=1, max_size=4))
def test_equals_brute_force(texts):
    texts = [" ".join(w for part in t for w in part) for t in texts]
    assert found(texts) == [brute(split(t)) for t in texts]


def test_hard_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    hard = ["x " * 5000, "x y " * 3000 + "x", " ".join(fib[-1]), " ".join(thue), " ".join(thue[:64] * 9), ("a b a b a b a b c " * 40) * 5, " ".join(map(str, range(900))) + " " + "q w " * 700]
    assert found(hard) == [brute(split(t)) for t in hard]
    assert found(hard, least_length=4, power=4) == [brute(split(t), 4, 4) for t in hard]
    assert found(hard, least_length=20, power=7) == [brute(split(t), 20, 7) for t in hard]


def test_words_split_as_defined():
    texts = ["", " ", None, "a", "\t\x0b a\x0cb\r\n ", "a b  c", "\x1ca \x1f", "x\x00y z"]
    words, first = R.text_words(pa.array(texts, pa.string()))
    assert [words[int(a) : int(b)].to_pylist() for a, b in zip(first[:-1], first[1:], strict=True)] == [split(t) for t in texts]


def test_hard_rows(spark):
    rows = [(1, None), (None, "a b " * 20), (2, ""), (3, " \n "), (4, "w"), (5, "z " * 60_000), (5, "z " * 60_000), (6, " ".join(map(str, range(40_000)))), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, best string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best, r.collapsed) for r in R.periodic_runs(docs).collect()), key=str)
    want = [(i, len(split(t)), [(0, n, q)] if n else [], 0 if n else None, c) for i, t, n, q, c in (
        (1, None, 0, 0, ""), (None, "a b " * 20, 40, 2, "a b"), (2, "", 0, 0, ""), (3, " \n ", 0, 0, ""), (4, "w", 0, 0, "w"), (5, rows[5][1], 60_000, 1, "z"), (5, rows[5][1], 60_000, 1, "z"), (6, rows[7][1], 0, 0, rows[7][1]), (None, None, 0, 0, ""))]
    assert got == sorted(want, key=str)
    assert R.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power"):
        R.periodic_runs(docs, power=2)


def test_nonterminals_are_computed_once(monkeypatch):
    """A stretch that comes ten times costs no more boundaries than its grammar and tree have."""
    asked = []
    plain = R.Sequence.crossing

    def counting(self, start, middle, end):
        asked.append(int((end - start).sum()))
        return plain(self, start, middle, end)

    monkeypatch.setattr(R.Sequence, "crossing", counting)
    block = " ".join(map(str, range(1000)))
    assert found([f"{block} " * 16]) == [[(0, 16_000, 1000)]]
    assert sum(asked) < 6 * 16_000
