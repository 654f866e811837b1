"""op12 against plain Python: strings, dictionaries and a sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import resample as R
from tessera.llm.words import MARKS, Words

SF = "/root/testdata/sf0.001"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target, least=20, share=(5, 100)):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)}
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = share[0] * len(fit) // share[1]
    ranked = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(fit)]
    return sorted(ranked + [(*r, None) for r in rows if r[1] < least], key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(((i, f, w, s, k) for i, _, f, w, s, k in brute(docs, target)), key=str)
    assert rows(R.op12_resample(spark, SF)) == want


def test_hard_rows(spark):
    """Nulls, no words, ties at the cutoff, repeated rows, long words and texts, clashing columns."""
    docs = [(k, "same words here and there " * 5) for k in range(200)] + [(7, "same words here and there " * 5)] * 5
    docs += [(None, "same words here and there " * 5)] * 40 + [(1, None), (2, ""), (3, " -- !"), (None, None), (4, "é" * 200 + " ß" + "X" * 90_000), (5, "Aé b1 c " * 20_000)]
    target = ["same words", None, "", "b1 c aé"]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score long, rank long")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for share in ((5, 100), (90, 100), (1, 1), (0, 1)):
        assert rows(R.resample(frame, goal, share=share)) == brute(docs, target, share=share)
    assert rows(R.resample(frame, goal.limit(0), least_words=0)) == brute(docs, [], least=0)
    assert R.resample(frame.limit(0), goal).count() == 0


def test_bisection_counts(spark):
    frame = spark.range(1000).selectExpr("id % 37 * id AS v")
    values = sorted(k % 37 * k for k in range(1000))
    for wanted in (1, 2, 500, 999, 1000):
        v, below = R.least_value(frame, frame.v, values[0], values[-1], wanted)
        assert v == values[wanted - 1] and below == sum(x < v for x in values)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abZ9é 漢.-", max_size=40), st.text(max_size=200)), max_size=6))
def test_buckets_are_those_of_strings(texts):
    n = len(texts)
    got = [[] for _ in texts]
    for bucket, text in R.feature_buckets(Words(pa.array(texts, pa.string()), MARKS)):
        for b, k in zip(bucket.tolist(), text.tolist(), strict=True):
            got[k].append(b)
    assert n == 0 or got == [features(t)[1] for t in texts]


def test_long_shift():
    for size in (0, 1, 64, 65, 66, 1000, 123_456):
        a, b = b"first words", b"x" * size
        both = R.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([size], np.int64))[0] ^ np.uint32(zlib.crc32(b))
        assert int(both) == zlib.crc32(a + b)
