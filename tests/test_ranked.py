"""Ranked search against plain Python, and how little leaves a task with many questions."""

import math
import random

import numpy as np
import pyarrow as pa

from tessera.operators import retrieval as R


def brute(texts, questions, k, k1=1.2, b=0.75):
    units = [(key, n, u) for key, us in texts for n, u in enumerate(us)]
    avg = sum(max(1, len(u)) for *_, u in units) / len(units)
    df = {}
    for *_, u in units:
        for w in set(u):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, words in questions:
        best = {}
        for key, n, u in units:
            s = sum(math.log(1 + (len(units) - df[w] + 0.5) / (df[w] + 0.5)) * u.count(w) * (k1 + 1) / (u.count(w) + k1 * (1 - b + b * len(u) / avg)) for w in sorted(set(words)) if w in u)
            if round(s, 6) > 0:
                best.setdefault(key, []).append((-round(s, 6), n))
        ranked = sorted((min(found), key, len(found)) for key, found in best.items())
        ranked.sort(key=lambda r: (r[0][0], r[1]))
        out += [(q, key, n, -s, met - 1, rank) for rank, ((s, n), key, met) in enumerate(ranked[:k], 1)]
    return sorted(out)


def test_equals_plain_python_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "_CELLS", 7)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    texts = [(k, [rng.choices(words, k=rng.randint(0, 12)) for _ in range(rng.randint(1, 9))]) for k in range(120)]
    texts += [(500, [["w1", "w2"]] * 40), (501, [["w1", "w2"]]), (502, [[]])]
    questions = [(q, rng.choices([*words, "unknown"], k=rng.randint(1, 6))) for q in range(40)] + [(99, ["unknown"])]
    t = spark.createDataFrame(texts, "key long, units array<array<string>>")
    q = spark.createDataFrame(questions, "qid long, words array<string>")
    got = R.ranked(t, q, "key", "qid", 4).collect()
    want = brute(texts, questions, 4)
    assert sorted((r.qid, r.key, r.k, r.score, r.collapsed, r["rank"]) for r in got) == [(q, key, n, float(np.round(s, 6)), m, rank) for q, key, n, s, m, rank in want]


class Shared:
    def __init__(self, value):
        self.value = value


def test_a_task_passes_on_the_best_only():
    """50,000 questions with a common word over 400 texts: questions x k rows leave the task, not all pairs."""
    n, k = 50_000, 3
    asked = R.Asked(pa.table({"q": np.repeat(np.arange(n), 2), "w": [w for i in range(n) for w in ("common", f"own{i % 100}")]}))
    one = lambda v: pa.array([[x] for x in v], pa.list_(pa.int32()))
    common = asked.words.index("common")
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + 100)), one([10 + i for i in range(s, s + 100)]), one([0] * 100), one([common] * 100), one([1] * 100)], names=["key", "dl", "unit", "word", "tf"]) for s in range(0, 400, 100)]
    out = pa.Table.from_batches(list(R._score(Shared(asked), np.ones(len(asked.words)), 50.0, k, 1.2, 0.75, ("bm25", "coverage"))(iter(batches))))
    assert out.num_rows == 2 * n * k
    first = out.filter(pa.compute.equal(out["list"], "bm25")).to_pandas()
    assert set(first["key"]) == {0, 1, 2}  # the shortest texts
