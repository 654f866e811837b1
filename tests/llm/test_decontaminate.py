import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import decontaminate as D
from tessera.llm.shared import Bitmap
from tessera.llm.words import MARKS, Words


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    """Every shift of every pair that any mask hits."""
    out = set()
    for i, t in docs:
        d = words(t)
        for j, s in items:
            w = words(s)
            places, spans = set(), []
            for shift in range(-len(w), len(d)):
                hit = any(all(0 <= k + o + shift < len(d) and d[k + o + shift] == w[k + o] for o, x in enumerate(m) if x == "1") and 0 <= k + shift and k + shift + len(m) <= len(d) for m in D.MASKS for k in range(len(w) - len(m) + 1))
                if hit:
                    ids = {x: n for n, x in enumerate(dict.fromkeys([*d, *w]))}
                    p = D.overlap(np.array([ids[x] for x in d]), np.array([ids[x] for x in w]), shift)
                    places.update(p.tolist())
                    spans += [(int(p[0]) + shift, int(p[-1]) + shift + 1)] if len(p) else []
            if w and places and len(places) >= D.COVERAGE * len(w):
                out.add((i, j, len(places), len(w), min(a for a, _ in spans), max(b for _, b in spans)))
    return out


def ran(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return sorted(((r.doc_id, r.item_id, r.matched, r.item_words, r.first_word, r.end_word) for r in D.contaminated(d, b).collect()), key=str)


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    word = lambda: f"w{r.integers(0, 900)}"
    items = [(k, " ".join(word() for _ in range(r.integers(6, 40)))) for k in range(12)] + [(50, None), (51, "too short"), (None, "a b c d e f g h"), (3, None), (60, "same same same same same same same same")]
    docs = [(1, None), (2, ""), (None, "x a b c d e f g h y"), (7, "same " * 3000)]
    for k in range(40):
        t = [word() for _ in range(r.integers(0, 60))]
        item = words(items[k % 12][1])
        for _ in range(k % 4):  # changed words
            item[r.integers(0, len(item))] = "changed"
        cut = item[: len(item) // 3] if k % 5 == 0 else item
        docs.append((100 + k, " ".join([*t, *cut, *(word() for _ in range(5))]).upper() if k % 2 else ", ".join([*t, *cut])))
    docs.append(docs[-1])
    assert ran(spark, docs, items) == sorted(brute(docs, items), key=str)


def test_whole_table_finds_every_exact_passage(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in D.op6_decontaminate(spark, "/root/testdata/sf0.01").collect()}
    exact = {(x.doc_id, y.item_id) for y in b for x in d if y.text in (x.text or "")}
    assert exact and exact <= got and len(got) < 2 * len(exact)


def test_empty(spark):
    assert ran(spark, [(1, "a b c d e f g")], []) == []
    assert ran(spark, [], [(1, "a b c d e f g")]) == []


def test_clean_only(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "other"), (None, "z")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert sorted(map(tuple, D.clean_only(docs, b).collect()), key=str) == [(2, "other"), (None, "z")]


def dense_places(d, w):
    """Places of w in parts of any diagonal with six equal words, gaps of three, two thirds equal."""
    out = set()
    for shift in range(-len(w), len(d)):
        e = [k for k in range(max(0, -shift), min(len(w), len(d) - shift)) if w[k] == d[k + shift]]
        for i in range(len(e)):
            for j in range(i, len(e)):
                if j > i and e[j] - e[j - 1] > D.GAP + 1:
                    break
                if j - i + 1 >= D.STRETCH and 3 * (j - i + 1) >= 2 * (e[j] - e[i] + 1):
                    out.update(e[i : j + 1])
    return out


def test_all_diagonals_without_masks(spark):
    items = [(1, " ".join(f"a{k}" for k in range(80))), (2, " ".join(f"b{k}" for k in range(60)))]
    docs = [(10 * p + o, " ".join(f"x{k}" if k % p == o else f"a{k}" for k in range(80))) for p in range(3, 9) for o in range(p)]
    docs.append((200, " ".join(f"b{k}" if k < 31 or k % 4 == 2 else "y" for k in range(60))))  # an exact half, then chance matches
    docs += [(300, " ".join(f"b{k}" if k < 20 or k % 4 == 2 else "y" for k in range(60))), (301, " ".join(f"x{k}" for k in range(80)))]
    want = {(i, j): len(p) for i, t in docs for j, s in items if len(p := dense_places(words(t), words(s))) >= D.COVERAGE * len(words(s))}
    assert {(i, 1) for i in range(40, 44)} <= set(want) and (200, 2) in want and (300, 2) not in want
    assert {(i, j): n for i, j, n, *_ in ran(spark, docs, items)} == want


def test_every_long_overlap_holds_a_mask():
    masks, size = [int(m, 2) for m in D.MASKS], 1 << max(map(len, D.MASKS))
    best = {1: 1}  # the last places: three for an equal word less two for each, without a mask
    for n in range(2, 200):
        longer = {}
        for was, value in best.items():
            for bit in (0, 1):
                now = (was << 1 | bit) % size
                if (bit or now & (2 << D.GAP) - 1) and not any(now & m == m for m in masks):
                    longer[now] = max(longer.get(now, -(10**9)), value + (1 if bit else -2))
        best = longer
        assert n <= 60 or all(v < 0 for k, v in best.items() if k & 1)


def test_hits_hold_a_mebibyte_of_texts_at_a_time():
    """500 texts of 16 KB: with their seeds of all masks at once the peak was 555 MB."""
    texts = [" ".join(f"w{k * 3001 + j}" for j in range(2000)) for k in range(500)]
    item = " ".join(texts[7].split()[100:140])
    h, bits = D.seeds(Words(pa.array([item]), MARKS))[0], 1 << 20
    near = Bitmap(np.zeros(bits // 8, np.uint8), bits)
    for x in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
        np.bitwise_or.at(near.words, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    out = pa.Table.from_batches(D._hits(SimpleNamespace(value=near))([batch])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = {r["doc_id"]: set(np.array(r["seeds"], np.int64).view(np.uint64).tolist()) for r in out}
    assert set(h.tolist()) <= found[7]
    assert peak < 64 << 20
    words = Words(batch.column("text").slice(7, 1), MARKS)
    every, at = D.seeds(words)
    assert [x.tolist() for x in D.seeds(words, near)] == [x[near.has(every)].tolist() for x in (every, at)]
