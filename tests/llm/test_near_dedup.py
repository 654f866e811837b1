import re

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import near_dedup
from tessera.llm.minhash import jaccard_at_least, sketch

import numpy as np


def brute(rows):
    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    inverted = {}
    for k, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        met = {}
        for x in s:
            for j in inverted[x]:
                if j < k:
                    met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def ran(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    return sorted(map(tuple, near_dedup.near_components(docs).collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, near_dedup.op8_minhash(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_ties_and_hard_rows(spark):
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(5, None), (None, "a b c d e f g"), (9, "a b c d e f g"), (3, ""), (4, " \n"), (8, "Ab  c"), (2, "aB c"), (2, "aB c"), (11, "\x0bx y z"), (None, "q")]
    rows += [(100, " ".join(base))]
    for k in range(60):  # copies of one text, most of them further from each other than from it
        w = list(base)
        for i in r.choice(60, 2 if k % 3 else 1, replace=False):
            w[i] = f"n{k}x{i}"
        rows.append((200 + k, " ".join(w)))
    rows += [(500, " ".join(f"t{i}" for i in range(7))), (501, " ".join(f"t{i}" for i in range(8)))]  # 3 of 4 shingles: just similar enough
    assert ran(spark, rows) == brute(rows)


def test_empty(spark):
    assert ran(spark, [(1, "a")]) == [(1, 1, 1, True)]
    assert near_dedup.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_members_meet_pivots_without_a_pass_of_their_own(spark, monkeypatch):
    """Many texts that share a passage, in groups too far apart to be linked: mixed buckets are told by the join
    that meets their pivots, and by a pass of its own only once, before blocks are compared."""
    r = np.random.default_rng(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(g * 10 + k, " ".join([*common, *(f"g{g}x{i}" for i in range(22)), *(f"n{g}x{k}x{i}" for i in r.integers(0, 9, k % 3))])) for g in range(40) for k in range(4)]
    passes, mixed = [], near_dedup.link_classes.__globals__["_mixed"]
    monkeypatch.setitem(near_dedup.link_classes.__globals__, "_mixed", lambda members: passes.append(members.count()) or mixed(members))
    assert ran(spark, rows) == brute(rows)
    assert len(passes) == 1


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 700).astype(np.uint64)
    b = np.r_[a[:600], r.integers(0, 1 << 63, 100).astype(np.uint64)]
    s = sketch(np.r_[np.sort(a), np.sort(b)], np.array([0, 700, 1400]), 320)
    assert abs((s[0] == s[1]).mean() - 600 / 800) < 0.1
    one = sketch(np.array([7], np.uint64), np.array([0, 1]), 320)
    assert (one != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert jaccard_at_least(np.arange(3), np.arange(4), 75)
