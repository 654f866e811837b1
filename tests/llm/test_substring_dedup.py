import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import substring_dedup as S
from tessera.llm.words import unique


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())


def test_planted_passages(spark):
    r = np.random.default_rng(4)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    passage, line, short = fresh(55), fresh(120), fresh(30)
    docs, hit = [], set()
    for k in range(60):
        t = [" ".join(fresh(r.integers(5, 200))) for _ in range(3)]
        if k % 10 == 1:  # inside a line
            t[1] += " " + ", ".join(passage).upper() + " " + " ".join(fresh(9))
            hit.add(k)
        if k % 10 == 2:  # a line with a changed word
            own = list(line)
            own[int(r.integers(10, 110))] = "changed"
            t.insert(1, " ".join(own))
            hit.add(k)
        if k % 10 == 3:  # too short
            t.insert(1, " ".join(short))
        docs.append((k, "\n".join(t)))
    docs += [(200, None), (201, ""), (None, "x " + " ".join(passage)), (202, " ".join(fresh(40) * 5)), docs[0], docs[1]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kept string")
    got = S.repeated_passages(frame).collect()
    assert {g.doc_id for g in got} == hit | {None}
    assert {g.kept for g in got if g.doc_id is None} == {True} and {g.kept for g in got if g.doc_id == 51} >= {False}
    text = dict(docs)
    for g in got:
        if g.doc_id is not None and g.doc_id % 10 == 1 and not g.kept:
            span = words(text[g.doc_id])[g.first_word : g.end_word]
            assert len(span) >= S.WINDOW and " ".join(span) in " ".join(passage)
    left = {d.doc_id: d.text for d in S.strip_repeats(frame.where("doc_id % 10 = 2 or doc_id = 4")).collect()}
    assert len(left) == 8 and left[4] == text[4]
    assert [len(words(left[k])) == len(words(text[k])) for k in (2, 12, 22)] == [True, False, False]
    assert words(text[12])[-5:] == words(left[12])[-5:]


def test_any_shared_run_of_fifty_words_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    seen = {}
    for d in docs:
        w = words(d.text)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(d.doc_id)
    want = set().union(*(v for v in seen.values() if len(v) > 1))
    near = {r.doc_id for r in S.op7_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert want and want <= near
    runs = {}
    for d in docs:
        w = words(d.text)
        for k in range(len(w) - 29):
            runs.setdefault(tuple(w[k : k + 30]), set()).add(d.doc_id)
    assert near <= set().union(*(v for v in runs.values() if len(v) > 1))


def test_near_lines_equal_brute_force(spark):
    """All pairs of lines of 40 words or more whose shingles are similar enough, in different documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    lines = [(d.doc_id, w) for d in docs for x in d.text.split("\n") if len(w := words(x)) >= S.LEAST_WORDS]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in lines]
    inverted = {}
    for k, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(k)
    hit = set()
    for k, s in enumerate(sets):
        met = {}
        for x in s:
            for j in inverted[x]:
                met[j] = met.get(j, 0) + 1
        hit |= {lines[k][0] for j, n in met.items() if lines[j][0] != lines[k][0] and 100 * n >= 75 * (len(s) + len(sets[j]) - n)}
    found = {r.doc_id for r in S.op7_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert hit and len(hit & found) >= 0.9 * len(hit) and hit <= found


def test_pieces_short_lines_and_long_texts(spark):
    r = np.random.default_rng(9)
    fresh = lambda n: [f"v{x}" for x in r.integers(0, 10**7, n)]
    passage, shorts = fresh(160), [fresh(15) for _ in range(4)]
    changed = list(passage)
    for k in range(20, 160, 38):  # no 40 words in a row are equal
        changed[k] = "other"
    rows = [(1, " ".join(fresh(300) + passage + fresh(250))), (2, " ".join(fresh(90) + changed + fresh(400)))]
    rows += [(3, "\n".join([" ".join(fresh(9)), *map(" ".join, shorts)])), (4, "\n".join([*map(" ".join, shorts), " ".join(fresh(7))])), (5, " ".join(shorts[0])), (6, " ".join(shorts[0]))]
    rows += [(7, " ".join(fresh(120_000) + passage)), (8, "x " * 60_000)]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id for g in got} == {1, 2, 3, 4, 7}
    assert sum(g.end_word - g.first_word for g in got if g.doc_id == 4) == 60 and all(g.first_word >= 120_000 for g in got if g.doc_id == 7)


def test_empty(spark):
    assert S.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_miss_few_pairs():
    missed = (1 - (S.PERCENT / 100) ** S.ROWS) ** S.BANDS
    assert missed <= (1 - (S.PERCENT / 100) ** 3) ** 24 < 1 / 500_000


def test_merged_spans_do_not_depend_on_batches():
    """Spans merge as by brute force, also where a text's paragraphs, or a span, lie in several batches."""
    draw, names = np.random.default_rng(5), [x.split()[0] for x in S._SPAN.split(", ")]
    rows = sorted((int(d), int(t), bool(k), int(a), int(a + n), int(f)) for d, t, k, a, n, f in zip(*(draw.integers(0, m, 400) for m in (4, 2, 2, 300, 9, 5)), strict=True))
    want = []
    for *text, a, b, f in rows:
        if want and want[-1][:3] == text and a <= want[-1][4]:
            want[-1][4:] = max(want[-1][4], b), min(want[-1][5], f)
        else:
            want.append([*text, a, b, f])
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64())
    for size in (1, 7, 400):
        cut = [list(zip(*rows[at : at + size], strict=True)) for at in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names) for cols in cut]
        got = [[*r.values()] for b in S._merged(iter(batches)) for r in b.to_pylist()]
        assert got == want
    assert list(S._merged(iter(()))) == []


def test_unique_as_numpy():
    for n in (0, 1, 1_000):
        values = np.random.default_rng(n).integers(0, 500, n).astype(np.uint64)
        assert np.array_equal(unique(values), np.unique(values)) and unique(values).dtype == np.uint64
