"""Queries that SQL can't express, over their whole tables, against plain Python."""

import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.operators.chunking import recursive_spans
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spans(spark):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        s = r.l_suppkey % 40
        out[r.l_orderkey].append((s, int(s + r.l_quantity), r.l_returnflag, "gold" if r.l_linestatus == "F" else "model", r.l_linenumber, r.l_partkey))
    return out


def rows(spark, name):
    return sorted(map(tuple, QUERIES[name](spark, SF).collect()))


def test_votes(spark, spans):
    want = []
    for g, own in spans.items():
        for kind in {x[2] for x in own}:
            left = sorted(x[:2] for x in own if x[2] == kind)
            while left:
                near = [x for x in left if x[0] < left[0][1] and left[0][0] < x[1]]
                want.append((g, kind, *max(near, key=lambda x: x[1] - x[0]), len(near)))
                for x in near:
                    left.remove(x)
    assert rows(spark, "vote_groups") == sorted(want)


def test_sanitized(spark, spans):
    want = []
    for g, own in spans.items():
        last = 0
        for s, n, i, p in sorted((max(s, 0), -min(e, 60), i, p) for s, e, _, _, i, p in own):
            if s < -n and s >= last:
                want.append((g, i, p, s, -n))
                last = -n
    assert rows(spark, "sanitize_spans") == sorted(want)


def test_cascade(spark, spans):
    want = []
    for g, own in spans.items():
        rules = [x[:2] for x in own if x[3] == "gold"]
        last = -1
        for s, n, i, p in sorted((s, -e, i, p) for s, e, _, who, i, p in own if who == "model" and not any(a < e and s < b for a, b in rules)):
            if s >= last:
                want.append((g, i, p, s, -n))
                last = -n
    assert rows(spark, "cascade_spans") == sorted(want)


def test_relaxed(spark, spans):
    want = []
    for g, own in spans.items():
        tp = gold = free = 0
        for kind in {x[2] for x in own}:
            a, b = ([x[:2] for x in sorted(own) if x[2] == kind and x[3] == who] for who in ("gold", "model"))
            gold, free = gold + len(a), free + len(b)
            for s, e in a:
                k = next((k for k, m in enumerate(b) if m[0] < e and s < m[1]), None)
                if k is not None:
                    tp += 1
                    del b[k]
        want.append((g, tp, free - tp, gold - tp))
    assert rows(spark, "relaxed_f1") == sorted(want)


def test_tags_decoded(spark):
    tags = defaultdict(list)
    for r in QUERIES["char_bioe"](spark, SF).collect():
        tags[r.g].append((r.pos, *r.tag.split("-")))
    want = []
    for g, own in tags.items():
        runs = []
        for pos, head, kind in sorted(own):
            goes_on = runs and not runs[-1]["ended"] and head != "B" and runs[-1]["kind"] == kind and runs[-1]["last"] == pos - 1
            if not goes_on:
                runs.append({"start": pos, "kind": kind})
            runs[-1] |= {"last": pos, "ended": head == "E"}
        want += [(g, r["kind"], r["start"], r["last"] + 1) for r in runs]
    assert rows(spark, "bioe_decode") == sorted(want)


def test_hashed_vectors(spark):
    for r, t in zip(
        sorted(QUERIES["hash_vectors"](spark, SF).collect()), sorted((c.conv_id, c.turn, c.text or "") for c in spark.read.parquet(f"{SF}/conversations.parquet").collect()), strict=True
    ):
        v, low = np.zeros(256), t[2].lower()
        for n, weight in ((1, 0.5), (2, 1.0)):
            for k in range(len(low) - n + 1):
                h = 5381
                for c in low[k : k + n]:
                    h = (h * 33 + ord(c)) & 0xFFFFFFFF
                v[h % 256] += weight
        assert (r.conv_id, r.turn) == t[:2] and np.allclose(r.vector, v / max(np.linalg.norm(v), 1e-12))


def test_guards(spark):
    users = defaultdict(list)
    for e in spark.read.parquet(f"{SF}/events.parquet").collect():
        users[e.user_id].append((e.ts, e.event_id, e.event_type))
    states, taken = [], []
    for user, own in users.items():
        history, blocked, tokens, before = [], 0, 5.0, None
        for ts, event, kind in sorted(own):
            if history[-3:].count(kind) >= 2:
                blocked, history = blocked + 1, []
                states.append((event, user, "degraded" if blocked > 2 else "blocked"))
            else:
                history.append(kind)
                states.append((event, user, "degraded" if blocked > 2 else "admitted"))
            tokens = min(5.0, tokens + (0 if before is None else (ts - before).total_seconds() / 3600))
            before = ts
            taken.append((event, user, tokens >= 1))
            tokens -= tokens >= 1
    assert rows(spark, "loop_guard") == sorted(states) and rows(spark, "token_bucket") == sorted(taken)


def test_dictionary(spark):
    from tessera.plans.labels import LEXICON

    want = []
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        taken = set()
        found = [("NUMBER", m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)?", d.text or "")]
        for term, kind, _ in sorted(LEXICON, key=lambda x: (-len(x[0]), x[2], x[0])):
            found += [(kind, m.start(), m.start() + len(term)) for m in re.finditer(f"(?={re.escape(term)})", d.text or "")]
        for kind, s, e in found:
            if not taken & set(range(s, e)):
                taken |= set(range(s, e))
                want.append((d.doc_id, kind, s, e, d.text[s:e]))
    assert rows(spark, "dictionary_spans") == sorted(want)


def test_chunks_cover_texts(spark):
    texts = {str(d.doc_id): d.text or "" for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = []
    for i, text in texts.items():
        parts = [(0, len(text))] if len(text) <= 1200 else recursive_spans(text)
        want += [(f"{i}#{k}", text[a:b]) for k, (a, b) in enumerate(parts) if text[a:b].strip()]
    assert sorted((r.uid, r.text) for r in QUERIES["recursive_chunks"](spark, SF).collect()) == sorted(want)


def test_clauses_of_documents(spark):
    """Texts of 20 lines or more come back line by line; others as fixed chunks."""
    got = defaultdict(list)
    for r in QUERIES["clause_levels"](spark, SF).collect():
        got[int(r.source)].append(r)
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == {i for i, t in docs.items() if t}
    for i, own in got.items():
        if {r.way for r in own} == {"clause"}:
            assert len(own) <= len(docs[i].split("\n")) and len({r.clause_no for r in own}) == len(own)
        else:
            assert {r.way for r in own} == {"fixed"} and [r.clause_no for r in own] == [f"C{k:04d}" for k in range(1, len(own) + 1)]
    assert {r.way for own in got.values() for r in own} >= {"fixed"}
