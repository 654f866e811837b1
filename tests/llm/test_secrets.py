import hashlib
import random
import re

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    n = [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
    return *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


TEXTS = [
    None, "", "plain text", "password: secret: abcdefghij", "PASSWD = 'hunter2hunter2' and token=short", "ſecret=abcdefgh1 toKen=abcdefgh1",
    "key AKIA" + "A1" * 8 + " x" * 10 + " AKIA1234", "\U0001F600 é " + "0a" * 16 + " " + "0a" * 15 + "G", "api_key=" + "f" * 40, 'apikey" : "abcdEFGH=="',
    "user: bob99 then Zx81kQp0Lm22Tr7Yv9Bn4c at https://db.example.com/x", "a lone Zx81kQp0Lm22Tr7Yv9Bn4c stands", "a host: db.example.com alone",
    "user: bob99\n\nother scope Zx81kQp0Lm22Tr7Yv9Bn4c", "user: bob99 " + "x " * 200 + "Zx81kQp0Lm22Tr7Yv9Bn4c", "secret=abcdefgh12 https://h.example.com", "x" * 300_000,
]


def test_base_spans_and_links(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "secret=abcdefgh12", 1), (9, TEXTS[9], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = secrets.digest(secrets.link_secrets(docs)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(((i, *base(t)) for i, t, _ in rows), key=str)
    spans = {r.doc_id: r.spans for r in got}
    kinds = lambda i: [s.split(":")[0] for s in spans[i].split(",") if s]
    assert kinds(10) == ["ident", "token", "endpoint"]
    assert kinds(11) == kinds(12) == kinds(13) == kinds(14) == []
    assert kinds(15) == ["assign", "endpoint"]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: tuple(r)[1:5] for r in secrets.op1_secrets(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: base(r.text) for r in docs.collect()}
    assert sum(g[0] + g[1] + g[2] for g in got.values()) > 5


def test_links_equal_all_pairs(spark):
    """Every weak part against every other part of its scope."""
    r = random.Random(7)
    words = ["user: bob99", "client_id=acme.7", "Zx81kQp0Lm22Tr7Yv9Bn4c", "aB3dE5gH7jK9mN1pQ3sT", "https://db.example.com/x", "host: a.b.example", "secret=abcdefgh12", "0a" * 16, "plain", "x " * 40, "\n\n", "AKIA" + "A1" * 8]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(2, 40))) for _ in range(150)]
    texts += [" ".join(f"aB{k}dE5gH7jK9mN1pQ3sT{k}" for k in range(20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s["kind"], s["start"], s["end"]) for s in x.spans] for x in secrets.link_secrets(docs).collect()}
    secret = {"assign", "hex", "token"}
    for i, t in enumerate(texts):
        every = secrets.parts(t)
        if i == len(texts) - 1:
            assert got[i] == [] and len(every) == 20_000
            continue
        shown = []
        for k, s, e, c in every:
            others = [(s2, e2) for k2, s2, e2, c2 in every if c2 == c and (k2 in secret) != (k in secret)]
            near = any(s2 - e <= secrets.WINDOW if s2 > s else s - e2 <= secrets.WINDOW for s2, e2 in others)
            if k in secrets.STRONG or near:
                shown.append((secrets.KINDS.index(k), s, e))
        assert got[i] == sorted(shown, key=lambda x: (x[1], x[0])), t


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a secret=abcdefgh12 z", 21), (2, "clean", 5), (3, None, None), (1, "a secret=abcdefgh12 z", 21)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, secrets.redact(docs).collect()), key=str)
    assert got == sorted([(1, "a <assign> z", 12), (1, "a <assign> z", 12), (2, "clean", 5), (3, None, None)], key=str)


def test_empty(spark):
    assert secrets.link_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
