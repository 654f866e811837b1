import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import chroma as C


def song(seed, n=40):
    r = np.random.default_rng(seed)
    t = np.arange(1500) / C.RATE
    return np.concatenate([sum(r.uniform(0.1, 1) * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in r.integers(0, 12, 4)) for _ in range(n)]) * 6000


def pcm(x):
    return np.clip(x, -32768, 32767).astype("<i2").tobytes()


def test_integral_image_and_bits():
    p = C.fingerprint(song(1).astype(np.float32))
    assert p.dtype == np.uint32 and len(p) == len(C.chroma(song(1).astype(np.float32))) - C.SPAN + 1
    assert C.bit_errors(p, p, 0) == (0, len(p)) and C.bit_errors(p, p[10:], 10) == (0, len(p) - 10)
    other = C.fingerprint(song(2).astype(np.float32))
    assert 0.3 < C.bit_errors(p, other, 0)[0] / (32 * len(p)) < 0.7


def test_search_aligns_noisy_and_cut_recordings(spark):
    r = np.random.default_rng(0)
    rows = [(k, pcm(song(k))) for k in range(1, 15)]
    rows += [(100, pcm(song(3) + r.normal(0, 60, 60_000))), (101, pcm(song(3)[20 * C.HOP :])), (102, pcm(song(3))), (103, None), (104, b""), (105, b"\0" * 100), (None, pcm(song(5)))]
    media = spark.createDataFrame([(*x, "x") for x in rows], "media_id long, audio binary, prints string")
    prints = C.fingerprints(media)
    got = {x.media_id: x for x in C.links(prints, prints.where("media_id = 3 or media_id > 99 or media_id = 7")).collect()}
    assert set(got) == {3, 7, 100, 101, 102, 103, 104, 105}
    assert got[3].class_id == got[102].class_id == 3 and got[3].n_links == got[102].n_links == 2
    assert got[101].best_id == 3 and got[101].offset == -20 and got[101].bit_error_rate < 0.02
    assert got[100].n_links == 2 and got[7].n_links == 0 and got[103].n_links == got[105].n_links == 0


def test_recall_against_brute_force(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as media_id", "embedding")
    prints = {x.media_id: np.frombuffer(x.prints, "<u4") for x in C.fingerprints(v.mapInArrow(C._sound, "media_id long, audio binary")).collect()}
    want, ids = {}, sorted(prints)
    for q in ids:
        if q % 20 == 0:
            for m in ids:
                if m != q:
                    tried = [(e, n) for o in range(-38, 39) for e, n in [C.bit_errors(prints[q], prints[m], o)] if n >= C.LEAST_OVERLAP and e <= 32 * n * C.MAX_ERROR]
                    if tried:
                        want.setdefault(q, set()).add(m)
    got = {x.media_id: x.n_links for x in C.op10_chroma(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {q for q in ids if q % 20 == 0}
    total = sum(map(len, want.values()))
    assert sum(got.values()) <= total and (total == 0 or sum(got.values()) >= 0.9 * total)


def test_empty(spark):
    prints = C.fingerprints(spark.createDataFrame([], "media_id long, audio binary"))
    assert C.links(prints, prints).count() == 0
