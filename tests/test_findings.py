"""Rule entities and bound quantities against plain Python over whole tables."""

import re

from tessera.operators import entities as E
from tessera.plans import findings
from tessera.plans.measures import _plans
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute_entities(text, lexicon):
    plain = text.replace(" ", "").replace("　", "")
    at = [i for i, c in enumerate(text) if c not in " 　"]
    used, out = set(), []

    def put(kind, s, e):
        used.update(range(s, e))
        out.append((kind, at[s], at[e - 1] + 1, plain[s:e]))

    for m in E.STANDARD.finditer(plain):
        put("规范编号", *m.span())
    for words in E.ENTITY_WORDS.values():
        fit = [(len(w), -k, plain.find(w)) for k, w in enumerate(words) if w in plain and not used & set(range(plain.find(w), plain.find(w) + len(w)))]
        if fit:
            n, _, s = max(fit)
            put("危大类别", s, s + n)
    order = {k: i for i, k in enumerate(E.CLOSED)}
    for w, kind in sorted(((w.replace(" ", ""), k) for w, k in lexicon if k in order), key=lambda x: (-len(x[0]), order[x[1]])):
        for m in re.finditer(f"(?={w})", plain):
            if not used & set(range(m.start(), m.start() + len(w))):
                put(kind, m.start(), m.start() + len(w))
    return sorted(out)


def test_rule_entities_of_all_plans(spark):
    got = {}
    for r in QUERIES["rule_entities"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.type, r.start, r.end, r.term))
    plans = _plans(lambda name: spark.read.parquet(f"{SF}/{name}.parquet")).collect()
    assert {p.p_partkey: brute_entities(p.text, findings.LEXICON) for p in plans} == {k: sorted(v) for k, v in got.items()}
    assert {t for v in got.values() for t, *_ in v} == {"规范编号", "危大类别", "工序", "工程类型"}


def test_rule_entities_of_hard_texts(spark):
    texts = [None, "", "  ", "起 重机 与起重吊装，基坑开挖、基坑", "GB 50001-2010JGJ/T 46-2024 塔吊塔吊", "盘扣盘扣盘 扣", "a基坑工程b"]
    lexicon = [("塔吊", "设备"), ("吊塔", "工序"), ("盘扣", "工程类型"), ("", "设备")]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {k: [] for k in range(len(texts))}
    for r in E.rule_entities(rows, lexicon).collect():
        got[r.doc_id].append((r.type, r.start, r.end, r.term))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_entities(t or "", [x for x in lexicon if x[0]]) for k, t in enumerate(texts)}


def category(text):
    best = None
    for name, words in E.CATEGORY_WORDS.items():
        for w in words:
            if w in text and (best is None or len(w) > len(best[1])):
                best = (name, w)
    return best and best[0]


DIMS = {"开挖深度": {"m", "mm", "cm", "km"}, "总荷载": {"kN/m2", "kN/m²", "kPa", "MPa", "Pa"}, "坡度": {"%", "°"}, "面积": {"m2", "m²", "mm2"}, "吊重": {"kN", "N", "t", "kg", "kN/m", "kN/m2", "kN/m²", "kPa", "MPa", "Pa"}}


def test_bound_triples_of_all_lines(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    by = {}
    for r in findings.sentence_entities(table).collect():
        by.setdefault((r.l_orderkey, r.sent), []).append(r)
    cats = {k: category(v[0].sentence) for k, v in by.items()}
    want = []
    number = re.compile(r"(-?\d+(?:\.\d+)?)\s*(" + E.UNITS_AS_WRITTEN + ")(?![a-zA-Z])", re.I)
    for (o, s), ents in by.items():
        cat = cats[o, s] or cats.get((o, s - 1)) or cats.get((o, s + 1))
        for p in (e for e in ents if e.type == "参数"):
            m = next((m for m in number.finditer(p.sentence) if m.start() >= p.end), None)
            if m is None or m.start() - p.end > 10 or m[2] not in DIMS.get(p.text, {m[2]}):
                continue
            subject = next((max((e.end, e.text) for e in ents if e.type == k and e.end <= p.start)[1] for k in E.SUBJECTS if any(e.type == k and e.end <= p.start for e in ents)), "")
            value = abs(float(m[1])) if "深度" in p.text else float(m[1])
            want.append((o, s, cat, subject, p.text, value, m[2]))
    got = list(map(tuple, QUERIES["bound_triples"](spark, SF).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"kN/m²", "m²", "T", "min"} <= {r[6] for r in got} and {"", "履带吊", "排水工程", "绑扎"} <= {r[3] for r in got}
    assert any(r[2] is None for r in got) and any(r[5] < 0 for r in got)


def test_bound_triples_sort_numbers_only(spark):
    """Sentences and entities are made behind the only sort; entities in rows of their own give the same triples."""
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    plan = QUERIES["bound_triples"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Window [") == 1
    want = sorted(map(tuple, E.triples(findings.sentence_entities(table), "l_orderkey").collect()), key=str)
    assert want == sorted(map(tuple, QUERIES["bound_triples"](spark, SF).collect()), key=str)
