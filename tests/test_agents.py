"""Rewards against plain Python, chains and steps on small graphs, the table function against the query."""

import json
import re

import pytest

from tessera.operators import lineage
from tessera.operators.rewards import WEIGHTS, comparable, first_number
from tessera.plans import agents
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
DIGIT = dict(zip("〇零一二两三四五六七八九", "001223456789", strict=True))


def plain(text):
    text = re.sub(r"[\s，。；、：:（）()【】\[\]\"'“”‘’/\\·—–-]", "", text or "").lower()

    def number(m):
        left, ten, right = m[0].partition("十")
        if not ten:
            return "".join(DIGIT[c] for c in left)
        return str(int(DIGIT.get(left, 1)) * 10 + int(DIGIT.get(right, 0)))

    return re.sub("[〇零一二两三四五六七八九十]{1,4}", number, text)


def number(text):
    m = re.search(r"[-+]?\d+(?:\.\d+)?", (text or "").translate(str.maketrans("０１２３４５６７８９．－", "0123456789.-")))
    return float(m[0]) if m else None


def loads(text):
    try:
        return json.loads(text)
    except ValueError:
        return None


def graded(a):
    text = a.response or ""
    whole = loads(text)
    complete = lambda o: isinstance(o, dict) and None not in (o.get("conclusion"), o.get("basis"), o.get("explanation"))
    inner = re.search(r"\{.*\}", text, re.S)
    obj = whole if complete(whole) else loads(inner[0]) if inner and complete(loads(inner[0])) else None
    conclusion = obj["conclusion"] if obj else text
    if not text.strip():
        form = 0.0
    elif isinstance(whole, dict):
        bad = (a.require_steps and not whole.get("cot_steps")) or (a.options and conclusion not in a.options)
        form = 0.6 if not complete(whole) else 0.8 if bad else 1.0
    else:
        form = 0.4 if inner else 0.2
    steps = [s for s in (obj or {}).get("cot_steps") or [] if s.strip()]
    said, chain = plain("".join(steps)), [plain(g) for g in a.golden_steps or []]
    hit = sum(len(g) > 3 and g in said for g in chain) / max(1, len(chain))
    gold = [plain(g) for g in a.golden_basis or []]
    if not steps:
        score = 0.0
    elif hit == 1:
        score = 1.0
    else:
        links = "因此 综上 所以 因为 由于 依据 故 则 即 对照 比对 换算 代入 据此 由此".split()
        start = plain(a.expect)[:3]
        named = (start and start in said) or any(len(g) > 2 and g in said for g in gold)
        score = min(1, 0.3 + 0.2 * (len(steps) > 1) + 0.2 * any(w in "".join(steps) for w in links) + 0.3 * bool(named) + 0.15 * hit)
    codes = obj["basis"] if obj else list(dict.fromkeys(re.findall(r"JGJ/T 46-2024|建办质〔2018〕31号", text)))
    named = [plain(c) for c in codes]
    same = lambda g, n: g == n or (len(g) > 2 and (g in n or n in g))
    if gold:
        false = sum(not any(same(g, n) for g in gold) for n in named) / max(1, len(named))
        basis = max(0, sum(any(same(g, n) for n in named) for g in gold) / len(gold) - 0.3 * false)
    else:
        basis = 0.5 * bool(named)
    hay, other = plain(conclusion), any(plain(x) and plain(x) in plain(conclusion) for x in a.alias)
    if a.mode == "set_match":
        items = [i for i in map(str.strip, re.split("[,，;；、]", a.expect)) if i]
        answer = sum(bool(plain(i)) and (plain(i) in hay or other) for i in items) / len(items)
    elif a.mode == "numeric":
        got, want = number(conclusion), number(a.expect)
        answer = 0.0 if got is None else max(0, 1 - abs(got - want) / (a.tolerance or max(0.1 * want, 0.5)))
    else:
        answer = float(bool(plain(a.expect) and plain(a.expect) in hay) or other)
    parts = (form, score, basis, answer)
    return (*parts, sum(w * p for w, p in zip((0.15, 0.2, 0.25, 0.4), parts, strict=True)))


def test_rewards_of_all_answers(spark):
    want = {(a.conv_id, a.turn): graded(a) for a in agents.answers(spark.read.parquet(f"{SF}/conversations.parquet")).collect()}
    got = {(r.conv_id, r.turn): tuple(r)[2:] for r in QUERIES["answer_rewards"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for key, parts in want.items():
        assert got[key] == pytest.approx(parts, abs=6e-5), key
    for column in range(4):
        assert len({p[column] for p in want.values()}) > 2
    assert sum(WEIGHTS.values()) == pytest.approx(1)


def test_comparable_texts(spark):
    texts = ["第二十三条", "第 九 条", "十", "二十", "十十", "一二十三", "二〇一八", "两", "二十三四", "A（b）【C】", "一二三四五", None, "", "ＧＢ　1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(comparable(rows.t)).collect()] == [plain(t) for t in texts]
    numbers = ["约４．５Ω", "-3 or 4", "none", None, "+7.", "第9条"]
    rows = spark.createDataFrame([(t,) for t in numbers], "t string")
    assert [r[0] for r in rows.select(first_number(rows.t)).collect()] == [number(t) for t in numbers]


def test_chain_ends(spark):
    chain = [(k, k + 1, k) for k in range(100, 150)]
    rows = chain + [(1, 2, 5), (1, 3, 7), (3, 4, 6), (10, 11, 1), (11, 12, 2), (12, 10, 3), (9, 10, 1), (20, 20, 1), (None, 4, 1), (5, None, 1), (1, 3, 7)]
    got = {r.code: (r.valid_end, r.hops, r.since, r.path, r.status) for r in lineage.chain_ends(spark.createDataFrame(rows, "code long, next long, since int")).collect()}
    assert got[100] == (150, 50, 149, list(range(101, 151)), "superseded") and got[149][:3] == (150, 1, 149) and got[150] == (150, 0, None, [], "valid")
    assert got[1] == (4, 2, 6, [3, 4], "superseded") and got[2] == (2, 0, None, [], "valid")
    assert all(got[k] == (None, None, None, None, "cycle") for k in (9, 10, 11, 12, 20)) and None not in got and 5 not in got
    assert lineage.chain_ends(spark.createDataFrame([], "code long, next long, since int")).count() == 0


def test_step_status(spark):
    steps = [(1, s, o) for s, o in ((1, "success"), (2, "failed"), (3, "success"), (4, "success"), (5, "success"), (6, None))]
    steps += [(2, 1, "success"), (2, 2, "success"), (2, 3, "success"), (3, 1, "success"), (4, 1, "timeout"), (4, 1, "success"), (None, 1, "success")]
    # a diamond 1 -> 2, 3 -> 4 with a failed hard side; 5 waits softly for the failed one
    needs = [(1, 2, 1, True), (1, 3, 1, True), (1, 4, 2, True), (1, 4, 3, True), (1, 5, 2, False), (1, 5, 4, False), (1, 5, 4, False), (2, 2, 3, False), (2, 3, 2, True), (3, 1, 9, True)]
    got = {(r.graph, r.step): (r.status, r.wave) for r in lineage.step_status(spark.createDataFrame(steps, "graph long, step int, outcome string"), spark.createDataFrame(needs, "graph long, step int, other int, hard boolean")).collect()}
    assert got == {(1, 1): ("success", 0), (1, 6): ("failed", 0), (1, 2): ("failed", 1), (1, 3): ("success", 1), (1, 4): ("skipped", 2), (1, 5): ("success", 3), (2, 1): ("refused", None), (2, 2): ("refused", None), (2, 3): ("refused", None), (3, 1): ("refused", None), (4, 1): ("success", 0)}


def test_risk_rows_equal_the_checks(spark):
    def rows(name):
        return sorted(tuple(r[c] for c in ("p_partkey", "chk", "severity", "what", "place")) for r in QUERIES[name](spark, SF).collect())

    assert rows("risk_rows") == rows("run_checks")
    with pytest.raises(Exception, match="key and a text"):
        spark.sql("SELECT * FROM tessera_risk_rows(TABLE(SELECT 1 AS a))").collect()


def test_many_cycles_beside_short_chains(spark):
    """Paths of cycles don't grow with the number of codes."""
    rows = spark.range(20_000).selectExpr("id AS code", "CASE WHEN id % 100 = 99 THEN id - 99 ELSE id + 1 END AS next", "1 AS since").union(spark.sql("SELECT 50000L, 50001L, 1"))
    got = lineage.chain_ends(rows).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"cycle": 20_000, "superseded": 1, "valid": 1}
