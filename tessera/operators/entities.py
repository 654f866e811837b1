"""Entities of rules in texts, and quantities bound to values, subjects and categories."""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .params import DIMENSIONS, POSITIVE, REACH

# Words of each kind of hazardous work, as entities and as a sentence's category; entity types whose
# words are closed lists, in order of preference; numbers of standards; units as texts have them.
ENTITY_WORDS = {
    "基坑工程": ("基坑工程", "基坑", "开挖", "围护", "支护", "降水", "地下连续墙", "灌注桩", "SMW"),
    "模板支撑": ("模板支撑", "支撑体系", "满堂支架", "高支模"),
    "起重吊装": ("起重吊装", "吊装", "起重机", "塔吊", "履带吊", "汽车吊", "起重"),
    "脚手架": ("脚手架", "扣件式", "盘扣", "悬挑架"),
    "拆除": ("拆除", "爆破"),
    "暗挖": ("暗挖", "盾构", "顶管", "矿山法"),
    "幕墙安装": ("幕墙",),
    "人工挖孔桩": ("人工挖孔", "挖孔桩"),
    "钢结构安装": ("钢结构", "钢构", "网架"),
}
CATEGORY_WORDS = {
    "模板支撑": ("模板", "支撑体系", "满堂支架", "满堂支撑", "高支模", "排架", "支模"),
    "脚手架": ("脚手架", "扣件式", "盘扣", "碗扣", "悬挑架", "落地架", "外架"),
    "基坑工程": ("基坑", "开挖", "围护", "支护", "降水", "地下连续墙", "地墙", "灌注桩", "SMW"),
    "起重吊装": ("吊装", "起重机", "塔吊", "履带吊", "汽车吊", "起重", "起吊"),
    "幕墙安装": ("幕墙",),
    "人工挖孔桩": ("人工挖孔", "挖孔桩"),
    "钢结构安装": ("钢结构", "钢构", "网架"),
    "拆除": ("拆除", "爆破"),
    "暗挖": ("暗挖", "盾构", "顶管", "矿山法"),
}
CLOSED = ("设备", "工程类型", "参数", "工序")
STANDARD = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{1,6}/?[A-Z]{0,4}\s*)?\d{2,4}[-—]\d{4}")
UNITS_AS_WRITTEN = r"kN/m2|kN/m²|kN/㎡|kN/m|kN|MPa|kPa|Pa|m2|m²|㎡|m3|m³|mm|cm|km|m|mm2|N|t|kg|%|°|d|h|min|s"
SUBJECTS = ("工程类型", "设备", "工序")
_SQUARE = {"kN/m2": ("kN/m²",), "m2": ("m²",), "m3": ("m³",)}

_ENTITY = "doc_id long, type string, start int, end int, term string"


def rule_entities(docs: DataFrame, lexicon: list[tuple[str, str]]) -> DataFrame:
    """doc_id, type, start, end, term of texts, read without blanks: numbers of standards, then of each kind of work the
    longest word whose first place is free, then the closed types' words, longest first. lexicon: (word, type). What
    is taken stays taken; places are those of the text as it is. A null text has none."""
    words = list(dict.fromkeys((re.sub("[ 　]", "", w), kind) for w, kind in lexicon if kind in CLOSED and w.strip(" 　")))
    words.sort(key=lambda x: (-len(x[0]), CLOSED.index(x[1])))

    def run(frames):
        finder = ahocorasick.Automaton()
        for word in {w for w, _ in words} | {w for ws in ENTITY_WORDS.values() for w in ws}:
            finder.add_word(word, word)
        finder.make_automaton()
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                places = [i for i, c in enumerate(text or "") if c not in " 　"]
                plain = "".join([text[i] for i in places])
                taken, met = bytearray(len(plain)), defaultdict(list)
                for last, word in finder.iter(plain):
                    met[word].append(last + 1 - len(word))
                free = lambda s, n: not any(taken[s : s + n])  # noqa: E731, B023

                def take(kind, s, n):
                    taken[s : s + n] = b"\1" * n  # noqa: B023
                    rows.append((doc, kind, places[s], places[s + n - 1] + 1, plain[s : s + n]))  # noqa: B023

                for m in STANDARD.finditer(plain):
                    take("规范编号", m.start(), len(m[0]))
                for own in ENTITY_WORDS.values():
                    fit = [w for w in own if met[w] and free(met[w][0], len(w))]
                    if fit:
                        best = max(fit, key=len)
                        take("危大类别", met[best][0], len(best))
                for word, kind in words:
                    for s in met[word]:
                        if free(s, len(word)):
                            take(kind, s, len(word))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _ENTITY.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, _ENTITY)


def category_of(text: Column) -> Column:
    """The kind of work whose longest word a text has; of equally long ones the first. Null if it has none."""
    words = sorted(((w, name) for name, ws in CATEGORY_WORDS.items() for w in ws), key=lambda x: -len(x[0]))
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), name) for w, name in words))


def _fits(metric: Column, unit: Column) -> Column:
    out = F.lit(True)
    for pattern, allowed in reversed(DIMENSIONS):
        out = F.when(metric.rlike(pattern), unit.isin(*allowed, *(s for u in allowed for s in _SQUARE.get(u, ())))).otherwise(out)
    return out


def with_neighbours(own: Column, before: Column, after: Column) -> Column:
    """A sentence's category: its own, or that of the sentence before, or after."""
    return F.coalesce(own, before, after)


def triples(entities: DataFrame, key: str) -> DataFrame:
    """key, sent, category, subject, metric, value, unit of every quantity (type 参数) of entities (key, sent, sentence,
    type, text, start, end) with a number and unit at most REACH characters behind it, in a unit that fits its name.
    The subject is the entity of the preferred type that ends last before it, "" if none. The category is the
    sentence's, or that of the sentence before, or after, if these have entities. Lengths aren't negative."""
    per = entities.groupBy(key, "sent").agg(F.any_value("sentence").alias("sentence"), F.collect_list(F.struct("type", "text", "start", "end")).alias("ents"))  # a sentence's entities
    w = Window.partitionBy(key).orderBy("sent")
    own = per.withColumn("own", category_of(F.col("sentence")))
    beside = lambda f, d: F.when(f("sent", 1).over(w) == F.col("sent") + d, f("own", 1).over(w))
    return bound(own.withColumn("category", with_neighbours(F.col("own"), beside(F.lag, -1), beside(F.lead, 1))), key)


def bound(sentences: DataFrame, key: str) -> DataFrame:
    """The triples of sentences (key, sent, sentence, category, ents: array of type, text, start, end), each from its row
    alone: where these are at hand, neither entities nor sentences are shuffled."""
    pattern = rf"(?is)^.{{0,{REACH}}}?(-?[0-9]+(?:\.[0-9]+)?)\s*({UNITS_AS_WRITTEN})(?![a-z])"

    def quantity(e: Column) -> Column:
        behind = F.substring(F.col("sentence"), e["end"] + 1, F.length("sentence"))
        return F.struct(e["text"].alias("text"), e["start"].alias("start"), F.regexp_extract(behind, pattern, 1).alias("number"), F.regexp_extract(behind, pattern, 2).alias("unit"))

    quantities = F.filter(F.transform(F.filter("ents", lambda e: e["type"] == "参数"), quantity), lambda p: p["number"] != "")
    each = sentences.select(key, "sent", "ents", "category", F.explode(quantities).alias("p")).where(_fits(F.col("p.text"), F.col("p.unit")))

    def last_before(kind: str) -> Column:
        before = F.filter("ents", lambda e: (e["type"] == kind) & (e["end"] <= F.col("p.start")))
        return F.get(F.sort_array(F.transform(before, lambda e: F.struct(e["end"].alias("end"), e["text"].alias("text"))), asc=False), F.lit(0))["text"]

    value = F.col("p.number").cast("double")
    value = F.when(F.col("p.text").rlike(POSITIVE), F.abs(value)).otherwise(value)
    subject = F.coalesce(*(last_before(k) for k in SUBJECTS), F.lit(""))
    return each.select(key, "sent", "category", subject.alias("subject"), F.col("p.text").alias("metric"), value.alias("value"), F.col("p.unit").alias("unit"))


def risk_scores(golden: DataFrame, found: DataFrame) -> DataFrame:
    """scope (all, check, severity), value, golden, found, hit, missed, extra, fnr, fpr, traceable. golden(case, item,
    check, severity, frag) is hit if some found(case, check, severity, title, detail, basis) of its case (and of its
    check or severity, for these scopes) has the fragment in it, whatever case and blanks. extra: found ones beyond
    the hits, at least 0. traceable: the share of found ones with a basis. Rates without a denominator are null."""
    plain = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    said = found.select("case", F.col("check").alias("c2"), F.upper("severity").alias("s2"), plain(F.concat_ws(" ", "check", "severity", "title", "detail")).alias("said"))
    asked = golden.select("case", "item", "check", F.upper("severity").alias("severity"), plain(F.col("frag")).alias("frag"))
    met = asked.join(said, "case", "left").withColumn("has", F.coalesce(F.contains("said", "frag"), F.lit(False)))
    hits = met.groupBy("case", "item", "check", "severity").agg(F.bool_or("has").alias("all"), F.bool_or(F.col("has") & (F.col("c2") == F.col("check"))).alias("by_check"), F.bool_or(F.col("has") & (F.col("s2") == F.col("severity"))).alias("by_severity"))
    scopes = lambda *flags: F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), v.alias("value"), f.alias("flag")) for s, v, f in flags)))
    yes = F.lit(True)
    g = hits.select(scopes(("all", F.lit(""), F.col("all")), ("check", F.col("check"), F.col("by_check")), ("severity", F.col("severity"), F.col("by_severity"))).alias("x"))
    g = g.groupBy("x.scope", "x.value").agg(F.count("*").alias("golden"), F.count_if("x.flag").alias("hit"))
    has_basis = F.trim(F.coalesce("basis", F.lit(""))) != ""
    f = found.select(has_basis.alias("based"), scopes(("all", F.lit(""), yes), ("check", F.col("check"), yes), ("severity", F.upper("severity"), yes)).alias("x"))
    f = f.groupBy("x.scope", "x.value").agg(F.count("*").alias("found"), F.count_if("based").alias("based"))
    j = g.join(f, ["scope", "value"], "full").fillna(0, ["golden", "hit", "found", "based"])
    extra = F.greatest(F.lit(0), F.col("found") - F.col("hit"))
    rate = lambda a, b: F.round(a / F.nullif(F.col(b), F.lit(0)), 4)
    return j.select("scope", "value", "golden", "found", "hit", (F.col("golden") - F.col("hit")).alias("missed"), extra.alias("extra"), rate(F.col("golden") - F.col("hit"), "golden").alias("fnr"), rate(extra, "found").alias("fpr"), rate(F.col("based"), "found").alias("traceable"))
