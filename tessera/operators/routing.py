"""Questions taken apart and routed by words, and candidates and label conflicts by rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a question's dimensions, of kinds of work, equipment and objects, and of each intent; what
# each intent sends where.
DIMENSIONS = {"risks": ("风险", "危险源", "隐患"), "plan": ("方案编制", "编制内容", "编制要求", "编制"), "controls": ("管控", "控制措施", "预防措施", "清单"), "acceptance": ("验收", "检查节点", "验评")}
WORK = {
    "基坑工程": ("基坑", "开挖", "支护", "围护"),
    "模板支撑": ("模板", "支撑体系", "高支模", "满堂架"),
    "起重吊装": ("吊装", "起重", "塔吊", "汽车吊", "履带吊", "龙门吊", "起重机"),
    "脚手架": ("脚手架", "悬挑架", "爬架", "附着式升降"),
    "拆除": ("拆除", "爆破"),
    "暗挖": ("暗挖", "盾构", "顶管", "隧道"),
    "幕墙安装": ("幕墙",),
    "人工挖孔桩": ("人工挖孔", "挖孔桩"),
    "钢结构安装": ("钢结构安装", "钢构安装", "网架"),
}
EQUIPMENT = ("汽车吊", "履带吊", "塔吊", "塔式起重机", "龙门吊", "轮胎吊", "起重机")
OBJECTS = ("钢栈桥", "栈桥", "钢梁", "钢构件", "预制梁", "预制构件", "网架", "设备")
CAPACITY = r"([0-9]+(?:\.[0-9]+)?)\s*([tT]|吨|[kK][nN]|千牛)"
LIFTING, SUPER_KN, KN_PER_TON = "起重吊装", 100.0, 9.8
INTENTS = {
    "hazard_level": ("超规模", "超过一定规模", "专家论证", "论证", "危大级别", "是否属于危大", "算危大", "算不算危大", "属于危大吗", "危大吗", "分档", "需不需要论证"),
    "review": ("全面", "整体", "全部", "所有", "全量", "审查方案", "帮我审查", "合规自查", "检查方案", "综合"),
    "basis": ("废止", "失效", "编制依据", "引用", "标准号", "规范编号", "版本"),
    "elements": ("缺项", "缺少", "缺失", "九章", "编制要素", "要素", "齐全", "完整"),
    "technical": ("施工工艺", "工艺", "工序", "做法", "参数", "材料", "措施", "符合", "不符合", "强条", "合规", "安全技术", "构造"),
}
SENT_TO = {
    "hazard_level": ("review", "hazard_level"),
    "technical": ("review", "technical"),
    "basis": ("review", "basis"),
    "elements": ("review", "elements,content"),
    "qa": ("qa", ""),
    "review": ("review", "hazard_level,technical,basis,elements,content"),
    "structured": ("qa", ""),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def work_words() -> list[tuple[str, str]]:
    """(word, kind of work), the longest first; of equally long ones in the order of the table."""
    return sorted(((w, kind) for kind, words in WORK.items() for w in words), key=lambda x: -len(x[0]))


def taken_apart(question: Column) -> dict[str, Column]:
    """What a question asks about: category (the kind of work of its longest word), subject, equipment, capacity and
    unit, its dimensions as flags (all of them, if it names a kind of work and no dimension), whether a lift is beyond
    the super scale, and whether it is structured: two dimensions, or a kind of work and one."""
    q = F.trim(F.coalesce(question, F.lit("")))
    first = lambda words: F.coalesce(*(F.when(F.contains(q, F.lit(w)), w) for w in words))
    category = F.coalesce(*(F.when(F.contains(q, F.lit(w)), kind) for w, kind in work_words()))
    asked = {name: has_any(q, words) for name, words in DIMENSIONS.items()}
    none = ~reduce(lambda a, b: a | b, asked.values())
    dims = {name: a | (none & category.isNotNull()) for name, a in asked.items()}
    number = F.regexp_extract(q, CAPACITY, 1)
    capacity, unit = F.when(number != "", number.cast("double")), F.when(number != "", F.regexp_extract(q, CAPACITY, 2))
    force = F.when(unit.isin("t", "吨"), capacity * KN_PER_TON).otherwise(capacity)
    count = reduce(lambda a, b: a + b, (d.cast("int") for d in dims.values()))
    return {
        "category": category,
        "subject": first(OBJECTS),
        "equipment": first(EQUIPMENT),
        "capacity": capacity,
        "unit": unit,
        **dims,
        "super_scale": F.coalesce((category == LIFTING) & (force >= SUPER_KN), F.lit(False)),
        "structured": (count >= 2) | (category.isNotNull() & (count >= 1)),
    }


def intent(question: Column, has_plan: Column) -> dict[str, Column]:
    """intent, agents and checks of a question. Words about the level of hazard go first, then structured questions,
    then the other intents in order; with a plan, an empty question is a review and any other a technical one. Without
    a plan only structured questions keep their way, the rest are answered."""
    q = F.trim(F.coalesce(question, F.lit("")))
    hit = {name: has_any(q, words) for name, words in INTENTS.items()}
    by_words = F.when(q == "", "review").when(hit["hazard_level"], "hazard_level").when(taken_apart(question)["structured"], "structured")
    for name in ("review", "basis", "elements", "technical"):
        by_words = by_words.when(hit[name], name)
    by_words = by_words.otherwise("technical")
    found = F.when(has_plan | (by_words == "structured"), by_words).otherwise("qa")
    pick = lambda k: reduce(lambda c, x: c.when(found == x[0], x[1][k]), list(SENT_TO.items())[1:], F.when(found == next(iter(SENT_TO)), SENT_TO[next(iter(SENT_TO))][k]))
    return {"intent": found, "agents": pick(0), "checks": pick(1)}


def label_conflicts(rule: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """key, retyped, removed, fixed, added, verdict of two labellings (key, type, s, e) of a text. A rule label without a
    model label of its type over it is retyped (if one of another type is there) or removed; one that is there at
    another place is fixed; model labels over no rule label are added. drop: all rule labels are removed and none
    added; keep: nothing differs; else fix. Repeated labels count once."""
    r, m = rule.select(key, "type", "s", "e").distinct(), model.select(key, F.col("type").alias("t2"), F.col("s").alias("s2"), F.col("e").alias("e2")).distinct()
    over = F.coalesce((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")), F.lit(False))
    same_type = over & (F.col("type") == F.col("t2"))
    exact = same_type & (F.col("s") == F.col("s2")) & (F.col("e") == F.col("e2"))
    own = r.join(m, key, "left").groupBy(key, "type", "s", "e").agg(F.bool_or(over).alias("o"), F.bool_or(same_type).alias("t"), F.bool_or(exact).alias("x"))
    count = lambda c, name: F.count_if(c).alias(name)
    left = own.groupBy(key).agg(F.count("*").alias("n"), count(~F.col("t") & F.col("o"), "retyped"), count(~F.col("o"), "removed"), count(F.col("t") & ~F.col("x"), "fixed"))
    free = m.join(r, key, "left").groupBy(key, "t2", "s2", "e2").agg(F.bool_or(over).alias("o")).groupBy(key).agg(count(~F.col("o"), "added"))
    j = left.join(free, key, "full").fillna(0, ["n", "retyped", "removed", "fixed", "added"])
    verdict = F.when((F.col("removed") == F.col("n")) & (F.col("n") > 0) & (F.col("added") == 0), "drop").when(F.col("retyped") + F.col("removed") + F.col("fixed") + F.col("added") > 0, "fix").otherwise("keep")
    return j.select(key, "retyped", "removed", "fixed", "added", verdict.alias("verdict"))
