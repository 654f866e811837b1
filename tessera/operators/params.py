"""Numbers, limits and parameter triples of texts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units, longest first, and what each counts in.
UNITS = ("kN/m2", "kN/m", "kN", "MPa", "kPa", "Pa", "mm2", "m2", "m3", "mm", "cm", "km", "min", "kg", "m", "N", "t", "%", "°", "d", "h", "s")
BASE = {
    "mm": ("m", 0.001), "cm": ("m", 0.01), "m": ("m", 1.0), "km": ("m", 1000.0), "N": ("kN", 0.001), "kg": ("kN", 0.01), "t": ("kN", 10.0), "kN": ("kN", 1.0),
    "Pa": ("kPa", 0.001), "kPa": ("kPa", 1.0), "kN/m2": ("kPa", 1.0), "MPa": ("kPa", 1000.0), "kN/m": ("kN/m", 1.0),
}
#: Phrases of upper and of lower limits.
UPPER = ("不宜超过", "不应超过", "不得超过", "不得大于", "不应大于", "不宜大于", "不应高于", "不超过", "不大于", "小于等于")
LOWER = ("不宜小于", "不应小于", "不得小于", "不应低于", "不小于", "大于等于")
#: What a quantity's name says about its units; the first rule that fits holds.
DIMENSIONS = (
    ("线荷载", ("kN/m",)),
    ("总荷载|面荷载|压力|强度", ("kN/m2", "kPa", "MPa", "Pa")),
    ("重量|吊重|起重量|轴力|承载力|吨位|力", ("kN", "N", "t", "kg", "kN/m", "kN/m2", "kPa", "MPa", "Pa")),
    ("深度|高度|长度|厚度|间距|距离|跨度|桩长|半径|直径|宽度|埋深|孔深|水位|超灌|标高|落差|落深|步距|纵距|横距", ("m", "mm", "cm", "km")),
    ("偏差|位移|沉降|垂直度|平整度|水平度|误差|挠度|变形", ("m", "mm", "cm", "km", "%")),
    ("率|掺量|孔隙率|配筋率|坡度|含水量|坍落度|系数", ("%", "°")),
    ("角度|倾角", ("°", "%")),
    ("时间|天数|龄期|周期", ("d", "h", "min", "s")),
    ("面积", ("m2", "mm2")),
    ("方量|体积|用量", ("m3",)),
)
POSITIVE = "深度|高度|长度|厚度|间距|距离|跨度|桩长|埋深|孔深"
REACH = 10

UNIT_PATTERN = "(?:" + "|".join(UNITS) + ")"
LIMIT_PATTERN = "(" + "|".join(UPPER + LOWER) + r")\s*([0-9]+(?:\s*[.．]\s*[0-9]+)?)\s*(" + UNIT_PATTERN + ")"


def clean_numbers(text: Column) -> Column:
    """Zeros that were read as letters, and lost zeros, before a letter: "7. Om" is "7.0m"."""
    t = F.regexp_replace(text, r"([0-9])\s*[.．]\s*[Oo](\s*[a-zA-Z一-龥])", "$1.0$2")
    return F.regexp_replace(t, r"([0-9])\s*[.．]\s+([a-zA-Z一-龥])", "$1.0 $2")


def base_unit(unit: Column) -> Column:
    out = F.lit(None).cast("string")
    for u, (base, _) in BASE.items():
        out = F.when(unit == u, base).otherwise(out)
    return out


def in_base(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for u, (_, factor) in BASE.items():
        out = F.when(unit == u, value * F.lit(factor)).otherwise(out)
    return F.round(out, 6)


def limits(text: Column) -> Column:
    """Array of (op, direction, value, unit) of a clause's limits, in order."""
    t = clean_numbers(text)
    group = lambda k: F.regexp_extract_all(t, F.lit(LIMIT_PATTERN), F.lit(k))
    each = F.arrays_zip(group(1).alias("op"), group(2).alias("number"), group(3).alias("unit"))
    number = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s", ""), "．", ".").cast("double")
    return F.transform(each, lambda x: F.struct(x["op"].alias("op"), F.when(x["op"].isin(*UPPER), "upper").otherwise("lower").alias("direction"), number(x["number"]).alias("value"), x["unit"].alias("unit")))


def verdict(value: Column, unit: Column, limit: Column) -> Column:
    """2 where a limit of the same base unit is broken, 1 where it is kept, 0 where it can't be compared."""
    v, own = in_base(value, unit), in_base(limit["value"], limit["unit"])
    comparable = base_unit(unit) == base_unit(limit["unit"])
    bad = F.when(limit["direction"] == "upper", v > own).otherwise(v < own)
    return F.when(F.coalesce(comparable, F.lit(False)), F.when(bad, 2).otherwise(1)).otherwise(0)


def dimension_fits(metric: Column, unit: Column) -> Column:
    """Whether a unit fits a quantity's name; yes where no rule speaks of the name."""
    out = F.lit(True)
    for pattern, allowed in reversed(DIMENSIONS):
        out = F.when(metric.rlike(pattern), unit.isin(*allowed)).otherwise(out)
    return out


def value_after(text: Column, reach: int = REACH) -> Column:
    """(value, unit) of the nearest number with a unit at most ``reach`` characters into a text."""
    pattern = r"^.{0,%d}?(-?[0-9]+(?:\.[0-9]+)?)\s*(%s)(?:[^a-zA-Z]|$)" % (reach, UNIT_PATTERN)
    value = F.regexp_extract(text, "(?s)" + pattern, 1)
    return F.when(value != "", F.struct(value.cast("double").alias("value"), F.regexp_extract(text, "(?s)" + pattern, 2).alias("unit")))
