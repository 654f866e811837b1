"""Graded rewards of answers: form, steps, sources and result, each from 0 to 1, all from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What doesn't count in comparisons, numerals, words that link steps, numbers of standards in free
# text, and the parts' weights.
_IGNORED = r"(?U)[\s，。；、：:（）()【】\[\]\"'“”‘’/\\·—–-]+"
_NUMERALS, _DIGITS = "〇零一二两三四五六七八九", "001223456789"
_LINKS = ("因此", "综上", "所以", "因为", "由于", "依据", "故", "则", "即", "对照", "比对", "换算", "代入", "据此", "由此")
_CODES = r"(?<![0-9A-Za-z])(?:(?:GB|JGJ|JG|DGJ|DG|T|CJJ|CECS)[/\s]*T?[\s]*-?\s*[\d]{2,4}(?:-[\d]{2,4})?|建办质[〔\[]?\d{4}[〕\]]?\d{1,2}号|住建部令第37号|建质[〔\[]?\d{4}[〕\]]?\d{1,2}号|GB550\d{2}[-—]\d{4})"
_WIDE, _NARROW = "０１２３４５６７８９．－", "0123456789.-"
WEIGHTS = {"format": 0.15, "steps": 0.20, "basis": 0.25, "answer": 0.40}



def numerals_in_text(text: Column) -> Column:
    """A text with its numerals as digits: 第二十三条 is 第23条. A stretch of at most four of 〇 to 九 and 十 is read
    as one number; without 十 digit by digit."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[{_NUMERALS}十]{{1,4}}|[^{_NUMERALS}十]+"), F.lit(0))

    def read(piece: Column) -> Column:
        ten = F.instr(piece, "十")
        digit = lambda c, other: F.when((F.length(c) == 1) & (c != "十"), F.translate(c, _NUMERALS, _DIGITS).try_cast("int")).otherwise(other)
        before, after = F.substring(piece, F.lit(1), ten - 1), F.substring(piece, ten + 1, F.lit(4))
        number = (digit(before, 1) * 10 + digit(after, 0)).cast("string")
        return F.when(~piece.rlike(rf"^[{_NUMERALS}十]"), piece).when(ten > 0, number).otherwise(F.translate(piece, _NUMERALS, _DIGITS))

    return F.array_join(F.transform(pieces, read), "")


def comparable(text: Column) -> Column:
    """A text as it is compared: without blanks and marks, in small letters, numerals as digits."""
    return numerals_in_text(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _IGNORED, "")))


def first_number(text: Column) -> Column:
    return F.regexp_extract(F.translate(F.coalesce(text, F.lit("")), _WIDE, _NARROW), r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


def _all(column: str) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), comparable)


def _has(text: Column, part: Column, least: int = 1) -> Column:
    return (F.length(part) >= least) & F.contains(text, part)


def _share(hits: Column, of: Column) -> Column:
    return F.size(hits) / F.greatest(F.size(of), F.lit(1))


def _read(answers: DataFrame) -> DataFrame:
    """The answer as JSON: the whole if it is an object with all fields, else from the first brace to the last."""
    field = lambda v, name, kind="string": F.try_variant_get(F.col(v), f"$.{name}", kind)
    full = lambda v: field(v, "conclusion").isNotNull() & field(v, "basis").isNotNull() & field(v, "explanation").isNotNull()
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    text = F.coalesce("response", F.lit(""))
    rows = answers.withColumns({"_whole": F.try_parse_json(text), "_part": F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))})
    rows = rows.withColumns({"_object": is_object("_whole"), "_full": is_object("_whole") & full("_whole")})
    rows = rows.withColumn("_json", F.when(F.col("_full"), F.col("_whole")).when(is_object("_part") & full("_part"), F.col("_part")))
    steps = F.filter(field("_json", "cot_steps", "array<string>"), lambda s: F.trim(s) != "")
    stepless = F.coalesce(field("_whole", "cot_steps"), F.lit("")).isin("", "[]", "{}", "0", "false")
    return rows.withColumns(
        {
            "_steps": F.coalesce(steps, F.array().cast("array<string>")),
            "_stepless": stepless,
            "_conclusion": F.when(F.col("_json").isNotNull(), field("_json", "conclusion")).otherwise(text),
            "_said": F.col("_whole").isNotNull() & F.col("_object"),
            "_basis": F.when(F.col("_json").isNotNull(), F.coalesce(field("_json", "basis", "array<string>"), F.array().cast("array<string>"))).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(_CODES), F.lit(0)))),
        }
    )


def _form(text: Column) -> Column:
    """A ladder: all fields and a known conclusion, all fields, an object, an object inside a text, a text."""
    known = (F.size(F.coalesce("options", F.array().cast("array<string>"))) == 0) | F.array_contains("options", F.col("_conclusion"))
    lacks = F.coalesce("require_steps", F.lit(True)) & F.col("_stepless")
    return (
        F.when(F.trim(F.regexp_replace(text, r"(?U)\s", "")) == "", 0.0)
        .when(F.col("_full"), F.when(~lacks & known, 1.0).otherwise(0.8))
        .when(F.col("_object"), 0.6)
        .when(text.rlike(r"(?s)\{.*\}"), 0.4)
        .otherwise(0.2)
    )


def _chain(rows: DataFrame) -> Column:
    """Steps: that there are some, several, linked ones, ones that name the result or a source, ones of the model chain."""
    joined = F.array_join("_steps", "")
    said, gold = comparable(joined), _all("golden_steps")
    found = _share(F.filter(gold, lambda g: _has(said, g, 4)), gold)
    linked = F.exists(F.array(*map(F.lit, _LINKS)), lambda w: F.contains(joined, w))
    value = F.substring(comparable(F.col("expect")), 1, 3)
    named = _has(said, value) | F.exists(_all("golden_basis"), lambda g: _has(said, g, 3))
    points = 0.3 + F.when(F.size("_steps") >= 2, 0.2).otherwise(0.0) + F.when(linked, 0.2).otherwise(0.0) + F.when(named, 0.3).otherwise(0.0) + 0.15 * found
    return F.when(F.size("_steps") == 0, 0.0).when(found >= 1.0, 1.0).otherwise(F.least(F.lit(1.0), points))


def _sources() -> Column:
    """The share of the wanted sources that are named, less 0.3 of the share of named ones that nobody wants."""
    filled = lambda a: F.filter(a, lambda x: x != "")
    gold, named = filled(_all("golden_basis")), filled(_all("_basis"))
    fits = lambda g, n: (g == n) | ((F.length(g) >= 3) & (F.contains(n, g) | F.contains(g, n)))
    hit = F.filter(gold, lambda g: F.exists(named, lambda n: fits(g, n)))
    true = F.filter(named, lambda n: F.exists(gold, lambda g: fits(g, n)))
    score = _share(hit, gold) - 0.3 * (1 - F.when(F.size(named) == 0, 1.0).otherwise(_share(true, named)))
    return F.when(F.size(gold) == 0, F.when(F.size(named) > 0, 0.5).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _result() -> Column:
    """By mode: the expected value or an alias in the conclusion, the share of expected items, or closeness."""
    said, wanted, alias = comparable(F.col("_conclusion")), comparable(F.col("expect")), _all("alias")
    by_alias = F.exists(alias, lambda a: _has(said, a))
    items = F.filter(F.transform(F.split("expect", "[,，;；、]"), F.trim), lambda x: x != "")
    met = F.filter(F.transform(items, comparable), lambda x: (x != "") & (F.contains(said, x) | by_alias))
    got, exact = first_number(F.col("_conclusion")), first_number(F.col("expect"))
    allowed = F.coalesce(F.nullif("tolerance", F.lit(0.0)), F.greatest(0.1 * F.abs(exact), F.lit(0.5)))
    closeness = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(got - exact) / allowed), F.lit(0.0))
    plain = F.when(_has(said, wanted) | by_alias, 1.0).otherwise(0.0)
    return F.when(F.col("mode") == "set_match", F.when(F.size(items) == 0, 1.0).otherwise(_share(met, items))).when(F.col("mode") == "numeric", closeness).when(F.col("mode").isin("exact", "boolean", "contains"), plain).otherwise(0.0)


def rewarded(answers: DataFrame) -> DataFrame:
    """answers with format, steps, basis, answer and their weighted total. Columns read: response (JSON with
    cot_steps, conclusion, basis, explanation, or anything else), mode, expect, alias, options, golden_basis,
    golden_steps, tolerance, require_steps. A null response counts as empty, a null list as an empty one."""
    rows = _read(answers).withColumn("expect", F.trim(F.coalesce("expect", F.lit(""))))
    parts = {"format": _form(F.coalesce("response", F.lit(""))), "steps": _chain(rows), "basis": _sources(), "answer": _result()}
    scored = rows.withColumns(parts)
    total = sum((w * F.col(name) for name, w in WEIGHTS.items()), F.lit(0.0))
    kept = [c for c in answers.columns if c != "expect"]
    return scored.select(*kept, *(F.round(p, 4).alias(p) for p in parts), F.round(total, 4).alias("total"))
