"""Text cleaning as Column functions. Character classes are spelled out, so that they mean the same
in Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\x0B\f\r]+"


def clean_text(text: Column) -> Column:
    """Full-width forms to plain ones, blanks to one, joined section numbers, at most one empty line."""
    t = F.translate(text, "　，；：（）！？．", " ,;:()!?.")
    t = F.regexp_replace(t, BLANK, " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"([0-9]) ?\. ?([0-9])", "$1.$2")
    t = F.regexp_replace(t, r"[-=_*~]{4,}", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def garbage_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits, white space nor common marks; 1 for an empty text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s.,;:!?'\"()%/-]", ""))
    return F.when(F.length(text) == 0, 1.0).otherwise(1 - kept / F.length(text))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def collapse(text: Column, short: int = 40) -> Column:
    """Joins the non-blank lines: without anything between if all are short, else by line ends."""
    kept = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.forall(kept, lambda x: F.length(x) < short), F.array_join(kept, "")).otherwise(F.array_join(kept, "\n"))


def code_letters(code: Column) -> Column:
    return F.upper(F.regexp_extract(code, r"^([A-Za-z]+)", 1))


def code_number(code: Column) -> Column:
    return F.regexp_extract(code, r"([0-9]+)", 1).cast("int")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters or digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def char_ngrams(text: Column, stop: str) -> Column:
    """Unigrams but for stop characters, and all bigrams, of each run of ideographs; a run of one is
    itself unless it is a stop character."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([一-鿿]+)"), F.lit(1))
    unigrams = lambda r: F.filter(F.split(r, ""), lambda c: (c != "") & ~F.lit(stop).contains(c))
    bigrams = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, lambda r: F.concat(unigrams(r), bigrams(r))))


def chinese_number(text: Column) -> Column:
    """Value of a numeral of 零 to 九, 十, 百, 千; null for anything else."""
    digits = "零一二三四五六七八九"
    step = lambda acc, c: F.when(F.lit("十百千").contains(c), F.struct(
        (acc["total"] + F.greatest(acc["digit"], F.lit(1)) * F.when(c == "十", 10).when(c == "百", 100).otherwise(1000)).cast("int").alias("total"), F.lit(0).alias("digit"),
    )).otherwise(F.struct(acc["total"].alias("total"), (F.position(c, F.lit(digits)) - 1).cast("int").alias("digit")))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.aggregate(chars, zero, step, lambda acc: acc["total"] + acc["digit"])
    return F.when(text.rlike("^[零一二三四五六七八九十百千]+$"), value)


def pretty_code(no: Column) -> Column:
    """A standard's number as it is printed: JGJ-T46-2024 is JGJ/T 46-2024, GB55034-2022 is GB 55034-2022."""
    rest = lambda n: F.regexp_replace(F.substring(no, n + 1, 1000), "^-+", "")
    plain = F.regexp_replace(no, r"^([A-Za-z]+)([0-9].*)$", "$1 $2")
    return F.when(no.startswith("JGJ-T"), F.concat(F.lit("JGJ/T "), rest(5))).when(no.startswith("DG-TJ"), F.concat(F.lit("DG/TJ "), rest(5))).otherwise(plain)


def code_numbers(code: Column) -> Column:
    """All numbers of a code, in order."""
    return F.transform(F.regexp_extract_all(code, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))


def loose_json(raw: Column) -> Column:
    """A JSON value in a text, as a variant: a fenced block, else the whole, else from the first brace
    to the last; null if none can be read."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(fenced), F.try_parse_json(raw), F.try_parse_json(braces))


#: Fixed values of the score of a clause: phrases that set a threshold, units behind a number, set phrases.
_THRESHOLD = "不应(?:小于|大于|少于|超过|低于|高于)|不得(?:小于|大于|少于|超过|低于|高于)|不宜(?:小于|大于|少于|超过|低于|高于)|应(?:控制|小于|大于|按).{0,4}在|至少|最多|不应低于|不应少于"
_QUANTITY = "[0-9]+(?:\\.[0-9]+)?\\s*(?:mm|cm|dm|km|m2|m3|kN|kPa|MPa|N·m|kg|t|%|℃|min|h|d|s|倍|层|根|人|个|次|遍|道|级|度|米|厘米|毫米|千帕|兆帕|吨|小时|分钟)"
_SET_PHRASES = ("制定本规范", "制定本标准", "制定本规程", "必须执行本规范", "由相关责任主体判定", "除应符合本规范外", "除应执行本", "尚应符合国家现行有关标准")
_GENERAL = "^(?:[12]\\.0\\.[0-9]|[0-9]\\.0\\.1$)"


def clause_score(text: Column, number: Column) -> Column:
    """How much a clause tells: 3 for a threshold, 2 for a quantity, 1 for 60 to 320 characters; less 1 for a long
    Latin word, 6 for a set phrase, 2 for the number of a general clause. A null text has 0 of its own."""
    has = lambda c, p: F.coalesce(c.rlike(p), F.lit(False)).cast("int")
    fits = F.coalesce(F.length(text).between(60, 320), F.lit(False)).cast("int")
    return 3 * has(text, _THRESHOLD) + 2 * has(text, _QUANTITY) + fits - has(text, "[A-Za-z]{5,}") - 6 * has(text, "|".join(_SET_PHRASES)) - 2 * has(number, _GENERAL)
