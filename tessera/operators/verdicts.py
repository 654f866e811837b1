"""Verdicts on labelled rows: gates of confidence, two labellings of a text compared, lists of entities, contents pages.

Defined results: rows without tags have no entity; a missing margin counts as 0, a missing score or agreement
fails its gate; spans without length touch nothing; blank or null sentences are no examples; null texts have no
lines and are never contents pages; rows of an equal key are negatives together, those of a null key never; spans of
a null key touch nothing, and entities of one have no examples; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .sampling import hash_order, numbered

#: Places of a text that spans are looked up by.
BIN = 64


def gates(rows: DataFrame, key: str, *, span_margin: float = 0.25, other_margin: float = 0.15, percentile: int = 0, negatives: float = 0.0, seed: str = "42") -> DataFrame:
    """key, min_margin and the gate that each row of (key, tags, margins, agrees, score) stops at: ``score`` below the
    percentile of all scores, ``differs`` for decodings that don't agree, ``span`` for an entity's token below
    ``span_margin``, ``other`` for an upper median of the other tokens below ``other_margin``. What passes is
    ``kept`` with entities; without, ``negative`` for as many rows in hash order as ``negatives`` allows for
    each kept one, and ``spare``. The cut and the quota are places among range partitions."""
    place = F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor(F.col("_n") * percentile / 100)))
    scores = numbered(rows.select(F.struct("score", key).alias("o")).where("o.score IS NOT NULL"), "o")
    cut = scores.crossJoin(F.broadcast(scores.agg(F.count("*").alias("_n")))).where(F.col("i") == place).select(F.col("o.score").alias("_cut"))  # one row each
    cells = F.transform(F.arrays_zip(F.coalesce("tags", F.array().cast("array<string>")).alias("tag"), "margins"), lambda x: F.struct(x["tag"].alias("tag"), F.coalesce(x["margins"], F.lit(0.0)).alias("m")))
    others = F.array_sort(F.transform(F.filter("_cells", lambda x: x["tag"] == "O"), lambda x: x["m"]))
    named = F.filter("_cells", lambda x: x["tag"].rlike("^[BIE]-"))
    low = F.exists("_named", lambda x: x["m"] < span_margin)
    own = rows.select(key, "agrees", "score", cells.alias("_cells")).withColumns({"_others": others, "_named": named})
    gate = (
        F.when(F.col("score").isNull() | F.col("_cut").isNull() | (F.col("score") < F.col("_cut")), "score").when(~F.coalesce("agrees", F.lit(False)), "differs").when(low, "span")
        .when(F.get("_others", F.floor(F.size("_others") / 2).cast("int")) < other_margin, "other").when(F.size("_named") > 0, "kept").otherwise("spare")
    )
    least = F.coalesce(F.array_min(F.transform("_cells", lambda x: x["m"])), F.lit(0.0))
    # written once: the quota, the spare rows and the result read three narrow columns
    judged = stored(own.join(F.broadcast(cut), how="left").select(key, gate.alias("gate"), F.round(least, 4).alias("min_margin")))
    quota = judged.where("gate = 'kept'").agg(F.floor(F.count("*") * negatives).alias("_most"))
    spare = numbered(judged.where("gate = 'spare'").select(key, F.struct(hash_order(F.col(key), seed).alias("h"), key).alias("o")).distinct(), "o")
    chosen = spare.crossJoin(F.broadcast(quota)).where(F.col("i") < F.col("_most")).select(key, F.lit(True).alias("_chosen"))
    return judged.join(chosen, key, "left").select(key, F.when(F.col("_chosen"), "negative").otherwise(F.col("gate")).alias("gate"), "min_margin")


def _binned(spans: DataFrame, key: str, mark: str) -> DataFrame:
    bins = F.explode(F.sequence(F.floor(F.col("s") / BIN), F.floor((F.col("e") - 1) / BIN)))
    return spans.where("e > s").select(key, bins.alias("_bin"), *(F.col(c).alias(f"{mark}_{c}") for c in ("type", "s", "e")))


def compare_labellings(rule: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """State of every different span (key, type, s, e) of a rule, and of those that a model adds: ``same``, ``fix``
    (type kept, bounds moved), ``type`` (only spans of other types there), ``removed``, ``added``. Spans meet by
    the 64 places of a text that they lie in, so that no text's spans are all paired."""
    rule, model = rule.select(key, "type", "s", "e").distinct(), model.select(key, "type", "s", "e").distinct()
    met = _binned(rule, key, "r").join(_binned(model, key, "m"), [key, "_bin"]).where("r_s < m_e AND m_s < r_e")
    alike, exact = F.col("r_type") == F.col("m_type"), (F.col("r_s") == F.col("m_s")) & (F.col("r_e") == F.col("m_e"))
    ruled = met.groupBy(key, *(F.col(f"r_{c}").alias(c) for c in ("type", "s", "e"))).agg(F.when(F.bool_or(alike & exact), "same").when(F.bool_or(alike), "fix").otherwise("type").alias("state"))
    seen = met.select(key, *(F.col(f"m_{c}").alias(c) for c in ("type", "s", "e"))).distinct()
    at = [key, "type", "s", "e"]
    own = rule.join(ruled, at, "left").select(*at, F.coalesce("state", F.lit("removed")).alias("state"))
    return own.unionByName(model.join(seen, at, "left_anti").withColumn("state", F.lit("added")))


def verdicts(states: DataFrame, key: str) -> DataFrame:
    """How many spans of each state a text has, and what becomes of it: ``drop`` where all of the rule's spans are
    removed and none is added, ``keep`` where both agree, else ``fix``."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    t = states.groupBy(key).agg(*(n(s) for s in ("same", "fix", "type", "removed", "added")))
    changed = F.col("fix") + F.col("type") + F.col("removed") + F.col("added")
    gone = (F.col("removed") > 0) & (F.col("removed") == changed) & (F.col("same") == 0)
    return t.select(key, "same", F.col("fix").alias("fixes"), "type", "removed", "added", F.when(gone, "drop").when(changed > 0, "fix").otherwise("keep").alias("verdict"))


def applied(rule: DataFrame, model: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """The spans that verdicts leave: the rule's where it is kept, the model's where it is mended."""
    side = lambda spans, verdict: spans.select(key, "type", "s", "e").distinct().join(judged.where(F.col("verdict") == verdict).select(key, "verdict"), key)
    return side(rule, "keep").unionByName(side(model, "fix"))


def entity_list(mentions: DataFrame, key: str) -> DataFrame:
    """Each entity (type, text) of a key, from mentions (key, type, text, layer, sent, pos, sentence): how often, the
    layer and sentence of its first mention, its first three different sentences, and its place: the most frequent
    first, then by type and text."""
    group = [key, "type", "text"]
    told = F.when(F.trim("sentence") != "", F.md5("sentence"))
    # one row for each entity and different sentence, then one for each entity: mentions are grouped once, and
    # where they come partitioned by key, nothing is shuffled
    at = F.min(F.struct("sent", "pos", "layer")).alias("_at")
    seen = mentions.groupBy(*group, told.alias("_h")).agg(F.count("*").alias("n"), at, F.any_value("sentence").alias("sentence"))
    seen = seen.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_h").isNull(), "_at")))
    three = F.array_sort(F.collect_list(F.when(F.col("_h").isNotNull() & (F.col("_rn") <= 3), F.struct("_rn", "sentence"))))  # three at most
    one = seen.groupBy(*group).agg(F.sum("n").alias("n"), F.min("_at").alias("_at"), F.transform(three, lambda x: x["sentence"]).alias("sentences"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "type", "text"))
    return one.select(*group, "n", F.col("_at.layer").alias("layer"), F.col("_at.sent").alias("first_sent"), "sentences", place.alias("place"))


def contents_page(text: Column) -> Column:
    """Whether a page of eight lines or more is a table of contents: leader dots on it, or more than 85 % short lines,
    six or more of them numbered, and an upper median length below 15."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    count = lambda test: F.size(F.filter(lines, test))
    short, number = count(lambda x: F.length(x) < 20), count(lambda x: x.rlike(r"^[0-9]{1,2}(\.[0-9]{1,2}){1,3}|\.{3,}"))
    median = F.get(F.array_sort(F.transform(lines, lambda x: F.length(x))), F.floor(n / 2).cast("int"))
    return F.coalesce((n >= 8) & (text.rlike(r"\.{3,}|…{2,}") | ((short / n > 0.85) & (number >= 6) & (median < 15))), F.lit(False))


def front_contents(pages: DataFrame, book: str, page: str, text: str = "text") -> DataFrame:
    """book, page, i (its place in the book) and whether it is dropped: contents pages are looked for among the first
    quarter of a book's pages, four at least. Pages are numbered by ranges, so a book may be of any size."""
    own = numbered(pages.select(book, page, contents_page(F.col(text)).alias("contents")), page, book)
    size = own.groupBy(F.col(book).alias("_book")).agg(F.count("*").alias("_n"))
    front = F.col("i") < F.greatest(F.lit(4), F.floor(F.col("_n") * 0.25))
    return own.join(size, F.col(book).eqNullSafe(F.col("_book"))).select(book, page, "i", (front & F.col("contents")).alias("dropped"))
