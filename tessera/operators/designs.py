"""Designs of samples and test cases: tiers with floors and caps, combinations and grids by their number."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_order, numbered

#: Shares of a tiered sample, and the largest share of appendices in its first tier.
TAIL, FUZZY, APPENDIX = 0.4, 0.3, 0.4
#: Values of a group at most, for pairs and for triples. Groups have multiples of 8 values: Parquet packs values by 8,
#: so what repeats then also repeats as bytes.
_GROUP = {2: 1024, 3: 128}


def tier_allocation(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many rows each class gives, from its count. The tail takes appendices up to their cap, all floor rows (even
    if they are more than its quota), then cold and plain rows; what it lacks goes to the fuzzy tier, what that lacks
    to pairs, and what they lack to plain rows again."""
    c = {name: counts.get(name, 0) for name in ("appendix", "floor", "cold", "plain", "fuzzy", "pair")}
    tail, fuzzy = int(TAIL * total), int(FUZZY * total)
    out = {"appendix": min(c["appendix"], int(APPENDIX * tail)), "floor": c["floor"]}
    room = max(0, tail - sum(out.values()))
    for name in ("cold", "plain"):
        out[name] = min(c[name], room)
        room -= out[name]
    for name, quota in (("fuzzy", fuzzy), ("pair", total - tail - fuzzy)):
        out[name] = min(c[name], quota + room)
        room += quota - out[name]
    out["plain"] += min(c["plain"] - out["plain"], room)
    return out


def tiered(rows: DataFrame, tier: str, key: str, seed: str, allocate: Callable[[dict[str, int]], dict[str, int]]) -> DataFrame:
    """The first rows of each class in hash order, as many as ``allocate`` gives it from the classes' counts. One
    ranking pass by ranges, so that no class has to fit into a task. Rows without a class are left out."""
    known = rows.where(F.col(tier).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(tier).count().collect()}  # a row for each class
    wanted = allocate(counts)
    placed = numbered(known.withColumn("_hash", hash_order(F.col(key), seed)), "_hash", tier)
    quota = F.lit(0)
    for name, n in wanted.items():
        quota = F.when(F.col(tier) == name, n).otherwise(quota)
    return placed.where(F.col("i") < quota).drop("_hash", "i")


def pair_of(number: Column) -> tuple[Column, Column]:
    """(a, b), a < b: the pair with this number, counted by b and then a."""
    guess = F.floor((1 + F.sqrt(1 + 8 * number.cast("double"))) / 2).cast("long")
    count = lambda b: (b * (b - 1) / 2).cast("long")
    b = F.when(count(guess) > number, guess - 1).when(count(guess + 1) <= number, guess + 1).otherwise(guess)
    return number - count(b), b


def triple_of(number: Column) -> tuple[Column, Column, Column]:
    """(a, b, c), a < b < c: the triple with this number, counted by c, then b, then a."""
    count = lambda c: (c * (c - 1) / 2 * (c - 2) / 3).cast("long")
    guess = F.floor(F.cbrt(6 * number.cast("double"))).cast("long") + 1
    c = F.when(count(guess + 1) <= number, guess + 1).when(count(guess) <= number, guess).otherwise(guess - 1)
    a, b = pair_of(number - count(c))
    return a, b, c


def combinations_of(values: DataFrame, column: str, size: int) -> DataFrame:
    """All combinations of two or three different values: columns first, second (and third), in order. Values are
    grouped by place, and each combination of groups is a cell of bounded size with a number of its own. A value goes
    to the cells of its group, and combinations are made inside cells alone: none is shuffled, cells spread over all
    tasks, and files are small, as a task's rows repeat few values. Nulls are left out."""
    if size not in (2, 3):
        raise ValueError("combinations of two or three")
    names, spark = ("first", "second", "third")[:size], values.sparkSession
    own = numbered(values.where(F.col(column).isNotNull()).select(column).distinct(), column)
    n, parallel = own.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = math.ceil((4 * parallel * math.factorial(size)) ** (1 / size))  # groups that make four cells for each task
    width = 8 * math.ceil(max(16, min(_GROUP[size], n / spread)) / 8)
    groups = max(1, -(-n // width))
    total = math.comb(groups + size - 1, size)
    tasks = max(parallel, total // 64)
    # groups may repeat in a cell: those of a cell are a combination of different numbers, less 0, 1 and 2
    numbers = pair_of(F.col("id")) if size == 2 else triple_of(F.col("id"))
    cells = spark.range(total).select(F.col("id").alias("cell"), *((g - k).alias(name) for k, (g, name) in enumerate(zip(numbers, names, strict=True))))
    grouped = own.select(F.floor(F.col("i") / width).cast("long").alias("group"), column)
    out = None
    for k, name in enumerate(names):
        side = cells.select("cell", F.col(name).alias("group")).join(grouped, "group").select("cell", F.col(column).alias(name)).repartition(tasks, "cell")
        out = side if out is None else out.join(side, "cell").where(F.col(names[k - 1]) < F.col(name))
    return out.select(*names)


def grid_of(rows: DataFrame, lo: Column, hi: Column, points: int, choices: dict[str, list[str]]) -> DataFrame:
    """rows with value (``points`` interpolated from lo to hi) and a column for each list of choices, in all
    combinations: a row's cases are numbered, and a number's digits in mixed radix say which one it is."""
    sizes = [points, *map(len, choices.values())]
    total = 1
    for s in sizes:
        total *= s
    cases = rows.withColumn("_case", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    digits, base = [], 1
    for s in sizes:
        digits.append(F.floor(F.col("_case") / base).cast("int") % s)
        base *= s
    value = F.round(lo + (hi - lo) * digits[0] / (points - 1), 4)
    named = {name: F.element_at(F.array(*map(F.lit, words)), d + 1) for (name, words), d in zip(choices.items(), digits[1:], strict=True)}
    return cases.withColumns({"value": value, **named}).drop("_case")
