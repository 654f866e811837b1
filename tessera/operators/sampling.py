"""Splits, quotas and samples by hash, and percentiles by place. All are the same in every run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def hash_number(value: Column) -> Column:
    """The first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def hash_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed)))


def hash_split(value: Column, shares: dict[str, int]) -> Column:
    """A name for each row; shares are percentages that add up to 100."""
    at, upto, out = hash_number(value) % 100, 0, None
    for name, share in shares.items():
        upto += share
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out


def quota(rows: DataFrame, strata: list[str], key: str, quota: Column, seed: str, most: int) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order. ``most``: no quota is larger, so that
    tasks pass on no more rows of a stratum than that."""
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(F.col(key), seed), key))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= most).where(F.col("_rn") <= quota).drop("_rn")


def round_robin(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """rn: a row's place in its group, for the first ``most``; sr: the group's place by size."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("sr", F.row_number().over(Window.orderBy(F.desc("_n"), group)))  # one row for each group
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= most)
    return placed.join(sizes.drop("_n"), group)


def percentile_places(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at given places (0-based, of n) of each group's order. Equal values are counted first,
    so that the ordered pass sees each distinct value once."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy(value)
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(group, value, upto.alias("_upto")).join(counts.groupBy(group).agg(F.sum("_c").alias("_n")), group)
    return placed.groupBy(group).agg(*(F.min(F.when(F.col("_upto") > f(F.col("_n")), F.col(value))).alias(name) for name, f in places.items()))


def bootstrap_f1(counts: DataFrame, key: str, *, draws: int = 500, seed: int = 0) -> DataFrame:
    """lo, hi, f1 from counts (key, tp, fp, fn), one row for each sentence: a row's weight in each draw
    is a Poisson number of mean 1, from its hash. Tasks sum their rows for all draws at once; draw 0
    weighs each row once."""
    steps = np.array([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582])  # of the Poisson distribution

    def sums(batches):
        total = np.zeros((draws + 1, 3))
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.float64) for c in ("tp", "fp", "fn")], axis=1)
            total[0] += rows.sum(axis=0)
            h = batch.column("h").to_numpy().view(np.uint64)
            for k in range(draws):
                with np.errstate(over="ignore"):
                    x = (h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                total[k + 1] += np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), side="right") @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1)), *(pa.array(total[:, c]) for c in range(3))], names=["draw", "tp", "fp", "fn"])

    own = counts.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), "tp", "fp", "fn")
    per = own.mapInArrow(sums, "draw long, tp double, fp double, fn double").groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    f1 = per.select("draw", (2 * F.col("tp") / F.greatest(F.lit(1.0), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f"))  # draws + 1 rows
    placed = f1.where("draw > 0").agg(F.array_sort(F.collect_list("f")).alias("v"))
    at = lambda k: F.round(F.get("v", F.lit(max(0, k))), 6)
    return placed.crossJoin(f1.where("draw = 0").select("f")).select(at(int(0.025 * draws)).alias("lo"), at(int(0.975 * draws) - 1).alias("hi"), F.round("f", 6).alias("f1"))


def numbered(rows: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """rows with i, their places (from 0) in the order of a column, in all or within a group. Each
    partition of a range partitioning numbers its own rows; only counts of them are summed, so that no
    group has to fit into a task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [order] if group is None else [group, order]
    keys = [] if group is None else [group]
    placed = stored(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))  # a row for each partition and group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = counts.select(F.col("_part").alias("_at"), *(F.col(k).alias("_key") for k in keys), "_first", before.alias("_before"))
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same &= placed[k].eqNullSafe(own["_key"])
    return placed.join(own, same).withColumn("i", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_at", "_key", "_row", "_before", "_first")


def zipped(a: DataFrame, b: DataFrame, place: str, value: str) -> DataFrame:
    """place and value of two tables that must hold the same values in the same places: a row that only one of
    them has, or an unequal one, fails the query."""
    j = a.select(place, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(place, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), place, "full")
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    checked = F.when(same, F.col("_a")).otherwise(F.raise_error(F.concat(F.lit("the tables differ at "), F.col(place).cast("string"))).cast(a.schema[value].dataType))
    return j.select(place, checked.alias(value))
