"""All queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (t, spark): t(name) reads a table. Without sql, tests compare it
    with plain Python."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return add


from . import text, retrieval, dataset, labels, graphs, stateful, extra, review, measures, details, sessions, agents, hybrid, designs, sections, findings, routing, audits, verdicts  # noqa: E402, F401, I001  they register themselves
