"""Files in and out: JSON lines (strict or tolerant), whole JSON documents, text folders, appends
without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import scratch


def read_jsonl(spark: SparkSession, path: str, schema: str, *, tolerant: bool = False) -> DataFrame:
    """One row for each line; blank lines are skipped. Tolerant: broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole file as one JSON value."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file of a folder of text files."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path).select(F.col("value").alias("line"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))


def with_side_text(cases: DataFrame, path: str, name: str, text: str) -> DataFrame:
    """cases with the whole text of the side file that a column names, "" where they name none or there is none such.
    A side file is what its own folder (``side=<name>``) below the path holds, one row of a task."""
    files = cases.sparkSession.read.schema("value string, side string").text(path, wholetext=True)
    named = files.select(F.col("side").alias("_file"), F.col("value").alias(text))
    return cases.join(named, F.col(name) == F.col("_file"), "left").drop("_file").withColumn(text, F.coalesce(text, F.lit("")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Appends the rows whose key is not there yet, and gives them back as they were written."""
    spark = df.sparkSession
    have = read_jsonl(spark, path, schema).select(F.col(key).alias("_have"))
    new = df.dropDuplicates([key]).join(have, F.col(key) == F.col("_have"), "left_anti")
    part = scratch(spark, "append")
    new.write.json(part)
    read_jsonl(spark, part, schema).write.mode("append").json(path)
    return read_jsonl(spark, part, schema)


def paged(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def escaped_line(text: Column) -> Column:
    """A line that may hold carriage returns, for a file of lines."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r"))


def plain_line(text: Column) -> Column:
    """What escaped_line() was made of."""
    parts = F.regexp_extract_all(text, F.lit(r"\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p)), "")
