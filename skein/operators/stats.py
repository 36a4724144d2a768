"""ANALYZE, column by column, and plan introspection."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def analyze(df: DataFrame) -> DataFrame:
    """(column_name, row_count, ndv, null_count, null_fraction, min_value, max_value), exact, one row per column.

    Each column is grouped by its values and the groups are counted, so a scan reads that column alone, repeats are merged before
    the shuffle, and rows are never multiplied by the number of columns.  A frequent value is one row of each task.
    """
    return reduce(DataFrame.unionAll, [_of_column(df, c) for c in df.columns])


def _of_column(df: DataFrame, name: str) -> DataFrame:
    values = df.select(F.col(f"`{name}`").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    zero = F.lit(0).cast("bigint")
    nulls = F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("k"))), zero)
    one = values.agg(F.coalesce(F.sum("k"), zero).alias("n"), F.count("x").alias("ndv"), nulls.alias("nulls"), F.min("x").cast("string").alias("low"), F.max("x").cast("string").alias("high"))
    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("nulls") / F.col("n"))
    return one.select(F.lit(name).alias("column_name"), F.col("n").alias("row_count"), "ndv", F.col("nulls").alias("null_count"), share.alias("null_fraction"), F.col("low").alias("min_value"), F.col("high").alias("max_value"))


@dataclass(frozen=True)
class Trace:
    """What EXPLAIN ANALYZE tells: the formatted plan, rows returned and seconds taken."""

    plan: str
    rows: int
    seconds: float


def plan_of(df: DataFrame, mode: str = "formatted") -> str:
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def explain_analyze(df: DataFrame) -> Trace:
    began = time.perf_counter()
    rows = df.count()
    return Trace(plan_of(df), rows, time.perf_counter() - began)
