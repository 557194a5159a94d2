"""Run-length and delta encoding of ordered columns, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, run (from 0), value, length: stretches of equal values."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1)
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def deltas(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each value's difference to the last one before it that is not null; the first counts from 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0)))


def undelta(df: DataFrame, keys: list[str], order: str, delta: str) -> DataFrame:
    """Values from differences: running sums."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("value", F.when(F.col(delta).isNotNull(), F.sum(delta).over(w)))
