"""Aggregation helpers that stay scalable when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sum_by(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """GROUP BY keys, SUM(value): partial aggregate, one shuffle of partials."""
    return df.groupBy(*keys).agg(F.sum(value).alias(alias))


def window_total(df: DataFrame, keys: Sequence[str], detail: Sequence[str], value: str, alias: str) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys)`` on one row per (keys, detail).

    A window over the rows themselves would send every row of a key to one
    task.  The whole-partition sum of sums is the same number, so rows are
    first summed per (keys, detail), with map-side combine, and the window
    runs over that small result.  NULL keys form their own partition.
    """
    sums = sum_by(df, [*keys, *detail], value, "__sum")
    return sums.withColumn(alias, F.sum("__sum").over(Window.partitionBy(*keys))).drop("__sum")
