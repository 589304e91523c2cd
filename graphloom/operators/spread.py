"""Dealing rows to tasks: as many as cores can use, and more as rows grow, however few files or row groups hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

KEYS = 65_536
PAIRS = 2_097_152
IDS = 8_388_608
TEXTS = 33_554_432


def tasks_for(df: DataFrame, each: int) -> int:
    """Tasks for df: one for `each` bytes of its estimated size (columns of keys are packed, so a few bytes make a row), at least two a core."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return max(least, min(-(-size // each), 20_000)) if size < 2**60 else least  # beyond: no estimate


def spread(df: DataFrame, each: int, *by: str | Column) -> DataFrame:
    """df dealt in turn, or by columns: a file of one row group is one task's work, and what each row costs there runs on one core."""
    return df.repartition(tasks_for(df, each), *by)
