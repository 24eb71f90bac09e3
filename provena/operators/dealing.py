"""Rows dealt by key into tasks of a bounded number of rows, so that what a task sorts or groups does not grow with the table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of a task, as far as keys are even. All rows of a key share a task.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, n_rows: int) -> int:
    """Partitions that hold n_rows: Spark's number of them, or as many as hold TASK_ROWS each."""
    return max(math.ceil(n_rows / TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, *keys: Column | str, n_rows: int | None = None) -> DataFrame:
    """rows in as many hash partitions by keys as hold TASK_ROWS each; what one task can hold is left to Spark.

    n_rows: how many rows there are at most, where that is known or cheaper to count; else rows are counted, which is a pass of its own.
    """
    n = rows.count() if n_rows is None else n_rows
    return rows.repartition(tasks(rows.sparkSession, n), *keys) if n > TASK_ROWS else rows
