"""Rows dealt over the cores where their files may leave cores without rows."""
from __future__ import annotations

from pyspark.sql import DataFrame

TASKS_A_CORE = 3


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt row by row into tasks for all cores, as many as it comes in at least.

    For rows whose work is far larger than their bytes.  The number of tasks that read a table does not tell how its rows lie: Spark
    cuts files by bytes, but a row group is read by one task, and the tasks of the other cuts get no rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(TASKS_A_CORE * cores, df.rdd.getNumPartitions()))
