"""A table kept in buckets of its key, so that a merge rewrites only the buckets that it touches."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.plans.durable import durable

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write ``df`` to ``path`` as one folder for each bucket of its key."""
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(buckets, BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def merge_buckets(spark: SparkSession, path: str, rows: DataFrame, row_keys: list[str], keys: list[str], buckets: int,
                  merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Merge ``rows`` into the table at ``path``; the number of buckets that were rewritten.

    ``row_keys`` are expressions over the rows that give the table's ``keys``, in order.  Only the buckets that rows fall into are
    read (the folders of others are pruned) and replaced; at most ``buckets`` numbers come to the driver.  What replaces them is
    made durable first, since it is computed from the files it replaces.  A merge that fails between two buckets is run again:
    ``merge`` must give the same rows when it meets its own result, as :func:`merge_tasks` and :func:`merge_events` do.
    """
    dealt = rows.withColumns({f"_k{i}": F.expr(e) for i, e in enumerate(row_keys)})
    dealt = durable(dealt.withColumn(BUCKET, bucket_of([f"_k{i}" for i in range(len(row_keys))], buckets)).drop(
        *[f"_k{i}" for i in range(len(row_keys))]))
    touched = sorted(r[0] for r in dealt.select(BUCKET).distinct().collect())
    if not touched:
        return 0
    kept = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    merged = merge(kept, dealt.drop(BUCKET)).withColumn(BUCKET, bucket_of(keys, buckets))
    (durable(merged).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))
    return len(touched)
