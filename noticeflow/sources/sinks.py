"""Sinks: tables per run date, an idempotent sink for micro-batches, and several tables published together."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_run(df: DataFrame, path: str, run_date: str) -> None:
    """Replace the partition of one run date; other dates stay."""
    (df.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch under its id, so a replay after a failure replaces instead of adding, also by no rows.

    The folder of the batch is named here and not found from the rows, which a short poll would mostly wait for.
    """
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _files(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(path: str, batch_id: int, **tables: DataFrame) -> bool:
    """Write the tables of a micro-batch below ``path`` and publish them together; false if the batch was published before.

    Each attempt writes folders of its own.  They count from the moment that the manifest of the batch names them, which is one
    rename; until then readers (:func:`published`) see none of the tables, and a replay starts anew.
    """
    spark, attempt = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    fs, done = _files(spark, f"{path}/manifest/{batch_id}")
    if fs.exists(done):
        return False
    for name, df in tables.items():
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.parquet(f"{path}/data/{name}/{batch_id}/{attempt}")
    draft = _files(spark, f"{path}/drafts/{attempt}")[1]
    out = fs.create(draft, True)
    out.write(bytearray(f"{batch_id} {attempt}\n".encode()))
    out.close()
    fs.mkdirs(done.getParent())
    if not fs.rename(draft, done) and not fs.exists(done):
        raise OSError(f"batch {batch_id} could not be published at {path}")
    return True


def published(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    """A table of all published batches, with ``batch_id``; ``schema`` is that of its other columns.

    The manifests, one line a batch, come to the driver; attempts that no manifest names are never read.
    """
    full = (StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))).add("batch_id", "long")
    fs, folder = _files(spark, f"{path}/manifest")
    lines = [r.value.split() for r in spark.read.text(f"{path}/manifest").collect()] if fs.exists(folder) else []
    folders = [f"{path}/data/{name}/{batch}/{attempt}" for batch, attempt in lines]
    return spark.read.schema(full).parquet(*folders) if folders else spark.createDataFrame([], full)
