"""Cut lineage durably: a checkpoint in the folder the cluster names, so losing executors loses no work."""
from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A session on one machine that names none, as in tests, gets a temporary folder; on a cluster that folder would not be
    shared, so a missing setting is an error there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir is not set and {master} has no folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``.

    Used where a plan is read twice and must not run twice (calls to an outside model).  The folder is
    ``spark.checkpoint.dir`` of the session; one is made only when none is set, as in local tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: columns are pruned and filters pushed down when it is used again.

    The folder is added to ``paths``, if they are given, for :func:`dropped`.
    """
    path = f"{shared_folder(df.sparkSession)}/t"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more.  The shuffle files of finished plans go when the driver's JVM collects these."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    paths.clear()
    gc.collect()
    spark._jvm.System.gc()
