"""Helpers shared by the operators: carried columns, stored intermediate tables, joins that survive a hot key."""
from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.plans.durable import shared_folder

#: The white space of the data contracts, as a SQL string literal for the body of a character class.
SPACE = r"\\x20\\x09-\\x0D"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder (``path``: a folder of it) and read it back.

    The lineage ends at files that every executor sees, so a lost executor costs only the tasks that it ran, and a table
    that is used several times is computed once.  Columns without a type become strings.
    """
    typed = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType)
                        else F.col(f"`{f.name}`") for f in df.schema.fields])
    path = path or shared_folder(df.sparkSession)
    typed.write.parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)


class Scratch:
    """Stored tables that go when the work is done.

    What is returned must not be read from them.  The shuffle files of plans that no one holds any more go with them, as soon as
    the driver's JVM has collected these plans.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_folder(self.spark))
        return stored(df, f"{self.paths[-1]}/t")

    def drop(self, keep: int = 0) -> None:
        """Delete the tables stored since there were ``keep`` of them, and let the JVM collect the plans of finished jobs."""
        self.drop_these(self.paths[keep:])

    def drop_these(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            self.paths.remove(path)
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        gc.collect()
        jvm.System.gc()


def packed(df: DataFrame, carry: list[str] | None, **columns: str) -> DataFrame:
    """``_row`` (a struct of the carried columns, all by default) and the named columns under internal names.

    Inside an operator no column of the caller can then clash with one of the operator's own.
    """
    names = df.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("string").alias("__no_columns__"))
    return df.select(row.alias("_row"), *[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, **outputs: Column) -> DataFrame:
    """The carried columns and the operator's outputs; an output replaces a carried column of the same name."""
    taken = {k.lower() for k in outputs} | {"__no_columns__"}
    names = [f.name for f in df.schema["_row"].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col("_row").getField(c).alias(c) for c in names], *[v.alias(k) for k, v in outputs.items()])


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi join of rows with a table that has one row a key, where one key may hold a third of the left rows.

    A right side that was grouped by the key is already dealt out by it, so Spark would leave that side in place, and the
    adaptive planner splits a hot partition only between two fresh exchanges.  A second key, derived from the first, makes
    it deal out both sides again; the right side is small in comparison.
    """
    part = F.pmod(F.hash(F.col(key)), F.lit(1 << 16)).alias("_part")
    return left.select("*", part).join(right.select("*", part), [key, "_part"], how).drop("_part")


def marked(left: DataFrame, right: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame] = stored, bits_per_row: int = 16,
           max_words: int = 1 << 22) -> DataFrame:
    """The rows of ``left`` and whether ``right`` may have their key (``_maybe``: never false if it has), without a shuffle of ``left``.

    For large rows, before a join.  Three bits of one 64-bit word stand for each key of ``right``.  What is sent to all tasks has at
    most ``max_words`` rows of 16 bytes (64 MB); beyond ``64 * max_words / bits_per_row`` keys more of the other rows are marked.
    ``keep`` stores a table.
    """
    rows, words = right.count(), 1024
    while words < min(max_words, rows * bits_per_row // 64):
        words *= 2

    def hashed(df: DataFrame) -> DataFrame:
        mask = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(_h, {at}) & 63 as int))" for at in (24, 30, 36))
        df = df.withColumn("_h", F.xxhash64(key))
        return df.select("*", F.col("_h").bitwiseAND(F.lit(words - 1)).alias("_word"), F.expr(mask).alias("_mask")).drop("_h")

    seen = keep(hashed(right.select(key)).groupBy("_word").agg(F.expr("bit_or(_mask)").alias("_seen")))
    return hashed(left).join(F.broadcast(seen), "_word", "left").select(
        *left.columns, F.expr("coalesce(_seen & _mask = _mask, false)").alias("_maybe"))


def sifted(left: DataFrame, right: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """The rows of ``left`` that :func:`marked` marks: all whose key ``right`` has, and a few others."""
    return marked(left, right, key, keep).filter("_maybe").drop("_maybe")
