"""Exact deduplication with two passes over a Bloom filter; only rows that may repeat are shuffled."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import join_split, packed, stored, unpacked

#: Characters that do not count in a comparison: space, tab, line feed, vertical tab, form feed, carriage return.
IGNORED = (" ", "\t", "\n", "\x0b", "\f", "\r")


def normalised(text):
    """The text without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None,
                bits_per_row: int = 16, max_words: int = 1 << 22) -> DataFrame:
    """Every row of ``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are the same after white space is deleted.  Of equal texts the row with the longest original
    text stays, then the one with the smallest id.

    Pass 1 sets three bits of one 64-bit word for each row's hash and keeps the bits that were hit at least twice; that
    table has at most ``max_words`` rows of 16 bytes (64 MB), whatever the input, and is the only thing broadcast.  Pass 2
    probes it: a hash whose three bits were all hit twice may repeat.  Those rows are stored and grouped; all others go
    straight through.  Beyond ``64 * max_words / bits_per_row`` rows the filter lets more rows through to the grouping,
    and the result stays the same.

    Null texts count as empty; empty texts are equal to each other.  Null ids come after all others.  Rows that are equal
    in id and text are one group and one of them is kept.  An input column named like an output is replaced.
    ``carry`` names the input columns to return (default: all).
    """
    rows = df.count()
    words = 1024
    while words < min(max_words, rows * bits_per_row // 64):
        words *= 2
    keyed = (packed(df, carry, _id=id_col, _text=text_col)
             .select("_row", "_id", F.length(F.coalesce("_text", F.lit(""))).alias("_n"),
                     F.sha2(normalised(F.col("_text")), 256).alias("_sha"))
             .withColumn("_h", F.xxhash64("_sha"))
             .withColumn("_word", F.col("_h").bitwiseAND(F.lit(words - 1)))
             .withColumn("_bits", F.expr("array(shiftrightunsigned(_h, 24) & 63, shiftrightunsigned(_h, 30) & 63, "
                                         "shiftrightunsigned(_h, 36) & 63)")))
    hit_twice = (keyed.select("_word", F.explode(F.array_distinct("_bits")).alias("_bit"))
                 .groupBy("_word", "_bit").count().filter("count > 1")
                 .groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, cast(_bit as int)))").alias("_seen")))
    probed = (keyed.join(F.broadcast(stored(hit_twice)), "_word", "left")
              .withColumn("_mask", F.expr("shiftleft(1L, cast(_bits[0] as int)) | shiftleft(1L, cast(_bits[1] as int)) "
                                          "| shiftleft(1L, cast(_bits[2] as int))"))
              .withColumn("_maybe", F.expr("coalesce((_seen & _mask) = _mask, false)")))
    once = unpacked(probed.filter("not _maybe"), keep_id=F.col("_id"), group_size=F.lit(1).cast("long"),
                    kept=F.lit(True), text_sha256=F.col("_sha"))
    maybe = stored(probed.filter("_maybe").select("_row", "_id", "_n", "_sha",
                                                  F.monotonically_increasing_id().alias("_rid")))
    groups = maybe.groupBy("_sha").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("no_id"),
                                                      F.col("_id").alias("id"), F.col("_rid").alias("rid"))).alias("_best"),
                                       F.count("*").alias("_size"))
    decided = unpacked(join_split(maybe, groups, "_sha"), keep_id=F.col("_best.id"), group_size=F.col("_size"),
                       kept=F.col("_best.rid") == F.col("_rid"), text_sha256=F.col("_sha"))
    return once.unionByName(decided)
