"""Chat formatting with perspective rotation: every participant once as the assistant, the others as named users."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import join_split, stored

#: Turns of a rendered part; a longer conversation gives several parts.
PART = 256
START, END = "<|im_start|>", "<|im_end|>"


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` (stored) with ``_at``: the place of a row in its key's order, from 0, nulls last.

    Rows are dealt out by ranges of key and order and counted inside each range; one count a key and range closes the gaps.
    A key with very many rows spreads over ranges, equal rows too.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = stored(df.withColumn("_rid", F.monotonically_increasing_id())
                   .repartitionByRange(F.col(key).asc_nulls_last(), *by, "_rid").withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*by, "_rid")) - 1)
    same = inside[key].eqNullSafe(starts[key]) & (inside["_range"] == starts["_range"])
    return (inside.join(starts, same).select(inside["*"], (F.col("_start") + F.col("_place")).alias("_at"))
            .drop("_rid", "_range", "_place"))


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", fixed: tuple[str, ...] = ("system",), part: int = PART) -> DataFrame:
    """(``conv_id``, ``perspective``, ``part``, ``n_turns``, ``text``, ``spans``): each dialogue from each participant's side.

    A turn of the participant is rendered as the assistant's, a turn of a role in ``fixed`` under its own name, any other
    as a user's with the speaker's name.  ``spans`` are the (start, end) places, in code points of ``text``, that count in
    training: the participant's words and the mark that ends them.  Roles in ``fixed`` are no participants.  Parts hold
    ``part`` turns in order, so that no conversation is gathered whole; joined in order they are the whole dialogue.

    Turns are ordered by number, role and text; null turns come last.  A null role is ``unknown``, a null text is empty,
    a null conversation is one of its own; repeated rows are turns of their own.  ``<|`` in a text or name becomes ``< |``,
    so that it cannot pass for a mark, and a line end in a name a blank.  Other columns are not read.
    """
    turns = df.select(F.col(f"`{conv_col}`").alias("_conv"), F.col(f"`{turn_col}`").alias("_turn"),
                      F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("_role"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    turns = turns.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("_conv").cast("string")), F.lit("null")))
    placed = numbered(turns, "_key", ["_turn", "_role", "_text"])
    sides = placed.filter(~F.col("_role").isin(*fixed)).select("_key", F.col("_role").alias("_side")).distinct()

    def safe(c: str):
        return F.replace(F.col(c), F.lit("<|"), F.lit("< |"))

    name = F.replace(safe("_role"), F.lit("\n"), F.lit(" "))
    mine = F.col("_role") == F.col("_side")
    head = F.concat(F.lit(START), F.when(mine, "assistant").when(F.col("_role").isin(*fixed), name)
                    .otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))
    pieces = (join_split(placed, sides, "_key")
              .select("_conv", "_side", F.expr(f"_at div {part}").alias("_part"),
                      F.struct("_at", head.alias("head"), F.concat(safe("_text"), F.lit(END)).alias("tail"), mine.alias("mine")).alias("_p"))
              .groupBy("_conv", "_side", "_part").agg(F.sort_array(F.collect_list("_p")).alias("_p")))
    spans = F.expr("""aggregate(_p, named_struct('n', 0, 'out', cast(array() as array<struct<start:int,end:int>>)),
        (a, p) -> named_struct('n', a.n + char_length(p.head) + char_length(p.tail) + 1, 'out',
            if(p.mine, array_append(a.out, named_struct('start', a.n + char_length(p.head),
                                                        'end', a.n + char_length(p.head) + char_length(p.tail))), a.out)),
        a -> a.out)""")
    return pieces.select(F.col("_conv").alias("conv_id"), F.col("_side").alias("perspective"), F.col("_part").alias("part"),
                         F.size("_p").cast("long").alias("n_turns"),
                         F.expr("array_join(transform(_p, p -> concat(p.head, p.tail, '\\n')), '')").alias("text"),
                         spans.alias("spans"))
