"""Previous and next values in large ordered groups.

A window over a whole group puts the group into one task.  Here the order is cut into blocks: a window runs inside
each (group, block), and only one value per block crosses the border, from a small aggregate.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.plans.durable import durable


def neighbour(df: DataFrame, keys: list[str], order: str, value: str, block: str, out: str,
              following: bool = False) -> DataFrame:
    """Add the value of the previous (or following) row by ``order`` within ``keys``.

    ``order`` must be unique within its group; ``block`` is an expression that grows with it.
    """
    rows = df.withColumn("_block", F.expr(block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    near = F.lead(value).over(inside) if following else F.lag(value).over(inside)
    edge = F.lead("_block").over(inside) if following else F.lag("_block").over(inside)
    rows = rows.withColumn("_near", near).withColumn("_edge", edge.isNull())
    border = (F.min_by if following else F.max_by)(value, order)
    borders = rows.groupBy(*keys, "_block").agg(border.alias("_v"))
    across = Window.partitionBy(*keys).orderBy("_block")
    shifted = borders.select(*keys, "_block", (F.lead("_v") if following else F.lag("_v")).over(across).alias("_far"))
    same = F.lit(True)
    for k in [*keys, "_block"]:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    joined = rows.alias("l").join(shifted.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], F.expr("if(_edge, _far, _near)").alias(out))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the place of a row in the order of its group, from 0, nulls last.

    Rows are dealt out by ranges of keys and order, made durable and counted inside each range; one count a group and range
    closes the gaps.  A group with very many rows spreads over ranges, equal rows too.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = durable(df.withColumn("_rid", F.monotonically_increasing_id())
                    .repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *by, "_rid")
                    .withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*by, "_rid")) - 1)
    same = F.lit(True)
    for k in [*keys, "_range"]:
        same = same & inside[k].eqNullSafe(starts[k])
    return inside.join(starts, same).select(*[inside[c] for c in df.columns], (F.col("_start") + F.col("_place")).alias(out))
