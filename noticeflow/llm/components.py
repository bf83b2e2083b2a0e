"""Connected components of an edge table, by alternating star contractions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import join_split, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (join_split(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (join_split(edges, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(``u``, ``v``): every node of the edges (``u``, ``v``) but the smallest of its component, and that smallest one.

    Two contractions a round, each a grouped minimum and a join; the table of edges never grows and is stored after each
    round.  It ends when a round changes nothing, after about log(n) rounds; paths become stars.  No group is ever
    collected, and a node with very many neighbours is split by the join.  Self loops and repeated edges do not count.
    ``keep`` stores a table.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now
        seen = mark
        now = keep(_small_star(_large_star(now)))
