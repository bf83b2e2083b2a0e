"""Mix sources to target weights: pivotal rounding of copy numbers, residuals combined through a tree of blocks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import SPACE, join_split, packed, stored, unpacked

#: Units that one fold handles; what a block leaves over goes to the next level of the tree.
BLOCK = 128


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(``_source``, ``_source_size``) with ``_target`` and ``_rate`` (copies of each document that reach the target).

    Sources take the weights in turn by code point, null last, and share ``share`` times all sizes.  A target stops at
    ``most`` times its source's size and the excess is shared again by weight, until none is above: all others then get
    ``level * weight``.  Sources are capped in the order of size over weight, so the level follows from running sums.
    The windows run over one row a source, never over documents.  Without any size all targets are 0.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("_fill", "_rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = (sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").isNull(), "_source")))
              .withColumn("_weight", turn)
              .withColumn("_cap", F.lit(float(most)) * F.col("_source_size"))
              .withColumn("_fill", F.col("_cap") / F.col("_weight"))
              .withColumn("_total", F.lit(float(share)) * F.sum("_source_size").over(whole))
              .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                          / F.sum("_weight").over(rest)))
    level = F.max(F.when(F.col("_level") < F.col("_fill"), F.col("_level"))).over(whole)
    return (filled.withColumn("_target", F.least("_cap", F.coalesce(level * F.col("_weight"), F.col("_cap"))))
            .withColumn("_rate", F.coalesce(F.expr("_target / nullif(_source_size, 0)"), F.lit(0.0)))
            .select("_source", "_source_size", "_target", "_rate"))


def _uniform(*parts: str) -> str:
    """SQL for a number in [0, 1) that depends on nothing but the parts."""
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992D)"


def _pair(seed: int) -> str:
    """SQL of one pivotal step between the carried unit ``a.c`` and the next unit ``e``.

    A unit has key k, size s, a whole number w of copies and the mass m (between 0 and s) of its fractional copy.  Mass
    moves one way or the other, with odds that keep both expectations, until one unit is empty or full.  That one is done;
    the other is carried on.  The sum of masses does not change.
    """
    to_e, to_c = "least(a.c.m, e.s - e.m)", "least(e.m, a.c.s - a.c.m)"

    def done(unit: str, full: int, other: str, mass: str) -> str:
        return (f"named_struct('k', {unit}.k, 'n', {unit}.w + {full}L, "
                f"'c', named_struct('k', {other}.k, 's', {other}.s, 'm', {mass}, 'w', {other}.w))")

    return f"""element_at(transform(array(
      CASE WHEN {_uniform('a.c.k', 'e.k', str(seed))} * ({to_e} + {to_c}) < {to_c} OR {to_e} + {to_c} <= 0
           THEN CASE WHEN a.c.m <= e.s - e.m THEN {done('a.c', 0, 'e', 'a.c.m + e.m')}
                     ELSE {done('e', 1, 'a.c', 'a.c.m - (e.s - e.m)')} END
           ELSE CASE WHEN e.m <= a.c.s - a.c.m THEN {done('e', 0, 'a.c', 'a.c.m + e.m')}
                     ELSE {done('a.c', 1, 'e', 'e.m - (a.c.s - a.c.m)')} END END),
      r -> named_struct('c', r.c, 'done', array_append(a.done, named_struct('k', r.k, 'n', r.n)))), 1)"""


def _fold(seed: int) -> str:
    """SQL that folds the sorted array ``units`` into the carried unit ``c`` and the finished ones ``done``."""
    return f"""aggregate(slice(units, 2, size(units)),
        named_struct('c', units[0], 'done', cast(array() as array<struct<k:string,n:bigint>>)), (a, e) -> {_pair(seed)})"""


def pivotal_copies(units: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """Copies for units (``_source``, ``_unit``: strings without null, ``_size``, ``_rate``): the rate's floor or one more.

    Every unit is fractional in the part of its rate that is not whole.  The units of a source are dealt into blocks of
    about ``block`` by their hash; a block is folded pair by pair and leaves one unit over.  The units left over are the
    input of the next level, until every source has one, which is rounded to the nearer side: the words of a source miss its
    target by no more than half of that unit.  Levels are few (the logarithm of the largest source to the base ``block``) and
    stored, and a task holds no more than a block at a time.  Units without size are rounded on their own.
    Returns (``_source``, ``_unit``, ``_copies``).
    """
    base = stored(units.select("_source", "_unit", F.col("_size").cast("double").alias("_size"),
                               F.floor("_rate").cast("long").alias("_whole"),
                               (F.col("_rate") - F.floor("_rate")).alias("_part")))
    own = F.when(F.expr(f"{_uniform('_unit', str(seed))} < _part"), 1).otherwise(0)
    out = [base.filter("_part <= 0 or _size <= 0").select("_source", "_unit", (F.col("_whole") + own).alias("_copies"))]
    left = base.filter("_part > 0 and _size > 0").select(
        "_source", F.expr("named_struct('k', _unit, 's', _size, 'm', _size * _part, 'w', _whole)").alias("_u"))
    level = 0
    while True:
        counts = stored(left.groupBy("_source").agg(F.count("*").alias("_n")))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
        level += 1
        folded = stored(
            join_split(left, counts, "_source")
            .withColumn("_block", F.expr(f"pmod(xxhash64(_u.k, {seed + level}), (_n + {block - 1}) div {block})"))
            .groupBy("_source", "_block").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("_u.k").alias("o"), "_u")))
                                              .alias("units"))
            .select("_source", F.transform("units", lambda x: x["_u"]).alias("units"))
            .select("_source", F.expr(_fold(seed + level)).alias("_f")))
        out.append(folded.select("_source", F.explode("_f.done").alias("_d"))
                   .select("_source", F.col("_d.k").alias("_unit"), F.col("_d.n").alias("_copies")))
        left = folded.select("_source", F.col("_f.c").alias("_u"))
    out.append(left.select("_source", F.col("_u.k").alias("_unit"),
                           F.expr("_u.w + if(2 * _u.m >= _u.s, 1L, 0L)").alias("_copies")))
    copies = out[0]
    for more in out[1:]:
        copies = copies.unionByName(more)
    return copies


def _key(name: str) -> str:
    """SQL for a text key that keeps null apart from every value."""
    return f"coalesce(concat('=', cast(`{name}` as string)), 'null')"


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
        carry: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted).

    A document is taken whole, ``copies`` times: the floor of its source's rate (target over size) or one more, so with
    ``most=2`` never more than twice.  Only built-in functions run; the texts are read once, for their sizes.

    Null and empty texts have size 0; they take no words and their copies follow the rate.  A source of size 0 has target
    and rate 0.  Null is a source of its own, the last.  Rows that share source and id are taken the same number of times,
    as one unit.  An input column named like an output is replaced.  An empty table gives no rows.
    ``carry`` names the input columns to return (default: id and source).
    """
    rows = stored(packed(df, [id_col, source_col] if carry is None else carry, _id=id_col, _text=text_col, _s=source_col)
                  .select("_row", F.col("_s").cast("string").alias("_source"), F.expr(_key("_id")).alias("_unit"),
                          F.expr(f"cast(regexp_count(coalesce(_text, ''), '[^{SPACE}]+') as bigint)").alias("_size")))
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    targets = stored(source_targets(sizes, weights, share, most).withColumn("_source", F.expr(_key("_source"))))
    rows = rows.withColumn("_source", F.expr(_key("_source")))
    units = rows.groupBy("_source", "_unit").agg(F.sum("_size").alias("_size"))
    copies = pivotal_copies(join_split(units, targets, "_source"), seed)
    both = F.concat_ws("\n", "_source", "_unit").alias("_both")
    joined = join_split(join_split(rows.select("*", both), copies.select(both, "_copies"), "_both"), targets, "_source")
    return unpacked(joined, size=F.col("_size"), source_size=F.col("_source_size"), target=F.col("_target"),
                    copies=F.col("_copies"), taken=F.col("_copies") * F.col("_size"))


def repeated(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every row of ``df`` as often as ``mixed`` (from :func:`mix`) says: not at all, once, or more."""
    both = F.expr(f"concat_ws('\\n', {_key(source_col)}, {_key(id_col)})").alias("_both")
    copies = mixed.select(both, "copies").filter("copies > 0").distinct().withColumnRenamed("copies", "_copies")
    rows = packed(df, None).withColumn("_both", F.expr(
        f"concat_ws('\\n', coalesce(concat('=', cast(_row.`{source_col}` as string)), 'null'), "
        f"coalesce(concat('=', cast(_row.`{id_col}` as string)), 'null'))"))
    return unpacked(join_split(rows, copies, "_both").withColumn("_n", F.explode(F.sequence(F.lit(1), "_copies"))))
