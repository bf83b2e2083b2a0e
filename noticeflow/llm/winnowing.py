"""Document fingerprints by winnowing, in built-in functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import SPACE, packed, stored, unpacked

#: A selected gram is one long: 32 bits of hash above 31 bits that fall as the position rises, so that the least value is
#: the least hash and, of equal hashes, the rightmost.
LAST = (1 << 31) - 1
#: Longer words (texts without white space, encoded data) are taken apart.
LONG = 24


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 5, w: int = 16) -> DataFrame:
    """``df`` with the winnowed grams ``out`` (array of longs) of the text column ``text``.

    Words end at ASCII white space; of a word of over ``LONG`` code points each one counts as a word.  Every run of ``k`` words has a hash, rolled over the hashes of its words; in every
    window of ``w`` runs the least hash is selected, the rightmost of equal ones.  Two texts that share ``k + w - 1`` words
    in a row therefore share a gram.  Of a text of up to ``2 * w`` runs all are selected, so that a short one is not alike
    or unlike by the luck of a single window.  A text of fewer than ``k`` words is one run; without words nothing is selected.  The steps are columns of their own, so that no step is evaluated inside the next one's loop.
    """
    ends = "".join(f"\\u{c:04x}" for c in (9, 10, 11, 12, 13, 32))
    words = f"split(btrim(coalesce(`{text}`, ''), '{ends}'), '[{SPACE}]+')"
    apart = f"flatten(transform({words}, x -> if(char_length(x) > {LONG}, split(x, ''), array(x))))"
    words = f"CASE WHEN `{text}` RLIKE '[^{SPACE}]{{{LONG + 1}}}' THEN {apart} ELSE {words} END"
    grams = ", ".join(f"_h[i + {j}]" for j in range(k))
    packed_gram = f"shiftleft(({{}}) & 4294967295L, 31) | ({LAST}L - {{}})"
    return (df.withColumn("_h", F.expr(f"transform({words}, x -> xxhash64(x))"))
            .withColumn("_h", F.expr("if(size(_h) = 1 and _h[0] = xxhash64(''), cast(array() as array<bigint>), _h)"))
            .withColumn("_g", F.expr(f"""CASE WHEN size(_h) = 0 THEN cast(array() as array<bigint>)
                WHEN size(_h) < {k} THEN array({packed_gram.format("xxhash64(array_join(_h, ','))", "0L")})
                ELSE transform(sequence(0, size(_h) - {k}), i -> {packed_gram.format(f"xxhash64({grams})", "i")}) END"""))
            .withColumn(out, F.expr(f"""CASE WHEN size(_g) = 0 THEN _g
                WHEN size(_g) <= {2 * w} THEN _g
                ELSE array_distinct(transform(sequence(1, size(_g) - {w - 1}), i -> array_min(slice(_g, i, {w})))) END"""))
            .drop("_h", "_g"))


def gram_positions(grams: str) -> Column:
    """The selected grams as an array of (hash, position of the first word), in the order of the text."""
    return F.expr(f"transform({grams}, v -> struct(shiftrightunsigned(v, 31) as hash, "
                  f"{LAST}L - (v & {LAST}L) as position))")


def fingerprint_text(grams: str) -> Column:
    """The hashes of the selected grams, eight hexadecimal digits each, in the order of the text."""
    return F.expr(f"array_join(transform({grams}, v -> lower(lpad(hex(shiftrightunsigned(v, 31)), 8, '0'))), '')")


def likeness(a: str, b: str) -> Column:
    """Shared part of the hashes of two fingerprints (0 to 1); two empty ones are alike, an empty one is unlike others."""
    x, y = (f"transform({c}, v -> shiftrightunsigned(v, 31))" for c in (a, b))
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D "
                  f"ELSE size(array_intersect({x}, {y})) / cast(size(array_union({x}, {y})) as double) END")


def fingerprints(df: DataFrame, text_col: str = "text", k: int = 5, w: int = 16) -> DataFrame:
    """``df`` with ``grams``: the winnowed (hash, position) pairs of each text.  Null counts as empty."""
    rows = with_fingerprint(packed(df, None, _text=text_col), "_text", "_grams", k, w)
    return unpacked(rows, grams=gram_positions("_grams"))


def _neighbours(keys: DataFrame) -> DataFrame:
    """(``_key``, ``_prev``, ``_prev_n``) of distinct documents (``_key``, ``_id``, ``_h``, ``_n``) in a circle of ids.

    The table is dealt out by ranges and ordered inside each; the first document of each range closes the gap to the one
    before.  Only one row a range meets in one task.
    """
    order = [F.col("_id").isNull(), F.col("_id"), F.col("_h")]
    dealt = stored(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order)
    firsts = dealt.groupBy("_range").agg(F.min_by("_key", F.struct(order[0].alias("a"), "_id", "_h")).alias("_first"))
    ranges = Window.orderBy("_range")
    firsts = firsts.select("_range", F.coalesce(F.lead("_first").over(ranges), F.first("_first").over(ranges)).alias("_over"))
    after = (dealt.withColumn("_next", F.lead("_key").over(inside)).join(F.broadcast(firsts), "_range")
             .select(F.coalesce("_next", "_over").alias("_key"), F.col("_key").alias("_prev"), F.col("_n").alias("_prev_n")))
    return stored(after)


def edit_likeness(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 3, w: int = 8,
                  carry: list[str] | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike it is to that and to the next document.

    In the edited text the last quarter of the code points (rounded down) is replaced by the first as many of the next
    document, in ascending order of ids, after the last the first.  Whole texts are dealt out once, by document; each sends
    the quarter that is needed and its grams to the document before it.

    Null texts count as empty.  Rows without an id come last.  Texts with the same id are ordered by their hash; rows that
    repeat both are one document and get equal results.  A single document is its own next.  An input column named like an
    output is replaced.  ``carry`` names the input columns to return (default: the id).
    """
    base = packed(df, [id_col] if carry is None else carry, _id=id_col, _text=text_col)
    base = base.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_h0", F.xxhash64("_text"))
    base = base.withColumn("_key", F.expr("concat(coalesce(concat('=', cast(_id as string)), 'null'), ' ', hex(_h0))"))
    keys = base.select("_key", "_id", F.col("_h0").alias("_h"), F.char_length("_text").alias("_n")).distinct()
    links = _neighbours(keys)
    texts = with_fingerprint(base.select("_row", "_key", "_text"), "_text", "_grams", k, w)
    linked = texts.join(links, "_key")
    sent = (linked.groupBy(F.col("_prev").alias("_key"))
            .agg(F.first(F.struct(F.expr("substring(_text, 1, cast(_prev_n div 4 as int))").alias("head"), "_grams", "_row"))
                 .alias("_sent")))
    n = "char_length(_text)"
    edited = (linked.select("_row", "_key", "_text", "_grams").join(sent, "_key")
              .withColumn("_n", F.expr(n))
              .withColumn("_edited", F.expr(f"concat(substring(_text, 1, {n} - cast({n} div 4 as int)), _sent.head)"))
              .withColumn("_next_grams", F.col("_sent._grams")).drop("_sent", "_text"))
    both = with_fingerprint(edited, "_edited", "_edited_grams", k, w)
    return unpacked(both, n_chars=F.col("_n").cast("long"), edited_sha256=F.sha2("_edited", 256),
                    fingerprint=fingerprint_text("_grams"), edited_fingerprint=fingerprint_text("_edited_grams"),
                    near_edited=likeness("_grams", "_edited_grams"), near_next=likeness("_grams", "_next_grams"))
