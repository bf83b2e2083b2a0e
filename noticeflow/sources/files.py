"""File listing, text decoding, page stitching and table rows."""
from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions.text import any_of, fn, let, strip

# ---- fixed values
IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp")
TEXT_EXTS = (".txt", ".md", ".csv")
DOC_EXTS = (".pdf", ".hwpx", ".hwp")
MIN_PAGE_CHARS = 20


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '([^/\\\\\\\\]*)$', 1)"


def extension(path: str) -> str:
    """Lower-case suffix of the file name with its dot, '' when there is none."""
    return f"lower(regexp_extract({base_name(path)}, '^.+([.][^.]+)$', 1))"


def is_supported(path: str) -> str:
    names = ", ".join(f"'{e}'" for e in (*IMAGE_EXTS, *TEXT_EXTS, *DOC_EXTS))
    return f"{extension(path)} IN ({names})"


def list_files(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by extension."""
    flagged = files.select("*", F.expr(base_name(path)).alias("name"), F.expr(extension(path)).alias("ext"))
    keep = F.expr(is_supported(path))
    return flagged.filter(keep), flagged.filter(~keep)


def read_files(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of one directory level; rejected ones have no ``content``, theirs is never opened."""
    def any_case(ext: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)

    names = "*{" + ",".join(any_case(e) for e in (*IMAGE_EXTS, *TEXT_EXTS, *DOC_EXTS)) + "}"
    accepted, _ = list_files(spark.read.format("binaryFile").option("pathGlobFilter", names).load(directory))
    _, rejected = list_files(spark.read.format("binaryFile").load(directory).drop("content"))
    return accepted, rejected


@contextlib.contextmanager
def _java_charsets(spark: SparkSession):
    """Korean code pages need the JVM's charsets; the setting is read while the expression is analysed."""
    settings = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def decode_text(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Bytes to text: UTF-8 without its mark, else the Korean code page, else UTF-8 with replacements.

    The code page (a superset of EUC-KR) has no replacement character, so one in its result marks bad bytes.
    """
    utf8 = f"cast({content} as string)"
    no_bom = let(utf8, lambda t: f"if(startswith({t}, '\\ufeff'), substring({t}, 2), {t})")
    korean = let(f"decode({content}, 'MS949')", lambda t: (
        f"if(contains({t}, '\\ufffd'), make_valid_utf8({utf8}), {t})"))
    with _java_charsets(df.sparkSession):
        return df.select("*", F.expr(f"if(is_valid_utf8({utf8}), {no_bom}, {korean})").alias(out))


def stitch_pages(pages: DataFrame, doc: str = "doc_id", max_scans: int | None = None) -> DataFrame:
    """(doc, text, scan_pages): pages with text joined under '[p.N]', those without text (the first ``max_scans``, if given)
    kept as scans."""
    stripped = pages.select(doc, "page_no", F.expr(strip("coalesce(text, '')")).alias("t"))
    whole = stripped.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_no", "t"))).alias("ps"))
    texts = f"filter(ps, {fn(lambda p: f'length({p}.t) >= {MIN_PAGE_CHARS}')})"
    scans = f"filter(ps, {fn(lambda p: f'length({p}.t) < {MIN_PAGE_CHARS}')})"
    page = fn(lambda p: f"concat('[p.', {p}.page_no, ']\\n', {p}.t)")
    number = fn(lambda p: f"{p}.page_no")
    return whole.select(
        doc, F.expr(f"array_join(transform({texts}, {page}), '\\n\\n')").alias("text"),
        F.expr(f"slice(transform({scans}, {number}), 1, {2**31 - 1 if max_scans is None else max_scans})").alias("scan_pages"))


def _cell(text: str) -> str:
    return strip(f"replace({text}, '\\n', ' ')")


def table_rows(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, line): '| a | b |' per row, rows of empty cells dropped.  ``cells``: keys, row, col, text."""
    rows = cells.select(*keys, "row", "col", F.expr(_cell("coalesce(text, '')")).alias("t"))
    line = f"concat('| ', array_join(transform(array_sort(collect_list(struct(col, t))), {fn(lambda c: c + '.t')}), ' | '), ' |')"
    return (rows.groupBy(*keys, "row").agg(F.expr(line).alias("line"), F.expr("bool_or(t <> '')").alias("_any"))
            .filter("_any").drop("_any"))


def table_rows_by_count(cells: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """Like :func:`table_rows` for cells in one sequence (keys, seq from 0, text) with declared row lengths
    (keys, row, n).  Cells beyond the declared ones make one more row of the non-empty ones."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("row")
    ends = counts.select(*keys, "row", "n", F.sum("n").over(w).alias("hi"))
    places = ends.filter("n > 0").select(*keys, "row", F.expr("explode(sequence(hi - n, hi - 1))").alias("seq"))
    rows_end = ends.groupBy(*keys).agg(F.max("row").alias("_last"))
    joined = (cells.join(places.hint("merge"), [*keys, "seq"], "left").join(rows_end, list(keys), "left")
              .filter(any_of("row IS NOT NULL", f"{_cell('text')} <> ''"))
              .select(*keys, F.expr("coalesce(row, _last + 1, 1)").alias("row"), F.col("seq").alias("col"), "text"))
    return table_rows(joined, *keys)
