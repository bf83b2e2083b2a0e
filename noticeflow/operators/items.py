"""Schedule items: normalisation of raw rows, duplicates within an input, order, past items."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.dates import at, parse_date, parse_time
from noticeflow.functions.text import let, once, strip
from noticeflow.operators.neighbours import numbered

RAW_FIELDS = ("title", "date", "time", "end_date", "end_time", "kind", "category", "location", "notes", "confidence")
ITEM = ("struct<title:string,start:timestamp_ntz,end:timestamp_ntz,all_day:boolean,kind:string,category:string,"
        "location:string,notes:string,alarm_minutes:int,confidence:double,source:string,undated:boolean,"
        "source_text:string>")
ITEM_FIELDS = ("title", "start", "end", "all_day", "kind", "category", "location", "notes", "alarm_minutes",
               "confidence", "source", "undated", "source_text")


#: Lengths that a service may ask for; nothing is cut without them.
SERVICE_LIMITS = {"title": 200, "category": 100, "location": 200, "notes": 2000, "reason": 200}


def cut(c: str, n: int | None) -> str:
    return c if n is None else f"substring({c}, 1, {n})"


def _trimmed(c: str, n: int | None) -> str:
    return f"nullif({cut(strip(c), n)}, '')"


def normalize(raw: str, ref: str, source: str = "''", limits: dict[str, int] | None = None) -> str:
    """Item struct of a raw struct with ``RAW_FIELDS``; null when it has to be dropped.

    Without a date a task stays as an undated all-day item at ``ref`` (its place and time are lost), an event is
    dropped.  An end before the start is removed before all-day times are cut to midnight.
    """
    limits = limits or {}

    def get(name: str) -> str:
        return f"{raw}.{name}"

    def common(kind: str) -> str:
        return (f"'kind', {kind}, 'category', {_trimmed(get('category'), limits.get('category'))}")

    def rest(location: str, undated: str) -> str:
        return (f"'location', {location}, 'notes', {_trimmed(get('notes'), limits.get('notes'))}, 'alarm_minutes', cast(null as int), "
                f"'confidence', least(greatest(coalesce({get('confidence')}, 0.8D), 0D), 1D), 'source', {source}, "
                f"'undated', {undated}, 'source_text', ''")

    def with_kind(kind: str) -> str:
        undated = (f"named_struct('title', {get('title')}, 'start', cast({ref} as timestamp_ntz), "
                   f"'end', cast(null as timestamp_ntz), 'all_day', true, {common(kind)}, "
                   f"{rest('cast(null as string)', 'true')})")

        def dated(p: str) -> str:
            start = at(f"{p}.d", f"coalesce({p}.t, 0)")
            end_time = f"if({p}.et IS NULL AND {p}.t IS NOT NULL AND {p}.ed IS NOT NULL, {p}.t, coalesce({p}.et, {p}.t, 0))"
            end = f"if({p}.ed IS NULL AND {p}.et IS NULL, null, {at(f'coalesce({p}.ed, {p}.d)', end_time)})"

            def finish(se: str) -> str:
                end_ok = f"if({se}.e < {se}.s, null, {se}.e)"
                cut = f"if({p}.t IS NULL, cast(to_date({end_ok}) as timestamp_ntz), {end_ok})"
                return (f"named_struct('title', {get('title')}, 'start', {se}.s, 'end', {cut}, 'all_day', {p}.t IS NULL, "
                        f"{common(kind)}, {rest(_trimmed(get('location'), limits.get('location')), 'false')})")

            return let(f"named_struct('s', {start}, 'e', {end})", finish)

        parsed = (f"named_struct('d', {parse_date(get('date'), ref)}, 't', {parse_time(get('time'))}, "
                  f"'ed', {parse_date(get('end_date'), ref)}, 'et', {parse_time(get('end_time'))})")
        return let(parsed, lambda p: (
            f"CASE WHEN {p}.d IS NOT NULL THEN cast({dated(p)} as {ITEM}) "
            f"WHEN {kind} = 'task' THEN cast({undated} as {ITEM}) END"))

    return let(f"if(startswith(lower(coalesce({get('kind')}, '')), 'task'), 'task', 'event')", with_kind)


def normalize_items(raw_items: DataFrame, ref: str = "reference_date", source: str = "source") -> DataFrame:
    """Raw rows (keys, ``RAW_FIELDS``) to item rows; rows that cannot be placed are dropped."""
    raw = "named_struct(" + ", ".join(f"'{f}', {f}" for f in RAW_FIELDS) + ")"
    keys = [c for c in raw_items.columns if c not in RAW_FIELDS and c not in (ref, source)]
    made = once(raw_items, f"named_struct('_item', {let(raw, lambda r: normalize(r, ref, source))})")
    return made.filter("_item IS NOT NULL").select(*keys, "_item.*")


def dedupe_items(items: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """First of equal (title, start, kind, undated) within an input.

    Grouping runs on the whole key with map-side combine, so an input or title that repeats millions of times is
    reduced before the shuffle.
    """
    group = [*keys, "title", "start", "kind", "undated"]
    others = [c for c in items.columns if c not in group]
    first = items.groupBy(*group).agg(F.min_by(F.struct(*others), F.col(pos)).alias("_first"))
    return first.select(*group, "_first.*").select(*items.columns)


def order_items(items: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Add ``item_no``: dated items first, then by start, then by position.

    One large input is spread over tasks, whatever its starts (see :func:`numbered`).
    """
    return numbered(items, keys, ["undated", "start", pos], "_at").select(
        *items.columns, (F.col("_at") + 1).cast("int").alias("item_no"))


def is_past(item: str, cutoff: str) -> str:
    """Dated before the cut-off; undated items never are, and no cut-off keeps everything."""
    return f"({cutoff} IS NOT NULL AND NOT {item}.undated AND to_date({item}.start) < {cutoff})"


def drop_past(items: DataFrame, cutoff: str, keys: list[str], pos: str = "item_no") -> tuple[DataFrame, DataFrame]:
    """(kept items, per input: n_past and the first three past titles)."""
    past = f"NOT undated AND to_date(start) < {cutoff}"
    kept = items.filter(f"NOT ({past}) OR {cutoff} IS NULL")
    gone = items.filter(past).select(*keys, pos, F.substring("title", 1, 20).alias("_t"))
    # a filter on the rank keeps three rows a group and task before the shuffle
    first = gone.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).filter("_rn <= 3")
    titles = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_t"))), lambda x: x["_t"]),
                                                   ", ").alias("past_titles"))
    return kept, gone.groupBy(*keys).agg(F.count("*").alias("n_past")).join(titles, keys)
