"""Relative dates and the period timetable.  Periods are 'HH:MM' texts; arithmetic runs on minutes of the day."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.dates import WEEKDAYS, WEEKS, clock, minutes_of
from noticeflow.functions.text import fn, let, once

# ---- fixed values: seven periods, four before lunch
N_PERIODS = 7
BLOCKS = ((0, 3), (4, 6))
LUNCH_MINUTES = 50

_TIMES = "struct<periods:array<string>,lunch_start:string,lunch_end:string>"


def relative_dates(refs: DataFrame, ref: str = "reference_date") -> DataFrame:
    """(ref, phrase, date) for 내일, 모레 and every weekday of this, the next and the following week."""
    weeks = ", ".join(
        f"struct('{name} {WEEKDAYS[i]}' AS phrase, date_add(date_sub({ref}, weekday({ref})), {7 * w + i}) AS date)"
        for w, name in enumerate(WEEKS) for i in range(7))
    return refs.select(ref).distinct().select(ref, F.expr(
        f"inline(array(struct('내일' AS phrase, date_add({ref}, 1) AS date), "
        f"struct('모레' AS phrase, date_add({ref}, 2) AS date), {weeks}))"))


def resolve_relative(df: DataFrame, ref: str = "reference_date", phrase: str = "phrase") -> DataFrame:
    """Add ``date`` for a relative phrase, null when unknown.  The table depends on the row's own date only, so it is
    evaluated in place instead of being joined."""
    cases = [f"WHEN {phrase} = '내일' THEN date_add({ref}, 1)", f"WHEN {phrase} = '모레' THEN date_add({ref}, 2)"]
    cases += [f"WHEN {phrase} = '{name} {WEEKDAYS[i]}' THEN date_add(date_sub({ref}, weekday({ref})), {7 * w + i})"
              for w, name in enumerate(WEEKS) for i in range(7)]
    return df.select("*", F.expr(f"CASE {' '.join(cases)} END").alias("date"))


def describe(enabled: str, work_start: str, work_end: str, lesson: str, periods: str, lunch_start: str,
             lunch_end: str) -> str:
    """Timetable as text for a prompt; '' when disabled, periods with an unreadable start left out."""
    def line(s: str, i: str) -> str:
        end = let(minutes_of(s), lambda m: f"if({m} IS NULL, null, {clock(f'{m} + {lesson}')})")
        return let(end, lambda e: f"if({e} IS NULL, null, concat({i} + 1, '교시 ', {s}, '~', {e}))")

    listed = f"array_join(array_compact(transform(slice({periods}, 1, {N_PERIODS}), {fn(line, 's', 'i')})), ', ')"
    return (f"if({enabled}, concat_ws('\\n', concat('출근 ', {work_start}, ', 퇴근(퇴청) ', {work_end}, ', 수업 ', "
            f"{lesson}, '분'), nullif({listed}, ''), concat('점심시간 ', {lunch_start}, '~', {lunch_end})), '')")


def autofill(first: str, lesson: str, pause: str, lunch_after: int = 4) -> str:
    """struct<periods, lunch_start, lunch_end> from the first start (minutes), lesson and break lengths."""
    def start(i: str) -> str:
        after = f"int({i} >= {lunch_after})"
        return f"{first} + {i} * {lesson} + ({i} - {after}) * {pause} + {after} * {LUNCH_MINUTES}"

    periods = f"transform(sequence(0, {N_PERIODS - 1}), {fn(lambda i: clock(start(i)))})"
    lunch = f"{first} + {lunch_after} * {lesson} + {lunch_after - 1} * {pause}"
    return (f"named_struct('periods', {periods}, 'lunch_start', {clock(lunch)}, "
            f"'lunch_end', {clock(f'{lunch} + {LUNCH_MINUTES}')})")


def _sync_lunch(periods: str, lesson: str, lunch_start: str, lunch_end: str, auto: str) -> str:
    """Lunch runs from the end of the 4th period to the start of the 5th, never backwards."""
    def build(end4: str, start5: str) -> str:
        ok = f"{auto} AND {end4} IS NOT NULL AND {start5} IS NOT NULL"
        return (f"named_struct('periods', {periods}, 'lunch_start', if({ok}, {clock(end4)}, {lunch_start}), "
                f"'lunch_end', if({ok}, {clock(f'greatest({start5}, {end4})')}, {lunch_end}))")
    end4 = f"{minutes_of(f'get({periods}, 3)')} + {lesson}"
    return let(end4, lambda e: let(minutes_of(f"get({periods}, 4)"), lambda s: build(e, s)))


def cascade(changed: str, periods: str, lesson: str, pause: str, lunch_start: str, lunch_end: str,
            auto: str = "true") -> str:
    """Refill the periods behind ``changed`` (0-based) within its block, then lunch.

    An unreadable start leaves everything as it is.
    """
    def moved(ps: str, t: str) -> str:
        ends = " ".join(f"WHEN {changed} BETWEEN {lo} AND {hi} THEN {hi}" for lo, hi in BLOCKS)
        step = f"greatest(1, {lesson} + {pause})"
        body = fn(lambda p, i: f"if({i} > {changed} AND {i} <= CASE {ends} ELSE -1 END, "
                               f"{clock(f'{t} + ({i} - {changed}) * {step}')}, {p})", "p", "i")
        return let(f"transform({ps}, {body})", lambda out: _sync_lunch(out, lesson, lunch_start, lunch_end, auto))

    def refill(ps: str) -> str:
        same = f"named_struct('periods', {periods}, 'lunch_start', {lunch_start}, 'lunch_end', {lunch_end})"
        return let(minutes_of(f"get({ps}, {changed})"), lambda t: (
            f"if({t} IS NULL AND {changed} BETWEEN 0 AND {N_PERIODS - 1}, {same}, {moved(ps, t)})"))

    padded = f"slice(concat({periods}, array_repeat('09:00', {N_PERIODS})), 1, {N_PERIODS})"
    return f"cast({let(padded, refill)} as {_TIMES})"


def cascade_all(periods: str, lesson: str, pause: str, lunch_start: str, lunch_end: str, auto: str = "true") -> str:
    """Refill both blocks from their first period."""
    return let(cascade("0", periods, lesson, pause, lunch_start, lunch_end, auto), lambda t: cascade(
        "4", f"{t}.periods", lesson, pause, f"{t}.lunch_start", f"{t}.lunch_end", auto))


def add_times(df: DataFrame, times: str) -> DataFrame:
    """Add ``periods``, ``lunch_start`` and ``lunch_end`` of a timetable expression."""
    return once(df, times)


def period_at(minutes: str, periods: str, lesson: str) -> str:
    """struct<period, start, end> (minutes) of the period a time falls in, null outside all periods.

    A timetable is a short array beside the row (join it on its user key), so no range join is needed.
    """
    entry = fn(lambda p, i: let(minutes_of(p), lambda m: (
        f"named_struct('period', {i} + 1, 'start', {m}, 'end', {m} + {lesson})")), "p", "i")
    inside = fn(lambda x: f"{minutes} >= {x}.start AND {minutes} < {x}.end")
    return f"get(filter(transform({periods}, {entry}), {inside}), 0)"
