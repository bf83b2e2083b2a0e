"""Dates and times of notices as SQL expression text.  Times of day are minutes (int), item times timestamp_ntz."""
from __future__ import annotations

from noticeflow.functions.text import ascii_digits, let, q, rlike, rx, strip

# ---- fixed values
WEEKDAYS = "월화수목금토일"
WEEKS = ("이번 주", "다음 주", "다다음 주")
NO_DATE = "날짜 없음"
FULL_DATE = r"(\d{4})[-./년]\s*(\d{1,2})[-./월]\s*(\d{1,2})"
MONTH_DAY = r"(\d{1,2})[-./월]\s*(\d{1,2})"
CLOCK = r"(\d{1,2})[:시]\s*(\d{1,2})?"
NO_TIME = ("", "null", "none", "종일", "all day", "all-day")
PAST_DAYS = 30


def weekday(d: str) -> str:
    return f"substring('{WEEKDAYS}', weekday({d}) + 1, 1)"


def make_date(y: str, m: str, d: str) -> str:
    """Date or null; ``make_date`` would raise on an impossible day."""
    return f"try_cast(concat_ws('-', lpad({y}, 4, '0'), lpad({m}, 2, '0'), lpad({d}, 2, '0')) as date)"


def parse_date(s: str, ref: str) -> str:
    """First full date in the text, else month/day in the year of ``ref`` or the next, not over 30 days past.

    A full date that does not exist is null; it does not fall back to month/day.
    """
    full, short = rx(FULL_DATE), rx(MONTH_DAY)

    def group(v: str, pattern: str, i: int) -> str:
        return f"regexp_extract({v}, {q(pattern)}, {i})"

    def search(v: str) -> str:
        whole = make_date(group(v, full, 1), group(v, full, 2), group(v, full, 3))
        whole = f"if({group(v, full, 1)} = '0000', null, {whole})"

        def nearest(this_year: str, next_year: str) -> str:
            limit = f"date_sub({ref}, {PAST_DAYS})"
            return (f"CASE WHEN {this_year} >= {limit} THEN {this_year} "
                    f"WHEN {next_year} >= {limit} THEN {next_year} END")

        md = (group(v, short, 1), group(v, short, 2))
        soon = let(make_date(f"string(year({ref}))", *md), lambda a: let(
            make_date(f"string(year({ref}) + 1)", *md), lambda b: nearest(a, b)))
        return f"CASE WHEN {rlike(v, full)} THEN {whole} WHEN {rlike(v, short)} THEN {soon} END"

    return let(ascii_digits(s), search)


def parse_time(s: str) -> str:
    """Minutes of the day or null; 오후/pm and 오전/am are looked for anywhere in the text."""
    clock = rx(CLOCK)

    def search(v: str) -> str:
        hour = f"int(regexp_extract({v}, {q(clock)}, 1))"
        minute = f"coalesce(try_cast(nullif(regexp_extract({v}, {q(clock)}, 2), '') as int), 0)"
        pm = f"(contains({v}, '오후') OR contains({v}, 'pm'))"
        am = f"(contains({v}, '오전') OR contains({v}, 'am'))"

        def shifted(h: str) -> str:
            later = f"if({pm} AND {h} < 12, {h} + 12, {h})"
            return let(let(later, lambda x: f"if({am} AND {x} = 12, 0, {x})"), lambda x: (
                f"if({x} <= 23 AND {minute} <= 59, {x} * 60 + {minute}, null)"))

        none = f"{v} IN ({', '.join(q(w) for w in NO_TIME)})"
        return f"CASE WHEN {none} OR NOT {rlike(v, clock)} THEN null ELSE {let(hour, shifted)} END"

    return let(f"lower({strip(ascii_digits(s))})", search)


def at(day: str, minutes: str) -> str:
    """timestamp_ntz of a date and minutes of the day."""
    return f"(cast({day} as timestamp_ntz) + make_dt_interval(0, 0, {minutes}, 0))"


def clock(minutes: str) -> str:
    """'HH:MM' of minutes, wrapping at midnight."""
    return f"concat(lpad(string(({minutes}) div 60 % 24), 2, '0'), ':', lpad(string(({minutes}) % 60), 2, '0'))"


def minutes_of(hhmm: str) -> str:
    """Minutes of a strict 'HH:MM', null when malformed."""
    return (f"if({rlike(hhmm, '^(?:2[0-3]|[01]?[0-9]):[0-5]?[0-9]$')}, int(substring_index({hhmm}, ':', 1)) * 60 "
            f"+ int(substring_index({hhmm}, ':', -1)), null)")


def describe_when(start: str, end: str, all_day: str, undated: str) -> str:
    """One line: no date, date, date range, time, same-day time range or cross-day range."""
    day, full = "'yyyy-MM-dd'", "'yyyy-MM-dd HH:mm'"
    s_day, s_full = f"date_format({start}, {day})", f"date_format({start}, {full})"
    same = f"to_date({end}) = to_date({start})"
    return (f"CASE WHEN {undated} THEN '{NO_DATE}' "
            f"WHEN {all_day} AND {end} IS NOT NULL AND NOT {same} THEN concat({s_day}, ' ~ ', date_format({end}, {day})) "
            f"WHEN {all_day} THEN {s_day} "
            f"WHEN {end} IS NULL THEN {s_full} "
            f"WHEN {same} THEN concat({s_full}, '~', date_format({end}, 'HH:mm')) "
            f"ELSE concat({s_full}, ' ~ ', date_format({end}, {full})) END")


def calendar_hint(ref: str) -> str:
    """Three weeks from the Monday of the reference week, then phrases with their dates."""
    def text(monday: str) -> str:
        def day(offset: int) -> str:
            return f"date_format(date_add({monday}, {offset}), 'MM/dd')"

        rows = [f"concat('{name}: ', " + ", ' ', ".join(
            f"{day(7 * w + i)}, '({WEEKDAYS[i]})'" for i in range(7)) + ")" for w, name in enumerate(WEEKS)]
        rel = [f"concat('{name} ', " + ", ' ', ".join(
            f"'{WEEKDAYS[i]}=', {day(7 * w + i)}" for i in range(7)) + ")" for w, name in enumerate(WEEKS[:2])]
        rel = [f"concat('내일=', date_format(date_add({ref}, 1), 'MM/dd'))",
               f"concat('모레=', date_format(date_add({ref}, 2), 'MM/dd'))", *rel]
        return (f"concat('날짜 참고 (기준일이 속한 주부터) — ', concat_ws(' / ', {', '.join(rows)}), "
                f"{q(chr(10) + '상대 표현 대응표: ')}, concat_ws('; ', {', '.join(rel)}))")

    return let(f"date_sub({ref}, weekday({ref}))", text)
