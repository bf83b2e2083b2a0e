"""Shaping of inputs: labels, message and inbox rows, routing, caps, excerpts and prompts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.dates import calendar_hint, weekday
from noticeflow.functions.text import LINE_ENDS, cut_label, is_blank, let, once, q, rstrip, strip
from noticeflow.operators.quotes import CUT_MARK, message_text, split_quotes
from noticeflow.sources.files import base_name

# ---- fixed values
KINDS = ("file", "text", "image", "coolm", "inbox_task")
MESSAGE_LABEL = "쿨메신저"
INBOX_LABEL = "인박스"
MAX_TEXT_CHARS = 40_000
MAX_IMAGES = 10


def source_label(kind: str, payload: str, label: str = "null") -> str:
    """Given label, else file name, '이미지', or the first line of the text cut to 30 characters."""
    first = f"regexp_extract({strip(payload)}, {q(f'^[^{LINE_ENDS}]*')}, 0)"
    line = cut_label(f"if({is_blank(payload)}, '텍스트', {first})", 30)
    return (f"CASE WHEN coalesce({label}, '') <> '' THEN {label} WHEN {kind} = 'file' THEN {base_name(payload)} "
            f"WHEN {kind} = 'image' THEN '이미지' WHEN {kind} = 'text' THEN {line} ELSE '' END")


def messages_to_inputs(messages: DataFrame, history_chars: int | None = None, channel: str = MESSAGE_LABEL,
                       carry: Sequence[str] = ()) -> DataFrame:
    """Messages with a title or body as input rows, and their columns ``carry``; relative dates count from the day of receipt."""
    rows = split_quotes(messages.filter(f"NOT ({is_blank('body')} AND {is_blank('title')})"))
    title = f"if({is_blank('title')}, '', concat(' — ', substring(title, 1, 20)))"
    label = f"concat('{channel}: ', if(coalesce(sender, '') = '', '?', sender), {title})"
    return rows.select(
        F.expr("concat('coolm:', key)").alias("input_id"), F.lit("coolm").alias("kind"),
        F.expr(message_text("title", "sender", "received", "recent", "older", history_chars)).alias("text"),
        F.expr(label).alias("source_label"), F.to_date("received").alias("reference_date"),
        F.col("key").cast("string").alias("origin_ref"), *carry)


def inbox_to_inputs(tasks: DataFrame, run_date: str) -> DataFrame:
    """Open inbox tasks as input rows; the day of the last change is the reference date, else the run date.

    ``run_date`` is an SQL date expression given by the caller, so a run can be repeated.  The day is that of the
    session time zone.
    """
    title, notes = strip("coalesce(title, '')"), strip("coalesce(notes, '')")
    due = "if(coalesce(due, '') = '', '', concat('\\n(마감으로 적어둔 날짜: ', substring(due, 1, 10), ')'))"
    text = f"concat({title}, if({notes} = '', '', concat('\\n', {notes})), {due})"
    return tasks.select(
        F.expr("concat('inbox_task:', list_id, ':', id)").alias("input_id"), F.lit("inbox_task").alias("kind"),
        F.expr(text).alias("text"), F.expr(f"concat('{INBOX_LABEL}: ', substring({title}, 1, 30))").alias("source_label"),
        F.expr(f"coalesce(to_date(try_cast(updated as timestamp)), {run_date})").alias("reference_date"),
        F.expr("concat(list_id, ':', id)").alias("origin_ref"))


def route(inputs: DataFrame) -> DataFrame:
    """Add ``parser`` by kind and ``error`` for blank text and unknown kinds."""
    return inputs.select("*", F.expr(
        "CASE kind WHEN 'file' THEN 'file' WHEN 'image' THEN 'image' WHEN 'text' THEN 'text' "
        "WHEN 'coolm' THEN 'text' WHEN 'inbox_task' THEN 'text' END").alias("parser"), F.expr(
        f"CASE WHEN kind IN ('text', 'coolm', 'inbox_task') AND {is_blank('text')} THEN '빈 텍스트입니다.' "
        "WHEN kind IN ('file', 'image', 'text', 'coolm', 'inbox_task') THEN null "
        "ELSE concat('알 수 없는 입력 종류: ', coalesce(kind, 'None')) END").alias("error"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) by the ``error`` column."""
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL")


def cap_input(df: DataFrame, text: str = "text", images: str | None = None, max_chars: int | None = None,
              max_images: int | None = None) -> DataFrame:
    """Add ``capped``, ``n_images`` and ``warnings`` about what was cut; without limits nothing is.

    A model with a small window takes ``MAX_TEXT_CHARS`` and ``MAX_IMAGES``.
    """
    n = f"coalesce({images}, 0)" if images else "0"
    max_chars, max_images = (2**31 - 1 if m is None else m for m in (max_chars, max_images))
    long = f"if(length({text}) > {max_chars}, '텍스트가 길어 앞 {max_chars:,}자만 분석했습니다.', null)"
    many = f"if({n} > {max_images}, '이미지가 많아 앞 {max_images}장만 분석했습니다.', null)"
    return df.select("*", F.expr(f"substring(coalesce({text}, ''), 1, {max_chars})").alias("capped"),
                     F.expr(f"least({n}, {max_images})").alias("n_images"),
                     F.expr(f"array_compact(array({long}, {many}))").alias("warnings"))


def excerpt(text: str, chars: int | None = None, n_images: str = "0") -> str:
    """Stripped text, cut to ``chars`` if given; '(이미지 n장 입력)' for image input; '' for 0."""
    if chars is not None and chars <= 0:
        return "''"
    shown = let(strip(f"coalesce({text}, '')"), lambda t: (
        f"if({t} = '' AND {n_images} > 0, concat('(이미지 ', {n_images}, '장 입력)'), {t})"))
    if chars is None:
        return shown
    return let(shown, lambda t: (
        f"if(length({t}) > {chars}, concat({rstrip(f'substring({t}, 1, {chars})')}, {q(CUT_MARK)}), {t})"))


def prompt(text: str, ref: str, source: str = "''", *, timetable: str = "''", persona: str = "''",
           has_images: str = "false", kind_rules: str = "''", categories: str | None = None,
           category_rules: str = "''") -> str:
    """Request text: reference date, hints, optional sections, then the delimited input.

    All arguments are SQL expressions; a section is left out when its value is blank.  ``categories`` is an
    array<string> expression.
    """
    def section(head: str, value: str) -> list[str]:
        on = f"NOT {is_blank(value)}"
        return [f"if({on}, '', null)", f"if({on}, {q(head)}, null)", f"if({on}, {strip(value)}, null)"]

    listed = f"coalesce(size({categories}), 0) > 0" if categories else "false"
    rules = f"NOT {is_blank(category_rules)}"
    names = f"array_join(transform({categories}, c -> concat('\"', c, '\"')), ', ')" if categories else "''"
    parts = [
        f"concat('기준일: ', date_format({ref}, 'yyyy-MM-dd'), ' (', {weekday(ref)}, '요일)')",
        calendar_hint(ref),
        f"if(coalesce({source}, '') <> '', concat('출처: ', {source}), null)",
        *section("=== 시간표 참고 (교시·점심·출퇴근 표현 해석용) ===", timetable),
        *section("=== 사용자 역할 (scope 판단 기준) ===", persona),
        f"if({has_images}, '첨부 이미지의 내용도 함께 분석하세요.', null)",
        *section("=== 사용자 분류 규칙 (event/task 판단 시 기본 규칙보다 우선) ===", kind_rules),
        f"if({listed}, '', null)",
        f"if({listed}, '=== 태스크 카테고리 ===', null)",
        f"if({listed}, concat('task 항목의 category 는 다음 목록 중 하나의 이름을 그대로 씁니다 (없으면 null): ', {names}), null)",
        f"if({listed} AND {rules}, '카테고리 선택 규칙:', null)",
        f"if(NOT {listed} AND {rules}, '', null)",
        f"if(NOT {listed} AND {rules}, '=== 태스크 카테고리 규칙 (category 필드에 반영) ===', null)",
        f"if({rules}, {strip(category_rules)}, null)",
        "''",
        f"if({is_blank(text)}, '(텍스트 없음 — 이미지에서 추출)', {q('=== 입력 시작 ===')})",
        f"if({is_blank(text)}, null, {strip(text)})",
        f"if({is_blank(text)}, null, '=== 입력 끝 ===')",
    ]
    return f"concat_ws({q(chr(10))}, {', '.join(parts)})"


def add_prompt(df: DataFrame, out: str = "prompt", **columns) -> DataFrame:
    return once(df, f"named_struct('{out}', {prompt(**columns)})")
