"""Input shaping, quoted text, prompts, relative dates and the timetable."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeflow.functions.dates import calendar_hint, describe_when
from noticeflow.operators import inputs as I
from noticeflow.operators import quotes as Q
from noticeflow.operators import timetable as T
from noticeflow.queries import query, table
from noticeflow.queries.messages import BLANKS

NL = "chr(10)"
_LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


@query("source_labels", f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'given ' || doc_id WHEN 1 THEN 'notice ' || doc_id || '.hwp' WHEN 2 THEN '이미지'
       ELSE CASE WHEN length(line) > 30 THEN substring(line, 1, 30) || '…' ELSE line END END AS label
FROM (SELECT doc_id, CASE WHEN s = '' THEN '텍스트' ELSE regexp_extract(s, '^[^\\n\\r\\v\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*') END AS line
      FROM (SELECT doc_id, trim(CASE WHEN doc_id % 20 = 3 THEN '  ' ELSE text END, {BLANKS}) AS s FROM documents))
""")
def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 1 THEN 'file' WHEN 2 THEN 'image' ELSE 'text' END AS kind",
        "CASE WHEN doc_id % 4 = 1 THEN concat('/inbox/a/notice ', doc_id, '.hwp') WHEN doc_id % 20 = 3 THEN '  ' "
        "ELSE text END AS payload", "if(doc_id % 4 = 0, concat('given ', doc_id), '') AS given")
    return rows.selectExpr("doc_id", f"{I.source_label('kind', 'payload', 'given')} AS label")


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS key", "if(turn % 7 = 6, '', role) AS sender",
        "timestamp_ntz'2024-01-01 09:30:00' + make_dt_interval(int(conv_id)) AS received",
        "if(turn % 2 = 0, substring(text, 1, 40), '') AS title", "if(turn % 5 = 1, ' ', text) AS body")


_CHAT = """
chat AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 7 = 6 THEN '' ELSE role END AS sender,
                TIMESTAMP '2024-01-01 09:30:00' + INTERVAL (conv_id) DAY AS received,
                CASE WHEN turn % 2 = 0 THEN substring(text, 1, 40) ELSE '' END AS title,
                CASE WHEN turn % 5 = 1 THEN ' ' ELSE text END AS body FROM conversations)
"""


@query("message_inputs", f"""
WITH {_CHAT}
SELECT 'coolm:' || key AS input_id, '쿨메신저: ' || CASE WHEN sender = '' THEN '?' ELSE sender END
       || CASE WHEN trim(title, {BLANKS}) = '' THEN '' ELSE ' — ' || substring(title, 1, 20) END AS source_label,
       strftime(received, '%Y-%m-%d') AS reference_date, CAST(key AS VARCHAR) AS origin_ref,
       md5(CASE WHEN trim(title, {BLANKS}) = '' THEN '' ELSE '제목: ' || trim(title, {BLANKS}) || {NL} END
           || CASE WHEN sender = '' THEN '' ELSE '보낸 사람: ' || sender || {NL} END
           || '받은 시각: ' || strftime(received, '%Y-%m-%d %H:%M') || {NL} || {NL} || trim(body, {BLANKS})) AS text_md5
FROM chat WHERE NOT (trim(body, {BLANKS}) = '' AND trim(title, {BLANKS}) = '')
""")
def message_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return I.messages_to_inputs(chat_messages(spark, sf)).selectExpr(
        "input_id", "source_label", "string(reference_date) AS reference_date", "origin_ref", "md5(text) AS text_md5")


@query("inbox_inputs", """
SELECT 'inbox_task:L' || o_custkey % 5 || ':' || o_orderkey AS input_id, 'L' || o_custkey % 5 || ':' || o_orderkey AS origin_ref,
       o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'note ' || o_orderkey ELSE '' END
         || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '(마감으로 적어둔 날짜: ' || strftime(o_orderdate, '%Y-%m-%d') || ')' ELSE '' END AS text,
       '인박스: ' || o_orderpriority AS source_label,
       CASE WHEN o_orderkey % 4 = 0 THEN '2026-06-08' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS reference_date
FROM orders
""")
def inbox_inputs(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "concat('L', o_custkey % 5) AS list_id", "concat(' ', o_orderpriority) AS title",
        "if(o_orderkey % 3 = 0, concat('note ', o_orderkey, ' '), if(o_orderkey % 3 = 1, ' ', null)) AS notes",
        "if(o_orderkey % 2 = 0, concat(to_date(o_orderdate), 'T00:00:00.000Z'), null) AS due",
        "CASE o_orderkey % 8 WHEN 0 THEN 'bad' WHEN 4 THEN null ELSE concat(to_date(o_orderdate), 'T05:00:00.000Z') END AS updated")
    return I.inbox_to_inputs(tasks, "date'2026-06-08'").selectExpr(
        "input_id", "origin_ref", "text", "source_label", "string(reference_date) AS reference_date")


@query("message_layout", f"""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN head || {NL} || '확정 ' || c_custkey
       ELSE head || '[최근 내용]' || {NL} || CASE WHEN c_custkey % 4 = 0 THEN '(본문 없음 — 아래 이전 대화만 있음)' ELSE '확정 ' || c_custkey END
            || {NL} || {NL} || '[이전 대화 (참고용 — 최근 내용이 가리키는 것을 해석할 때만 참고, 지나간 일정은 추출하지 말 것)]' || {NL}
            || '홍님이 보낸글 >>' || {NL} || 'abcdefghij' || {NL} || '…(이하 생략)' END AS text
FROM (SELECT c_custkey, '제목: t' || c_custkey || {NL} || '보낸 사람: ' || c_name || {NL} || '받은 시각: 2026-06-08 09:00' || {NL}
             || CASE WHEN c_custkey % 2 = 1 THEN '' ELSE {NL} END AS head FROM customer)
""")
def message_layout(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat(' t', c_custkey) AS title", "c_name AS sender", "timestamp_ntz'2026-06-08 09:00:00' AS received",
        "concat(if(c_custkey % 4 = 0, '', concat('확정 ', c_custkey)), "
        "if(c_custkey % 2 = 1, '', '\\n홍님이 보낸글 >>\\nabcdefghijkl')) AS body")
    split = Q.split_quotes(rows)
    return split.selectExpr(
        "c_custkey", f"{Q.message_text('title', 'sender', 'received', 'recent', 'older', 21)} AS text")


# quoted part behind 'new k': (body tail, expected older), SQL for both engines; k stands for the key
_FORMS = [
    ("'----- 원본 메시지 -----' || chr(10) || '옛 ' || c_custkey", None),
    ("'-----Original Message-----' || chr(10) || 'From: kim' || chr(10) || '옛 ' || c_custkey", None),
    ("'─────────────────' || chr(10) || '옛 ' || c_custkey", None),
    ("'> 옛 ' || c_custkey || chr(10) || '>> 둘' || chr(10) || '> 셋'", "'옛 ' || c_custkey || chr(10) || '둘' || chr(10) || '셋'"),
    ("'보낸 사람: 김' || chr(10) || '보낸 날짜: 2026-06-01' || chr(10) || '옛 ' || c_custkey", None),
    ("'2026-06-01 김선생님이 작성:' || chr(10) || '옛 ' || c_custkey", None),
    ("'김선생님이 보낸글 >>' || chr(10) || '옛 ' || c_custkey", None),
    ("'[교무부] 홍길동 님이 보낸 글 >>' || chr(10) || '옛 ' || c_custkey", None),
    ("'보낸 메시지 전달 >>' || chr(10) || '옛 ' || c_custkey", None),
    ("'On Monday kim wrote:' || chr(10) || '옛 ' || c_custkey", None),
    ("'RE:' || chr(10) || '옛 ' || c_custkey", None),
]
_PLAIN = ["'제목: 안내' || chr(10) || '끝'", "'가 - 나' || chr(10) || '다'", "'> 하나' || chr(10) || '답' || chr(10) || '둘' || chr(10) || '셋'"]
_N = len(_FORMS) + len(_PLAIN)


def _case(exprs: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN c_custkey % {_N} = {i} THEN {e}" for i, e in enumerate(exprs)) + " END"


_TAILS = _case([f[0] for f in _FORMS] + _PLAIN)
_OLDER = _case([f[1] or f[0] for f in _FORMS] + ["''"] * len(_PLAIN))
_RECENT = _case(["'새 ' || c_custkey"] * len(_FORMS) + [f"'새 ' || c_custkey || chr(10) || chr(10) || {p}" for p in _PLAIN])


@query("quote_splitting", f"SELECT c_custkey, {_RECENT} AS recent, {_OLDER} AS older FROM customer")
def quote_splitting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", f"replace('새 ' || c_custkey || chr(10) || chr(10) || {_TAILS}, chr(10), '\\r\\n') AS body")
    rows = rows.selectExpr("c_custkey", f"if(c_custkey % {_N} < {len(_FORMS)}, body, replace(body, '\\r', '')) AS body")
    return Q.split_quotes(rows).select("c_custkey", "recent", "older")


@query("empty_input_filter", f"""
WITH {_CHAT} SELECT key, CASE WHEN trim(body, {BLANKS}) = '' THEN '빈 텍스트입니다.' ELSE '' END AS error FROM chat
""")
def empty_input_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = chat_messages(spark, sf).selectExpr("key", "'coolm' AS kind", "body AS text")
    good, bad = I.split_errors(I.route(rows))
    return good.selectExpr("key", "'' AS error").unionByName(bad.select("key", "error"))


@query("input_routing", """
SELECT event_id, coalesce(parser, '') AS parser,
       CASE WHEN parser = 'text' AND event_id % 10 = 0 THEN '빈 텍스트입니다.' WHEN parser IS NULL THEN '알 수 없는 입력 종류: fax' ELSE '' END AS error
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'text' WHEN 'signup' THEN 'text'
             WHEN 'purchase' THEN 'image' END AS parser FROM events)
""")
def input_routing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'text' WHEN 'signup' THEN 'coolm' "
                    "WHEN 'purchase' THEN 'image' ELSE 'fax' END AS kind", "if(event_id % 10 = 0, ' ', props) AS text")
    return I.route(rows).selectExpr("event_id", "coalesce(parser, '') AS parser", "coalesce(error, '') AS error")


@query("input_caps", """
SELECT doc_id, md5(substring(text, 1, 1000)) AS text_md5, least(doc_id % 15, 10) AS n_images,
       concat_ws('|', CASE WHEN length(text) > 1000 THEN '텍스트가 길어 앞 1,000자만 분석했습니다.' END,
                 CASE WHEN doc_id % 15 > 10 THEN '이미지가 많아 앞 10장만 분석했습니다.' END) AS warnings FROM documents
""")
def input_caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr("doc_id", "text", "doc_id % 15 AS images")
    return I.cap_input(rows, images="images", max_chars=1000, max_images=10).selectExpr(
        "doc_id", "md5(capped) AS text_md5", "n_images", "array_join(warnings, '|') AS warnings")


@query("source_excerpts", f"""
SELECT doc_id, CASE WHEN length(s) > 100 THEN rtrim(substring(s, 1, 100), {BLANKS}) || {NL} || '…(이하 생략)' ELSE s END AS excerpt
FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '(이미지 2장 입력)' ELSE trim(text, {BLANKS}) END AS s FROM documents)
""")
def source_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "if(doc_id % 9 = 0, ' ', text) AS text", "if(doc_id % 9 = 0, 2, 0) AS n").selectExpr(
        "doc_id", f"{I.excerpt('text', 100, 'n')} AS excerpt")


# ---------------------------------------------------------------- dates

_MONDAY = "(d - CAST(isodow(d) - 1 AS INTEGER))"
_WEEKS = ("이번 주", "다음 주", "다다음 주")
_DAYS = "월화수목금토일"
_PHRASES = ", ".join(f"('{w} {x}', {7 * i + j})" for i, w in enumerate(_WEEKS) for j, x in enumerate(_DAYS))
_DATES = "dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


@query("relative_dates", f"""
WITH {_DATES}, p AS (SELECT * FROM (VALUES {_PHRASES}) v(phrase, n))
SELECT strftime(d, '%Y-%m-%d') AS ref, phrase, strftime({_MONDAY} + n, '%Y-%m-%d') AS date FROM dates, p
UNION ALL SELECT strftime(d, '%Y-%m-%d'), '내일', strftime(d + 1, '%Y-%m-%d') FROM dates
UNION ALL SELECT strftime(d, '%Y-%m-%d'), '모레', strftime(d + 2, '%Y-%m-%d') FROM dates
""")
def relative_dates(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "orders").selectExpr("to_date(o_orderdate) AS reference_date")
    return T.relative_dates(refs).selectExpr("string(reference_date) AS ref", "phrase", "string(date) AS date")


@query("relative_date_lookup", f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN d + 1 WHEN 1 THEN {_MONDAY} + 10 WHEN 2 THEN {_MONDAY} + 20 END, '%Y-%m-%d') AS date
FROM o WHERE o_orderkey % 4 <> 3
""")
def relative_date_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "to_date(o_orderdate) AS reference_date",
        "element_at(array('내일', '다음 주 목', '다다음 주 일', '언젠가'), int(o_orderkey % 4) + 1) AS phrase")
    return T.resolve_relative(rows).filter("date IS NOT NULL").selectExpr("o_orderkey", "string(date) AS date")


def _sql_days(week: int, form: str) -> str:
    return " || ' ' || ".join(form.format(day=f"strftime({_MONDAY} + {7 * week + i}, '%m/%d')", name=x)
                              for i, x in enumerate(_DAYS))


HINT = ("'날짜 참고 (기준일이 속한 주부터) — ' || " + " || ' / ' || ".join(
    f"'{w}: ' || " + _sql_days(i, "{day} || '({name})'") for i, w in enumerate(_WEEKS))
    + f" || {NL} || '상대 표현 대응표: 내일=' || strftime(d + 1, '%m/%d') || '; 모레=' || strftime(d + 2, '%m/%d') || '; ' || "
    + " || '; ' || ".join(f"'{w} ' || " + _sql_days(i, "'{name}=' || {day}") for i, w in enumerate(_WEEKS[:2])))


@query("calendar_hints", f"WITH {_DATES} SELECT strftime(d, '%Y-%m-%d') AS ref, {HINT} AS hint FROM dates")
def calendar_hints(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "orders").selectExpr("to_date(o_orderdate) AS d").distinct()
    return refs.selectExpr("string(d) AS ref", f"{calendar_hint('d')} AS hint")


@query("prompt_texts", f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p FROM orders)
SELECT o_orderkey, md5('기준일: ' || strftime(d, '%Y-%m-%d') || ' (' || '월화수목금토일'[isodow(d)] || '요일)' || {NL} || {HINT}
  || CASE WHEN o_orderkey % 2 = 0 THEN {NL} || '출처: ' || p ELSE '' END
  || CASE WHEN o_orderkey % 3 = 0 THEN {NL} || {NL} || '=== 사용자 역할 (scope 판단 기준) ===' || {NL} || '담임 ' || o_orderkey ELSE '' END
  || CASE WHEN o_orderkey % 5 = 0 THEN {NL} || {NL} || '=== 태스크 카테고리 ===' || {NL}
     || 'task 항목의 category 는 다음 목록 중 하나의 이름을 그대로 씁니다 (없으면 null): "학교", "' || p || '"' ELSE '' END
  || CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN {NL} || '카테고리 선택 규칙:'
          ELSE {NL} || {NL} || '=== 태스크 카테고리 규칙 (category 필드에 반영) ===' END || {NL} || '규칙' ELSE '' END
  || {NL} || CASE WHEN o_orderkey % 11 = 0 THEN {NL} || '(텍스트 없음 — 이미지에서 추출)'
     ELSE {NL} || '=== 입력 시작 ===' || {NL} || '주문 ' || o_orderkey || {NL} || '=== 입력 끝 ===' END) AS prompt_md5 FROM o
""")
def prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "to_date(o_orderdate) AS d", "if(o_orderkey % 2 = 0, o_orderpriority, '') AS source",
        "if(o_orderkey % 3 = 0, concat(' 담임 ', o_orderkey), ' ') AS persona",
        "if(o_orderkey % 5 = 0, array('학교', o_orderpriority), null) AS categories", "if(o_orderkey % 7 = 0, '규칙', '') AS rules",
        "if(o_orderkey % 11 = 0, ' ', concat(' 주문 ', o_orderkey, '\\n')) AS text")
    made = I.add_prompt(rows, text="text", ref="d", source="source", persona="persona", categories="categories",
                        category_rules="rules")
    return made.selectExpr("o_orderkey", "md5(prompt) AS prompt_md5")


@query("when_descriptions", """
WITH o AS (SELECT o_orderkey, o_orderdate AS d, o_orderdate + INTERVAL (o_orderkey % 600) MINUTE AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '날짜 없음' WHEN 1 THEN strftime(d, '%Y-%m-%d')
       WHEN 2 THEN strftime(d, '%Y-%m-%d') || ' ~ ' || strftime(d + INTERVAL 2 DAY, '%Y-%m-%d') WHEN 3 THEN strftime(t, '%Y-%m-%d %H:%M')
       WHEN 4 THEN strftime(t, '%Y-%m-%d %H:%M') || '~' || strftime(t + INTERVAL 1 HOUR, '%H:%M')
       WHEN 5 THEN strftime(t, '%Y-%m-%d %H:%M') || ' ~ ' || strftime(t + INTERVAL 2 DAY, '%Y-%m-%d %H:%M')
       ELSE strftime(d, '%Y-%m-%d') END AS when_text FROM o
""")
def when_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderkey % 7 AS k", "o_orderdate + make_dt_interval(0, 0, int(o_orderkey % 600)) AS t", "o_orderdate AS d")
    rows = rows.selectExpr(
        "o_orderkey", "k = 0 AS undated", "k IN (0, 1, 2, 6) AS all_day", "if(k IN (3, 4, 5), t, d) AS start",
        "CASE k WHEN 2 THEN d + INTERVAL 2 DAYS WHEN 4 THEN t + INTERVAL 1 HOUR WHEN 5 THEN t + INTERVAL 2 DAYS WHEN 6 THEN d END AS end")
    return rows.selectExpr("o_orderkey", f"{describe_when('start', 'end', 'all_day', 'undated')} AS when_text")


# ---------------------------------------------------------------- timetable

def _hm(minutes: str) -> str:
    return f"lpad(CAST(({minutes}) // 60 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({minutes}) % 60 AS VARCHAR), 2, '0')"


_BASE = ("540", "595", "650", "705", "810", "865", "920")


@query("timetable_texts", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '출근 08:30, 퇴근(퇴청) 16:30, 수업 ' || p_size || '분' || chr(10) || "
       + " || ', ' || ".join(f"'{i}교시 ' || {_hm(m)} || '~' || {_hm(m + ' + p_size')}" for i, m in enumerate(_BASE, 1) if i != 3)
       + " || chr(10) || '점심시간 12:30~13:20' END AS timetable FROM part")
def timetable_texts(spark: SparkSession, sf: str) -> DataFrame:
    periods = "array('09:00', '09:55', '10.50', '11:45', '13:30', '14:25', '15:20')"
    text = T.describe("p_partkey % 5 <> 0", "'08:30'", "'16:30'", "p_size", periods, "'12:30'", "'13:20'")
    return table(spark, sf, "part").selectExpr("p_partkey", f"{text} AS timetable")


@query("period_autofill", "SELECT p_partkey, " + " || ' ' || ".join(
    _hm(f"540 + {i} * p_size + {i - int(i >= 4)} * 10 + {50 * int(i >= 4)}") for i in range(7))
    + f" AS periods, {_hm('540 + 4 * p_size + 30')} AS lunch_start, {_hm('540 + 4 * p_size + 80')} AS lunch_end FROM part")
def period_autofill(spark: SparkSession, sf: str) -> DataFrame:
    filled = T.add_times(table(spark, sf, "part"), T.autofill("540", "p_size", "10"))
    return filled.selectExpr("p_partkey", "array_join(periods, ' ') AS periods", "lunch_start", "lunch_end")


def _cascaded(changed: int) -> list[str]:
    hi = 3 if changed <= 3 else 6
    return [f"{_BASE[changed]} + {i - changed} * (p_size + 10)" if changed < i <= hi else _BASE[i] for i in range(7)]


def _cascade_case(pick) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % 7 = {c} THEN {pick(_cascaded(c))}" for c in range(7)) + " END"


@query("period_cascade", "SELECT p_partkey, " + _cascade_case(lambda t: " || ' ' || ".join(_hm(m) for m in t)) + " AS periods, "
       + _cascade_case(lambda t: _hm(f"{t[3]} + p_size")) + " AS lunch_start, "
       + _cascade_case(lambda t: _hm(f"greatest({t[4]}, {t[3]} + p_size)")) + " AS lunch_end FROM part")
def period_cascade(spark: SparkSession, sf: str) -> DataFrame:
    base = "array('09:00', '09:55', '10:50', '11:45', '13:30', '14:25', '15:20')"
    moved = T.add_times(table(spark, sf, "part"), T.cascade("int(p_partkey % 7)", base, "p_size", "10", "'12:30'", "'13:20'"))
    return moved.selectExpr("p_partkey", "array_join(periods, ' ') AS periods", "lunch_start", "lunch_end")


@query("period_lookup", "SELECT event_id, CASE " + " ".join(
    f"WHEN m >= {b} AND m < {b} + 45 THEN {i}" for i, b in enumerate(_BASE, 1)) + " END AS period, CASE " + " ".join(
    f"WHEN m >= {b} AND m < {b} + 45 THEN {b}" for b in _BASE)
    + " END AS period_start FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events) WHERE "
    + " OR ".join(f"(m >= {b} AND m < {b} + 45)" for b in _BASE))
def period_lookup(spark: SparkSession, sf: str) -> DataFrame:
    base = "array('09:00', '09:55', '10:50', '11:45', '13:30', '14:25', '15:20')"
    rows = table(spark, sf, "events").selectExpr("event_id", "hour(ts) * 60 + minute(ts) AS m")
    found = rows.selectExpr("event_id", f"{T.period_at('m', base, '45')} AS p").filter("p IS NOT NULL")
    return found.selectExpr("event_id", "p.period AS period", "p.start AS period_start")
