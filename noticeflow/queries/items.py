"""Model responses to items: JSON, rows, dates and times, normalisation, scope, warnings, the completion hook."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions.dates import parse_date, parse_time
from noticeflow.operators import items as I
from noticeflow.operators import responses as R
from noticeflow.operators.completion import complete_with_retries
from noticeflow.plans import paths
from noticeflow.plans.spread import spread
from noticeflow.queries import query, table

_ITEM = "'{\"title\": \"t' || c_custkey || '\", \"date\": \"2026-09-0' || (c_custkey % 9 + 1) || '\"}'"


def _case(n: int, exprs: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN c_custkey % {n} = {i} THEN {e}" for i, e in enumerate(exprs)) + " END"


# ---------------------------------------------------------------- JSON and rows

_JSON_FORMS = [
    (_ITEM, 1), (f"'```json' || chr(10) || {_ITEM} || chr(10) || '```'", 1), (f"'결과: ' || {_ITEM} || ' 입니다'", 1),
    (f"'[' || {_ITEM} || ']'", 1), (f"'목록 [' || {_ITEM} || ', ' || {_ITEM} || '] 끝'", 1), ("'not json ' || c_custkey", -1),
    ("'null'", 0), (f"'3 items: ' || {_ITEM}", 1), (f"'``` ' || {_ITEM} || ' ``` and ``` x ```'", 1), (f"{_ITEM} || ' ' || {_ITEM}", -1),
]


@query("json_extraction", f"SELECT c_custkey, {_case(10, [str(n) for _, n in _JSON_FORMS])} AS n_items, "
       f"CASE WHEN {_case(10, [str(n) for _, n in _JSON_FORMS])} > 0 THEN 't' || c_custkey ELSE '' END AS title FROM customer")
def json_extraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", f"{_case(10, [f for f, _ in _JSON_FORMS])} AS raw", "date'2026-08-28' AS reference_date", "'s' AS source")
    return R.parse_responses(rows).selectExpr(
        "c_custkey", "if(error IS NULL, size(items), -1) AS n_items", "coalesce(get(items, 0).title, '') AS title")


_ROW_FORMS = [
    (f"'{{\"items\": [' || {_ITEM} || ']}}'", 1, 0), (f"'{{\"items\": [], \"schedules\": [' || {_ITEM} || ']}}'", 1, 0),
    (f"'{{\"items\": null, \"events\": [' || {_ITEM} || ', 5]}}'", 1, 1), (_ITEM, 1, 0), ("'{\"scope\": \"relevant\"}'", 0, 0),
    ("'{\"title\": null}'", 0, 1), ("'{\"items\": {\"a\": 1, \"b\": 2}}'", 0, 2), ("'[]'", 0, 0),
]


@query("response_rows", f"SELECT c_custkey, {_case(8, [str(n) for _, n, _ in _ROW_FORMS])} AS n_items, "
       f"{_case(8, [str(s) for _, _, s in _ROW_FORMS])} AS skipped FROM customer")
def response_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", f"{_case(8, [f for f, _, _ in _ROW_FORMS])} AS raw", "date'2026-08-28' AS reference_date", "'s' AS source")
    return R.parse_responses(rows).selectExpr("c_custkey", "size(items) AS n_items", "skipped")


@query("row_validation", """
SELECT c_custkey, 'a ' || c_custkey || ' b' AS title, 0.5 + (c_custkey % 10) / 20.0 AS confidence, 6 AS skipped FROM customer
""")
def row_validation(spark: SparkSession, sf: str) -> DataFrame:
    raw = ("concat('{\"items\": [{\"title\": \" a  ', c_custkey, '\\\\n b \", \"date\": \"2026-09-01\", \"confidence\": \"', "
           "0.5D + (c_custkey % 10) / 20.0D, '\", \"x\": 1}, {\"title\": \" \", \"date\": \"2026-09-01\"}, {\"title\": 5, "
           "\"date\": \"2026-09-01\"}, {\"title\": \"n\", \"date\": \"2026-09-01\", \"time\": 7}, {\"title\": \"n\", \"date\": "
           "\"2026-09-01\", \"confidence\": \"high\"}, \"text\", {\"title\": \"no date\"}]}')")
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", f"{raw} AS raw", "date'2026-08-28' AS reference_date", "'s' AS source")
    return R.parse_responses(rows).selectExpr(
        "c_custkey", "items[0].title AS title", "items[0].confidence AS confidence", "skipped")


# ---------------------------------------------------------------- dates, times, normal form

@query("date_parsing", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 4 THEN strftime(d, '%Y-%m-%d')
       WHEN k IN (4, 5) THEN CASE WHEN month(d) = 2 AND day(d) = 29 THEN '2000-02-29'
            WHEN make_date(1999, month(d), day(d)) >= DATE '1999-06-15' - 30 THEN '1999-' || strftime(d, '%m-%d')
            ELSE '2000-' || strftime(d, '%m-%d') END ELSE '' END AS date
FROM o
""")
def date_parsing(spark: SparkSession, sf: str) -> DataFrame:
    text = ("CASE o_orderkey % 8 WHEN 0 THEN date_format(d, 'yyyy-MM-dd') WHEN 1 THEN date_format(d, 'yyyy.M.d') "
            "WHEN 2 THEN concat('기한 ', date_format(d, 'yyyy'), '년 ', date_format(d, 'M'), '월 ', date_format(d, 'd'), '일까지') "
            "WHEN 3 THEN date_format(d, 'yyyy/MM/dd') WHEN 4 THEN date_format(d, 'M/d') "
            "WHEN 5 THEN concat(date_format(d, 'M'), '월 ', date_format(d, 'd'), '일') "
            "WHEN 6 THEN concat(date_format(d, 'yyyy'), '-02-30') ELSE '언젠가' END")
    rows = spread(table(spark, sf, "orders")).selectExpr("o_orderkey", "to_date(o_orderdate) AS d")
    reference = "date'1999-06-15'"
    return rows.selectExpr("o_orderkey", f"{text} AS s").selectExpr(
        "o_orderkey", f"coalesce(string({parse_date('s', reference)}), '') AS date")


@query("time_parsing", """
WITH e AS (SELECT event_id, hour(ts) AS h, minute(ts) AS m, event_id % 6 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN h * 60 + m WHEN 1 THEN h * 60 WHEN 2 THEN (h % 12) * 60 + m + CASE WHEN h >= 12 THEN 720 ELSE 0 END
       WHEN 3 THEN h * 60 + m ELSE -1 END AS minutes FROM e
""")
def time_parsing(spark: SparkSession, sf: str) -> DataFrame:
    twelve = "if(hour(ts) % 12 = 0, 12, hour(ts) % 12)"
    text = ("CASE event_id % 6 WHEN 0 THEN date_format(ts, 'HH:mm') WHEN 1 THEN concat(hour(ts), '시') "
            f"WHEN 2 THEN concat(if(hour(ts) >= 12, '오후 ', '오전 '), {twelve}, '시 ', minute(ts), '분') "
            f"WHEN 3 THEN concat({twelve}, ':', date_format(ts, 'mm'), if(hour(ts) >= 12, ' PM', ' AM')) "
            "WHEN 4 THEN concat(hour(ts) + 24, ':00') ELSE 'All Day' END")
    return spread(table(spark, sf, "events")).selectExpr("event_id", f"{text} AS s").selectExpr(
        "event_id", f"coalesce({parse_time('s')}, -1) AS minutes")


@query("item_normalisation", """
WITH o AS (SELECT *, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
     n AS (SELECT o_orderkey, CASE WHEN k IN (1, 3, 7) THEN 'task' ELSE 'event' END AS kind,
       CASE k WHEN 0 THEN d + INTERVAL 840 MINUTE WHEN 2 THEN CAST(d AS TIMESTAMP) WHEN 3 THEN TIMESTAMP '1999-06-15' WHEN 4 THEN d + INTERVAL 600 MINUTE
              WHEN 5 THEN d + INTERVAL 840 MINUTE ELSE CAST(d AS TIMESTAMP) END AS s,
       CASE k WHEN 0 THEN d + INTERVAL 960 MINUTE WHEN 2 THEN CAST(d + 3 AS TIMESTAMP) WHEN 5 THEN d + 2 + INTERVAL 840 MINUTE
              WHEN 7 THEN CAST(d AS TIMESTAMP) END AS e,
       k NOT IN (0, 4, 5) AS all_day, k = 3 AS undated,
       CASE WHEN k = 3 THEN NULL ELSE 'room ' || o_custkey END AS location,
       least(greatest(o_totalprice / 100000 - 1, 0), 1) AS confidence FROM o WHERE k <> 6)
SELECT o_orderkey, kind, strftime(s, '%Y-%m-%d %H:%M') AS start_at, coalesce(strftime(e, '%Y-%m-%d %H:%M'), '') AS end_at,
       CAST(all_day AS INTEGER) AS all_day, CAST(undated AS INTEGER) AS undated, coalesce(location, '') AS location,
       confidence FROM n
""")
def item_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    """Timed with end time, task, range, undated task, end before start, end date only, undated event (dropped) and an
    all-day task with an end time."""
    d = "date_format(o_orderdate, 'yyyy-MM-dd')"
    raw = spread(table(spark, sf, "orders")).selectExpr(
        "o_orderkey", "date'1999-06-15' AS reference_date", "'s' AS source", "concat('t', o_orderkey) AS title",
        f"if(o_orderkey % 8 IN (3, 6), null, {d}) AS date",
        "CASE o_orderkey % 8 WHEN 0 THEN '오후 2시' WHEN 4 THEN '10:00' WHEN 5 THEN '14:00' WHEN 3 THEN '09:00' ELSE 'null' END AS time",
        "CASE o_orderkey % 8 WHEN 2 THEN date_format(o_orderdate + INTERVAL 3 DAYS, 'yyyy.MM.dd') "
        "WHEN 4 THEN date_format(o_orderdate - INTERVAL 3 DAYS, 'yyyy-MM-dd') "
        "WHEN 5 THEN date_format(o_orderdate + INTERVAL 2 DAYS, 'yyyy-MM-dd') END AS end_date",
        "CASE o_orderkey % 8 WHEN 0 THEN '16:00' WHEN 4 THEN '09:00' WHEN 7 THEN '15:00' END AS end_time",
        "CASE WHEN o_orderkey % 8 IN (1, 3) THEN 'Task' WHEN o_orderkey % 8 = 7 THEN 'tasks' WHEN o_orderkey % 8 = 2 THEN null "
        "ELSE 'event' END AS kind", "' ' AS category", "concat(' room ', o_custkey) AS location", "null AS notes",
        "o_totalprice / 100000 - 1 AS confidence")
    raw = raw.withColumn("notes", F.lit(None).cast("string"))
    return I.normalize_items(raw).selectExpr(
        "o_orderkey", "kind", "date_format(start, 'yyyy-MM-dd HH:mm') AS start_at",
        "coalesce(date_format(end, 'yyyy-MM-dd HH:mm'), '') AS end_at", "int(all_day) AS all_day", "int(undated) AS undated",
        "coalesce(location, '') AS location", "confidence")


# ---------------------------------------------------------------- within an input

_LINES = ("l_orderkey", "l_returnflag AS title", "date_trunc('MONTH', l_shipdate) AS start", "l_linestatus AS kind",
          "l_quantity < 10 AS undated", "l_partkey * 1000000L + l_suppkey * 100L + l_linenumber AS pos")


@query("item_deduplication", """
SELECT l_orderkey, l_returnflag AS title, strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month, l_linestatus AS kind,
       CAST(l_quantity < 10 AS INTEGER) AS undated, min(l_partkey * 1000000 + l_suppkey * 100 + l_linenumber) AS pos
FROM lineitem GROUP BY ALL
""")
def item_deduplication(spark: SparkSession, sf: str) -> DataFrame:
    first = I.dedupe_items(table(spark, sf, "lineitem").selectExpr(*_LINES), ["l_orderkey"])
    return first.selectExpr("l_orderkey", "title", "date_format(start, 'yyyy-MM') AS month", "kind", "int(undated) AS undated", "pos")


@query("item_order", """
SELECT title, pos, row_number() OVER (PARTITION BY title ORDER BY undated, start, pos) AS item_no
FROM (SELECT DISTINCT l_returnflag AS title, l_shipdate + INTERVAL (l_partkey) SECOND AS start, l_quantity < 10 AS undated,
             l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS pos FROM lineitem)
""")
def item_order(spark: SparkSession, sf: str) -> DataFrame:
    """Three inputs hold all rows, so the ranking has to be spread over tasks."""
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS title", "l_shipdate + make_dt_interval(0, 0, 0, l_partkey) AS start", *_LINES[4:]).distinct()
    return I.order_items(rows, ["title"]).select("title", "pos", "item_no")


@query("past_items", """
WITH o AS (SELECT o_custkey, o_orderkey AS item_no, 'order ' || o_orderkey AS title, o_orderstatus = 'P' AS undated,
                  o_orderdate < TIMESTAMP '1998-01-01' AS past FROM orders)
SELECT o_custkey, count(*) AS n_past, list_aggregate(list_slice(list(title ORDER BY item_no), 1, 3), 'string_agg', ', ') AS past_titles,
       (SELECT count(*) FROM o k WHERE k.o_custkey = o.o_custkey AND (k.undated OR NOT k.past)) AS n_kept
FROM o WHERE past AND NOT undated GROUP BY o_custkey
""")
def past_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderkey AS item_no", "concat('order ', o_orderkey) AS title", "o_orderstatus = 'P' AS undated",
        "o_orderdate AS start")
    kept, gone = I.drop_past(rows, "date'1998-01-01'", ["o_custkey"])
    n_kept = kept.groupBy("o_custkey").agg(F.count("*").alias("n_kept"))
    return gone.join(n_kept, "o_custkey", "left").na.fill(0, ["n_kept"])


# ---------------------------------------------------------------- whole responses

_TWO = ("'{\"scope\": \"' || CASE c_custkey % 4 WHEN 0 THEN ' Irrelevant ' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'odd' ELSE 'relevant' END "
        "|| '\", \"scope_reason\": \"' || CASE WHEN c_custkey % 8 < 4 THEN 'r' || c_custkey ELSE '' END || '\", \"items\": ["
        "{\"title\": \"지난 ' || c_custkey || '\", \"date\": \"2026-06-03\", \"kind\": \"task\"}, {\"title\": \"정리 [이름1]\", \"kind\": \"task\", "
        "\"notes\": \"[전화1]로 [이름9]\"}, {\"title\": \"회의\", \"date\": \"2026-06-18\", \"time\": \"14:00\"}, {\"title\": \"x\"}]}'")


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", f"{_TWO} AS raw", "date'2026-06-08' AS reference_date", "'s' AS source",
        "concat(' 본문 ', c_custkey, ' ') AS text", "map('[이름1]', '김민수', '[전화1]', '010-1234-5678') AS mapping",
        "if(c_custkey % 3 = 0, '', '담임') AS persona", "c_custkey % 5 <> 0 AS skip")


_JUDGED = "c_custkey % 3 <> 0"
_EMPTIED = f"({_JUDGED} AND c_custkey % 4 = 0 AND c_custkey % 5 <> 0)"
_REASON = "CASE WHEN c_custkey % 8 < 4 THEN 'r' || c_custkey ELSE '(이유 없음)' END"


@query("response_scope", f"""
SELECT c_custkey, CASE WHEN NOT {_JUDGED} THEN 'relevant' WHEN c_custkey % 4 = 0 THEN 'irrelevant' WHEN c_custkey % 4 = 1 THEN 'ambiguous'
       ELSE 'relevant' END AS scope, CASE WHEN {_JUDGED} AND c_custkey % 8 < 4 THEN 'r' || c_custkey ELSE '' END AS scope_reason,
       CASE WHEN {_EMPTIED} THEN 0 ELSE 2 END AS n_items, 1 AS n_past, 1 AS skipped FROM customer
""")
def response_scope(spark: SparkSession, sf: str) -> DataFrame:
    parsed = R.parse_responses(_responses(spark, sf), drop_before="reference_date", persona="persona", skip_irrelevant="skip")
    return parsed.selectExpr("c_custkey", "scope", "scope_reason", "size(items) AS n_items", "n_past", "skipped")


@query("response_warnings", f"""
SELECT c_custkey, concat_ws('|', '날짜를 확정할 수 없는 항목 1개를 제외했습니다.', '06/08 이전의 지나간 항목 1개를 제외했습니다: 지난 ' || c_custkey,
       CASE WHEN {_EMPTIED} THEN '내 업무와 무관한 내용으로 판단해 2개 항목을 등록하지 않습니다: ' || {_REASON} END,
       CASE WHEN {_JUDGED} AND c_custkey % 4 = 1 THEN '내 업무와 관련 있는지 불확실합니다: ' || {_REASON} END) AS warnings FROM customer
""")
def response_warnings(spark: SparkSession, sf: str) -> DataFrame:
    parsed = R.parse_responses(_responses(spark, sf), drop_before="reference_date", persona="persona", skip_irrelevant="skip")
    return parsed.selectExpr("c_custkey", "array_join(warnings, '|') AS warnings")


@query("restored_items", """
SELECT c_custkey, 1 AS item_no, '지난 ' || c_custkey AS title, '' AS notes, '본문 ' || c_custkey AS source_text FROM customer
UNION ALL SELECT c_custkey, 2, '회의', '', '본문 ' || c_custkey FROM customer
UNION ALL SELECT c_custkey, 3, '정리 김민수', '010-1234-5678로 [이름9]', '본문 ' || c_custkey FROM customer
""")
def restored_items(spark: SparkSession, sf: str) -> DataFrame:
    parsed = R.parse_responses(_responses(spark, sf), mapping="mapping", text="text")
    return R.explode_items(parsed, "c_custkey").selectExpr(
        "c_custkey", "item_no", "title", "coalesce(notes, '') AS notes", "source_text")


@query("request_cues", """
SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0
""")
def request_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs that ask for something but gave no item."""
    inputs = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey AS input_id", "if(c_custkey % 3 = 0, '오늘 날씨가 좋네요. 감사합니다.', '동아리 명단을 보내 주세요') AS text")
    items = spread(table(spark, sf, "customer")).filter("c_custkey % 4 = 0").selectExpr("c_custkey AS input_id", "'x' AS title")
    return R.retry_candidates(inputs, items).selectExpr("input_id AS c_custkey")


@query("no_items_notes", """
SELECT c_custkey, n || CASE c_custkey % 3 WHEN 0 THEN '은(는) 내 업무와 무관해 보여 넘겼어요 — ' || CASE WHEN c_custkey % 2 = 0 THEN 'r' ELSE '역할 기준' END
       WHEN 1 THEN '에는 이미 지난 일정만 있네요' ELSE '에 일정이 없네요' END AS note
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '붙여넣은 텍스트' WHEN 1 THEN '쿨메신저 쪽지(' || c_name || ')'
             WHEN 2 THEN '인박스 항목(' || c_name || ')' ELSE c_name END AS n FROM customer)
""")
def no_items_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", "element_at(array('text', 'coolm', 'inbox_task', 'file'), int(c_custkey % 4) + 1) AS kind",
        "concat(element_at(array('', '쿨메신저: ', '인박스: ', ''), int(c_custkey % 4) + 1), c_name) AS label",
        "if(c_custkey % 3 = 0, 'irrelevant', 'relevant') AS scope", "if(c_custkey % 2 = 0, 'r', '') AS reason",
        "int(c_custkey % 3 = 1) AS n_past")
    return rows.selectExpr("c_custkey", f"{R.no_items_note('kind', 'label', 'scope', 'reason', 'n_past')} AS note")


@query("completion_hook", """
SELECT c_custkey AS input_id, CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 2 END AS attempts,
       CASE c_custkey % 5 WHEN 3 THEN 'ConnectionError: down' WHEN 4 THEN '모델 응답을 해석할 수 없습니다' ELSE '' END AS error,
       CASE c_custkey % 5 WHEN 0 THEN '{"items": [{"title": "fixed", "date": "2026-09-01"}]}'
            WHEN 1 THEN '{"items": [{"title": "one", "date": "2026-09-01"}]}' WHEN 2 THEN '{"items": [{"title": "asked", "kind": "task"}]}'
            WHEN 3 THEN '' ELSE 'never' END AS raw
FROM customer
""")
def completion_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A stub client: needs a repair, works, needs to be asked again, fails, never gives JSON."""
    def make_client():
        def client(prompt: str) -> str:
            kind = prompt[0]
            if kind == "3":
                raise ConnectionError("down")
            if kind == "4":
                return "never"
            if kind == "0":
                return '{"items": [{"title": "fixed", "date": "2026-09-01"}]}' if "JSON" in prompt else "oops"
            if kind == "2":
                return '{"items": [{"title": "asked", "kind": "task"}]}' if "요청·부탁" in prompt else '{"items": []}'
            return '{"items": [{"title": "one", "date": "2026-09-01"}]}'
        return client

    requests = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey AS input_id", "concat(c_custkey % 5, ' prompt') AS prompt", "'명단 제출해 주세요' AS text",
        "date'2026-08-28' AS reference_date")
    return complete_with_retries(requests, make_client).selectExpr(
        "input_id", "attempts", "coalesce(error, '') AS error", "coalesce(raw, '') AS raw")


@query("requests_to_items", """
SELECT key AS input_id, title, notes, warnings FROM (
  SELECT 'coolm:' || (conv_id * 1000 + turn) AS key, '상담 ' || role AS title, '번호 010-1234-5678' AS notes,
         '🔒 개인정보 1곳을 가리고 AI에 보냈어요 (전화 1)' AS warnings FROM conversations)
""")
def requests_to_items(spark: SparkSession, sf: str) -> DataFrame:
    """Messages to masked prompts, an answer that repeats a token, and items with the token restored."""
    inputs = table(spark, sf, "conversations").selectExpr(
        "concat('coolm:', conv_id * 1000 + turn) AS input_id", "'coolm' AS kind", "concat(text, '\\n번호 010-1234-5678') AS text",
        "concat('쿨메신저: ', role) AS source_label", "date'2026-06-08' AS reference_date")
    asked = paths.build_requests(inputs)
    answers = asked.selectExpr(
        "input_id", "concat('{\"items\": [{\"title\": \"상담 ', substring(source_label, 7), '\", \"date\": \"6/10\", \"notes\": \"번호 ', "
                    "regexp_extract(prompt, '번호 (\\\\S+)', 1), '\"}, {\"title\": \"옛\", \"date\": \"2026-06-01\"}]}') AS raw")
    extractions, items = paths.items_from_responses(asked, answers)
    return items.join(extractions.selectExpr("input_id", "warnings[0] AS warnings"), "input_id").select(
        "input_id", "title", "notes", "warnings")
