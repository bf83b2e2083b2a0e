"""Decisions and registration on orders: an order is an item, its customer an input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators import decisions as D
from noticeflow.operators import registration as G
from noticeflow.plans.paths import success_lines
from noticeflow.queries import query, table

NL = "chr(10)"


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS item_no", "o_custkey AS input_id", "concat('order ', o_orderkey) AS title",
        "if(o_orderkey % 4 < 2, o_orderdate, o_orderdate + INTERVAL 14 HOURS) AS start",
        "CASE o_orderkey % 4 WHEN 1 THEN o_orderdate + INTERVAL 2 DAYS WHEN 3 THEN o_orderdate + INTERVAL 16 HOURS END AS end",
        "o_orderkey % 4 < 2 AS all_day", "if(o_orderkey % 2 = 0, 'task', 'event') AS kind", "o_orderpriority AS category",
        "if(o_orderkey % 3 = 0, concat('room ', o_custkey), null) AS location",
        "if(o_orderkey % 5 = 0, null, concat('n', o_custkey)) AS notes", "if(o_orderkey % 7 = 0, 5, null) AS alarm_minutes",
        "0.8D AS confidence", "if(o_orderkey % 11 = 0, '', 'x.hwp') AS source", "o_orderkey % 8 = 0 AS undated",
        "if(o_orderkey % 2 = 0, '', concat('src ', o_orderkey)) AS source_text",
        "element_at(array('auto', 'both', 'task', 'calendar'), int(o_custkey % 4) + 1) AS mode")


_ITEMS = """
items AS (SELECT o_orderkey AS k, o_custkey AS input_id, o_orderkey % 4 < 2 AS all_day,
                 CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate ELSE o_orderdate + INTERVAL 14 HOUR END AS s,
                 CASE o_orderkey % 4 WHEN 1 THEN o_orderdate + INTERVAL 2 DAY WHEN 3 THEN o_orderdate + INTERVAL 16 HOUR END AS e,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'task' ELSE 'event' END AS kind,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'room ' || o_custkey END AS location,
                 CASE WHEN o_orderkey % 5 <> 0 THEN 'n' || o_custkey END AS notes,
                 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'x.hwp' END AS source, o_orderkey % 8 = 0 AS undated,
                 CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'src ' || o_orderkey END AS source_text,
                 CASE o_custkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'both' WHEN 2 THEN 'task' ELSE 'calendar' END AS mode FROM orders),
placed AS (SELECT *, CASE WHEN mode = 'calendar' THEN 'calendar' WHEN mode = 'task' THEN 'task' WHEN undated THEN 'task'
                          WHEN mode = 'both' THEN 'calendar,task' WHEN kind = 'event' THEN 'calendar' ELSE 'task' END AS targets FROM items),
decided AS (SELECT * REPLACE (CASE targets WHEN 'task' THEN 'task' WHEN 'calendar' THEN 'event' ELSE kind END AS kind),
                   CASE WHEN NOT undated AND k % 13 <> 0 THEN CASE WHEN k % 7 = 0 THEN 5 ELSE 30 END END AS alarm
            FROM placed WHERE NOT (undated AND targets = 'calendar'))
"""


@query("default_targets", f"WITH {_ITEMS} SELECT k AS item_no, targets FROM placed")
def default_targets(spark: SparkSession, sf: str) -> DataFrame:
    return D.apply_targets(order_items(spark, sf), None, ["item_no"], "mode").selectExpr(
        "item_no", "array_join(targets, ',') AS targets")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    placed = D.apply_targets(order_items(spark, sf), None, ["item_no"], "mode")
    return D.build_decisions(placed, "item_no % 13 <> 0", "30")


@query("decision_building", f"""
WITH {_ITEMS} SELECT k AS item_no, targets, kind, coalesce(alarm, -1) AS alarm_minutes, coalesce(strftime(e, '%Y-%m-%d %H:%M'), '') AS end_at FROM decided
""")
def decision_building(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).selectExpr(
        "item_no", "array_join(targets, ',') AS targets", "kind", "coalesce(alarm_minutes, -1) AS alarm_minutes",
        "coalesce(date_format(end, 'yyyy-MM-dd HH:mm'), '') AS end_at")


@query("bulk_targets", f"""
WITH {_ITEMS} SELECT k AS item_no, CASE k % 5 WHEN 0 THEN 'calendar,task' WHEN 1 THEN CASE WHEN undated THEN 'task' ELSE 'calendar' END
       WHEN 2 THEN '' ELSE targets END AS targets FROM placed
""")
def bulk_targets(spark: SparkSession, sf: str) -> DataFrame:
    items = order_items(spark, sf)
    overrides = items.filter("item_no % 5 < 4").selectExpr(
        "item_no", "if(item_no % 5 = 0, array('calendar', 'task', 'calendar'), array('calendar')) AS targets",
        "element_at(array('bulk', 'pick', 'off', 'reset'), int(item_no % 5) + 1) AS how")
    return D.apply_targets(items, overrides, ["item_no"], "mode").selectExpr("item_no", "array_join(targets, ',') AS targets")


@query("review_summary", f"""
WITH {_ITEMS} SELECT input_id, count(*) AS n_items, count(d.k) AS n_decided, count(d.k) FILTER (WHERE d.targets LIKE '%calendar%') AS n_calendar,
       count(d.k) FILTER (WHERE d.targets LIKE '%task%') AS n_task, count(*) - count(d.k) AS n_skipped
FROM items LEFT JOIN (SELECT k, targets FROM decided) d USING (k) GROUP BY input_id
""")
def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.review_summary(order_items(spark, sf), decisions(spark, sf))


@query("list_preselection", """
SELECT o_orderkey, CASE WHEN o_custkey % 30 < 25 THEN 'L' || o_custkey % 30 WHEN o_orderkey % 2 = 0 THEN 'L3' ELSE '' END AS tasklist_id,
       CASE WHEN o_custkey % 30 < 25 THEN 'NATION_' || o_custkey % 30 WHEN o_orderkey % 2 = 0 THEN 'NATION_3' ELSE '' END AS tasklist_name FROM orders
""")
def list_preselection(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "nation").selectExpr("concat('L', n_nationkey) AS id", "n_name AS title", "n_nationkey AS ord")
    items = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('Nation _', o_custkey % 30) AS category", "if(o_orderkey % 2 = 0, 'L3', 'gone') AS usual")
    return D.preselect_list(items, lists, "usual").select("o_orderkey", "tasklist_id", "tasklist_name")


# ---------------------------------------------------------------- plan

def planned(spark: SparkSession, sf: str) -> DataFrame:
    rows = decisions(spark, sf).selectExpr(
        "*", "string(item_no) AS decision_id", "concat('L', input_id % 3) AS list_id", "if(item_no % 2 = 0, 'School', '') AS list_name",
        "CASE WHEN item_no % 9 = 0 THEN map('task', struct('skip' AS action, 't1' AS existing_id, '' AS list_id)) "
        "WHEN item_no % 9 = 1 THEN map('task', struct('update' AS action, 't2' AS existing_id, 'LX' AS list_id), "
        "'calendar', struct('update' AS action, 'e2' AS existing_id, '' AS list_id)) "
        "WHEN item_no % 9 = 2 THEN map('calendar', struct('skip' AS action, 'e3' AS existing_id, '' AS list_id)) "
        "WHEN item_no % 9 = 3 THEN map('calendar', struct('create' AS action, 'e4' AS existing_id, '' AS list_id)) END AS dedupe")
    return G.plan_actions(rows)


_ACTIONS = f"""
{_ITEMS}, tasks AS (
  SELECT *, 'task' AS side, CASE k % 9 WHEN 0 THEN 'skip' WHEN 1 THEN 'patch' ELSE 'insert' END AS op, 'task' AS variant,
         CASE k % 9 WHEN 0 THEN 't1' WHEN 1 THEN 't2' ELSE '' END AS existing_id,
         CASE WHEN k % 9 = 1 THEN 'LX' ELSE 'L' || input_id % 3 END AS container_id,
         CASE k % 9 WHEN 0 THEN '⏭✅(중복 건너뜀)' WHEN 1 THEN '🔄✅(기존 갱신)' ELSE '✅' || CASE WHEN k % 2 = 0 THEN '[School]' ELSE '' END END AS mark
  FROM decided WHERE targets LIKE '%task%'),
cal AS (
  SELECT *, 'calendar' AS side, CASE WHEN targets = 'task' THEN 'insert' WHEN k % 9 = 2 THEN 'skip' WHEN k % 9 = 1 THEN 'patch' ELSE 'insert' END AS op,
         CASE WHEN targets = 'task' THEN 'alarm' WHEN k % 9 IN (1, 2) THEN 'event' WHEN targets = 'calendar,task' AND kind = 'task' THEN 'deadline' ELSE 'event' END AS variant,
         CASE WHEN targets = 'task' THEN '' WHEN k % 9 = 2 THEN 'e3' WHEN k % 9 = 1 THEN 'e2' ELSE '' END AS existing_id, 'primary' AS container_id,
         CASE WHEN targets = 'task' THEN '⏰' WHEN k % 9 = 2 THEN '⏭📅(중복 건너뜀)' WHEN k % 9 = 1 THEN '🔄📅(기존 갱신)'
              WHEN targets = 'calendar,task' AND kind = 'task' THEN '📅(마감)' ELSE '📅' END AS mark
  FROM decided WHERE targets LIKE '%calendar%' OR (targets = 'task' AND alarm IS NOT NULL AND NOT undated))
"""


@query("action_plan", f"""
WITH {_ACTIONS}, a AS (SELECT k, side, op, variant, existing_id, container_id, -1 AS alarm FROM tasks
  UNION ALL SELECT k, side, op, variant, existing_id, container_id,
            CASE WHEN op = 'skip' THEN -1 WHEN variant = 'deadline' AND all_day AND alarm IS NOT NULL THEN 420 ELSE coalesce(alarm, -1) END FROM cal)
SELECT k AS item_no, row_number() OVER (PARTITION BY k ORDER BY side DESC) AS seq, side, op, variant, existing_id, container_id, alarm FROM a
""")
def action_plan(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf).selectExpr(
        "item_no", "seq", "side", "op", "variant", "coalesce(existing_id, '') AS existing_id", "container_id",
        "coalesce(event_alarm, -1) AS alarm")


@query("alarm_events", f"""
WITH {_ACTIONS} SELECT k AS item_no, '⏰ order ' || k AS title,
       strftime(CASE WHEN all_day THEN date_trunc('day', s) + INTERVAL 9 HOUR ELSE s END, '%Y-%m-%d %H:%M') AS start_at,
       CASE WHEN notes IS NULL THEN '' ELSE notes || {NL} END || '마감 알림' AS notes FROM cal WHERE variant = 'alarm'
""")
def alarm_events(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf).filter("variant = 'alarm'").selectExpr(
        "item_no", "event_title AS title", "date_format(event_start, 'yyyy-MM-dd HH:mm') AS start_at", "event_notes AS notes")


@query("event_bodies", f"""
WITH {_ACTIONS}, c AS (SELECT *, CASE WHEN variant = 'alarm' AND all_day THEN date_trunc('day', s) + INTERVAL 9 HOUR ELSE s END AS s2,
                              CASE WHEN variant <> 'alarm' THEN e END AS e2, all_day AND variant <> 'alarm' AS day FROM cal WHERE op <> 'skip')
SELECT CAST(k AS VARCHAR) AS decision_id, CASE variant WHEN 'alarm' THEN '⏰ ' ELSE '' END || 'order ' || k || CASE variant WHEN 'deadline' THEN ' (마감)' ELSE '' END AS summary,
       CASE WHEN variant = 'alarm' THEN CASE WHEN notes IS NULL THEN '' ELSE notes || {NL} END || '마감 알림' || {NL} WHEN notes IS NULL THEN '' ELSE notes || {NL} END
         || CASE WHEN source = '' THEN '' ELSE '출처: ' || source || {NL} END
         || CASE variant WHEN 'deadline' THEN 'Google Tasks 할 일의 마감일' || {NL} WHEN 'alarm' THEN 'Google Tasks 마감 알림용 이벤트' || {NL} ELSE '' END
         || 'noticeflow 로 등록' || CASE WHEN source_text = '' THEN '' ELSE {NL} || {NL} || '─── 원문 ───' || {NL} || source_text END AS description,
       coalesce(location, '') AS location,
       CASE WHEN day THEN strftime(s2, '%Y-%m-%d') ELSE strftime(s2, '%Y-%m-%dT%H:%M:%S') || '+09:00' END AS start_at,
       CASE WHEN day THEN strftime(coalesce(e2, s2) + INTERVAL 1 DAY, '%Y-%m-%d') ELSE strftime(coalesce(e2, s2 + INTERVAL 1 HOUR), '%Y-%m-%dT%H:%M:%S') || '+09:00' END AS end_at,
       CASE WHEN variant = 'deadline' AND all_day AND alarm IS NOT NULL THEN 420 ELSE coalesce(alarm, -1) END AS reminder FROM c
""")
def event_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return G.event_rows(planned(spark, sf)).selectExpr(
        "decision_id", "summary", "description", "coalesce(location, '') AS location", "coalesce(start_date, start_time) AS start_at",
        "coalesce(end_date, end_time) AS end_at", "coalesce(reminder_minutes, -1) AS reminder")


_TASK_BODY = f"""
bodies AS (SELECT k, op, existing_id, container_id, CASE WHEN undated THEN '' ELSE strftime(s, '%Y-%m-%d') || 'T00:00:00.000Z' END AS due,
  concat_ws({NL}, CASE WHEN NOT all_day AND NOT undated THEN '시각: 14:00' END, CASE WHEN location IS NOT NULL THEN '장소: ' || location END, notes,
            CASE WHEN source <> '' THEN '출처: ' || source END, CASE WHEN source_text <> '' THEN {NL} || '─── 원문 ───' || {NL} || source_text END) AS notes
  FROM tasks WHERE op <> 'skip')
"""


@query("task_bodies", f"WITH {_ACTIONS}, {_TASK_BODY} SELECT CAST(k AS VARCHAR) AS decision_id, container_id AS list_id, 'order ' || k AS title, due, notes FROM bodies")
def task_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return G.task_rows(planned(spark, sf)).selectExpr(
        "decision_id", "list_id", "title", "coalesce(due, '') AS due", "coalesce(notes, '') AS notes")


@query("success_lines", f"""
WITH {_ACTIONS} SELECT CAST(k AS VARCHAR) AS decision_id, concat_ws(' ', t.mark, c.mark) || ' ' || CASE WHEN undated THEN '날짜 없음'
       WHEN k % 4 = 0 THEN strftime(s, '%Y-%m-%d') WHEN k % 4 = 1 THEN strftime(s, '%Y-%m-%d') || ' ~ ' || strftime(e, '%Y-%m-%d')
       WHEN k % 4 = 2 THEN strftime(s, '%Y-%m-%d %H:%M') ELSE strftime(s, '%Y-%m-%d %H:%M') || '~' || strftime(e, '%H:%M') END || '  order ' || k AS line
FROM decided LEFT JOIN (SELECT k, mark FROM tasks) t USING (k) LEFT JOIN (SELECT k, mark FROM cal) c USING (k)
""")
def success(spark: SparkSession, sf: str) -> DataFrame:
    return success_lines(planned(spark, sf))


# ---------------------------------------------------------------- merge

@query("task_merge", """
SELECT o_orderkey AS id, 'old ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'due2' ELSE 'due1' END AS due,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'notes2' ELSE 'notes1' END AS notes, 'needsAction' AS status FROM orders
UNION ALL SELECT o_orderkey, 'fresh', 'd', 'n', 'needsAction' FROM orders WHERE o_orderkey % 3 = 1
""")
def task_merge(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    tasks = orders.selectExpr("concat('L', o_custkey % 3) AS list_id", "string(o_orderkey) AS id", "concat('old ', o_orderkey) AS title",
                              "'due1' AS due", "'notes1' AS notes", "'needsAction' AS status")
    rows = orders.filter("o_orderkey % 3 < 2").selectExpr(
        "string(o_orderkey) AS decision_id", "if(o_orderkey % 3 = 0, 'patch', 'insert') AS op", "string(o_orderkey) AS existing_id",
        "concat('L', o_custkey % 3) AS list_id", "'fresh' AS title",
        "if(o_orderkey % 3 = 1, 'd', if(o_orderkey % 2 = 0, 'due2', null)) AS due",
        "if(o_orderkey % 3 = 1, 'n', if(o_orderkey % 5 = 0, 'notes2', null)) AS notes")
    return G.merge_tasks(tasks, rows).selectExpr("bigint(replace(id, 'new:', '')) AS id", "title", "due", "notes", "status")


@query("event_merge", """
SELECT o_orderkey AS id, 'old' AS summary, CASE WHEN o_orderkey % 3 = 0 THEN 's2' ELSE 's1' END AS start_time,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'p2' ELSE 'p1' END AS location,
       CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 10 END AS reminder FROM orders
UNION ALL SELECT o_orderkey, 'fresh', 's2', CASE WHEN o_orderkey % 2 = 0 THEN 'p2' ELSE '' END, -1 FROM orders WHERE o_orderkey % 3 = 1
""")
def event_merge(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    body = "'x' AS description, cast(null as string) AS start_date, cast(null as string) AS end_date, 'e' AS end_time".split(", ")
    events = orders.selectExpr("string(o_orderkey) AS id", "'old' AS summary", "'p1' AS location", "'s1' AS start_time",
                               "10 AS reminder_minutes", *body)
    rows = orders.filter("o_orderkey % 3 < 2").selectExpr(
        "string(o_orderkey) AS decision_id", "if(o_orderkey % 3 = 0, 'patch', 'insert') AS op", "string(o_orderkey) AS existing_id",
        "'fresh' AS summary", "if(o_orderkey % 2 = 0, 'p2', null) AS location", "'s2' AS start_time",
        "cast(null as int) AS reminder_minutes", *body)
    return G.merge_events(events, rows).selectExpr(
        "bigint(replace(id, 'new:', '')) AS id", "summary", "start_time", "coalesce(location, '') AS location",
        "coalesce(reminder_minutes, -1) AS reminder")


@query("origin_completion", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'completed' ELSE 'needsAction' END AS status FROM orders
""")
def origin_completion(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    tasks = orders.selectExpr("'L1' AS list_id", "concat('a:', o_orderkey) AS id", "o_orderkey", "'needsAction' AS status")
    inputs = orders.selectExpr("o_orderkey AS input_id", "if(o_orderkey % 2 = 0, 'inbox_task', 'text') AS kind",
                               "concat('L1:a:', o_orderkey) AS origin_ref")
    results = orders.selectExpr("o_orderkey AS input_id", "o_orderkey % 3 <> 0 AS ok")
    return G.complete_origins(tasks, inputs, results).select("o_orderkey", "status")


# ---------------------------------------------------------------- results

_RESULTS = """
r AS (SELECT l_orderkey AS input_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS seq,
             CASE WHEN l_partkey % 50 = 1 THEN 'auth' WHEN l_partkey % 10 = 2 THEN 'http' WHEN l_partkey % 10 = 3 THEN 'ValueError: boom' END AS error,
             CASE WHEN l_partkey % 10 = 2 THEN 400 + l_suppkey % 6 END AS code FROM lineitem)
"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS input_id", "l_partkey * 1000000L + l_suppkey * 100L + l_linenumber AS seq",
        "CASE WHEN l_partkey % 50 = 1 THEN 'auth' WHEN l_partkey % 10 = 2 THEN 'http' WHEN l_partkey % 10 = 3 THEN 'ValueError: boom' END AS error",
        "CASE WHEN l_partkey % 10 = 2 THEN int(400 + l_suppkey % 6) END AS status_code", "l_partkey % 50 = 1 AS is_auth_error")


@query("registration_report", f"""
WITH {_RESULTS}, s AS (SELECT *, min(CASE WHEN error = 'auth' THEN seq END) OVER (PARTITION BY input_id) AS stop FROM r)
SELECT input_id, count(*) FILTER (WHERE error IS NULL) AS n_ok, count(*) FILTER (WHERE error IS NOT NULL) AS n_failed
FROM s WHERE stop IS NULL OR seq <= stop GROUP BY input_id
""")
def registration_report(spark: SparkSession, sf: str) -> DataFrame:
    return G.report(_results(spark, sf))


@query("friendly_errors", f"""
WITH {_RESULTS} SELECT CASE code WHEN 401 THEN '인증이 만료되었습니다. 다시 로그인하세요.' WHEN 403 THEN '권한이 없습니다 (API 미활성화 또는 스코프 부족).'
       WHEN 404 THEN '캘린더/목록을 찾을 수 없습니다. 설정에서 다시 선택하세요.' ELSE CASE WHEN code IS NULL THEN error ELSE 'Google API 오류 (' || code || ')' END END AS message,
       count(*) AS n FROM r WHERE error IS NOT NULL GROUP BY 1
""")
def friendly_errors(spark: SparkSession, sf: str) -> DataFrame:
    failed = _results(spark, sf).filter("error IS NOT NULL")
    return failed.groupBy(F.expr(G.friendly_error("status_code", "error")).alias("message")).agg(F.count("*").alias("n"))
