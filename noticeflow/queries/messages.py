"""Sources: files, pages, cells, the message store, services and settings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions.text import tidy
from noticeflow.queries import query, table
from noticeflow.sources import files, messages, services, settings

# whitespace as SQL text for the oracles
_CODES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
BLANKS = "||".join(f"chr({c})" for c in _CODES)


@query("file_listing", """
SELECT page_id, name, ext, CAST(ext IN ('.png','.jpg','.jpeg','.gif','.webp','.bmp','.txt','.md','.csv','.pdf','.hwpx','.hwp')
       AS INTEGER) AS supported
FROM (SELECT page_id, name, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS ext
      FROM (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS name
            FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.hwp' WHEN 2 THEN '/notice.Txt'
                                             WHEN 3 THEN '/.md' ELSE '' END AS path FROM pages)))
""")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "pages").selectExpr(
        "page_id", "concat(url, CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.hwp' WHEN 2 THEN '/notice.Txt' "
                   "WHEN 3 THEN '/.md' ELSE '' END) AS path")
    good, bad = files.list_files(paths)
    return good.withColumn("supported", F.lit(1)).unionByName(bad.withColumn("supported", F.lit(0))).select(
        "page_id", "name", "ext", "supported")


@query("text_decoding", """
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '가나다' || doc_id
                   ELSE chr(65533) || doc_id END) AS text_md5 FROM documents
""")
def text_decoding(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 0 THEN concat(unhex('EFBBBF'), encode(text, 'UTF-8')) "
                  "WHEN 1 THEN encode(text, 'UTF-8') "
                  "WHEN 2 THEN concat(unhex('B0A1B3AAB4D9'), encode(string(doc_id), 'UTF-8')) "
                  "ELSE concat(unhex('FF'), encode(string(doc_id), 'UTF-8')) END AS content")
    return files.decode_text(raw).selectExpr("doc_id", "md5(text) AS text_md5")


@query("page_stitching", f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n
           FROM documents),
     t AS (SELECT doc_id, n, trim(raw, {BLANKS}) AS s FROM p)
SELECT doc_id, md5(coalesce(string_agg(CASE WHEN length(s) >= 20 THEN '[p.' || n || ']' || chr(10) || s END,
                                       chr(10) || chr(10) ORDER BY n), '')) AS text_md5,
       coalesce(array_to_string(list_slice(list(n ORDER BY n) FILTER (WHERE length(s) < 20), 1, 1000000), ','), '') AS scans
FROM t GROUP BY doc_id
""")
def page_stitching(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").selectExpr("doc_id", "posexplode(split(text, '\\n', -1)) AS (pos, text)")
    stitched = files.stitch_pages(pages.selectExpr("doc_id", "pos + 1 AS page_no", "text"))
    return stitched.selectExpr("doc_id", "md5(text) AS text_md5", "array_join(scan_pages, ',') AS scans")


@query("table_rendering", """
WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS row, 1 AS col, l_returnflag AS t FROM lineitem WHERE l_quantity > 5
           UNION ALL SELECT l_orderkey, l_linenumber, 2, l_linestatus FROM lineitem WHERE l_quantity > 5
           UNION ALL SELECT l_orderkey, l_linenumber, 3, l_suppkey || ' x ' || l_partkey FROM lineitem WHERE l_quantity > 5
           UNION ALL SELECT l_orderkey, l_linenumber, 1, '' FROM lineitem WHERE l_quantity <= 5)
SELECT doc, row, '| ' || string_agg(t, ' | ' ORDER BY col, t) || ' |' AS line FROM c GROUP BY doc, row
HAVING bool_or(t <> '')
""")
def table_rendering(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc", "l_linenumber AS row",
        "inline(if(l_quantity > 5, array(named_struct('col', 1, 'text', l_returnflag), "
        "named_struct('col', 2, 'text', l_linestatus), "
        "named_struct('col', 3, 'text', concat(l_suppkey, '\\nx\\n', l_partkey))), "
        "array(named_struct('col', 1, 'text', '  '))))")
    return files.table_rows(cells, "doc")


@query("text_tidying", f"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text || chr(13) || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || 'x ',
           chr(13), ''), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS})) AS text_md5 FROM documents
""")
def text_tidying(spark: SparkSession, sf: str) -> DataFrame:
    rough = "concat(text, '\\r\\n \\n\\n\\nx ')"
    return table(spark, sf, "documents").selectExpr("doc_id", f"md5({tidy(rough)}) AS text_md5")


def raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the shape of the message store; some receive dates are unreadable, some messages deleted."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS MessageKey", "concat('user', user_id) AS Sender",
        "if(event_id % 97 = 5, 'soon', concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' (월)')) AS ReceiveDate",
        "if(event_id % 11 = 0, null, event_type) AS Title", "props AS MessageText", "int(event_id % 3 = 0) AS IsUnRead",
        "if(event_id % 13 = 1, '2024/02/01', null) AS DeletedDate")


STORE = """
store AS (SELECT event_id AS key, 'user' || user_id AS sender, strftime(ts, '%Y-%m-%d %H:%M:%S') AS received,
                 CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS title, props AS body,
                 CAST(event_id % 3 = 0 AS INTEGER) AS is_unread, event_id % 13 = 1 AS deleted, event_id % 97 = 5 AS bad
          FROM events)
"""
_MESSAGE = "key, sender, received, title, body, is_unread"


def _plain(df: DataFrame) -> DataFrame:
    return df.selectExpr("key", "sender", "date_format(received, 'yyyy-MM-dd HH:mm:ss') AS received", "title", "body",
                         "int(is_unread) AS is_unread")


@query("messages_typed", f"WITH {STORE} SELECT {_MESSAGE} FROM store WHERE NOT deleted AND NOT bad AND key > 100")
def messages_typed(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(messages.messages_after(raw_messages(spark, sf), 100, None))


@query("messages_after_key", f"""
WITH {STORE}, page AS (SELECT * FROM store WHERE key > 100 AND NOT deleted ORDER BY key LIMIT 50)
SELECT {_MESSAGE} FROM page WHERE NOT bad
""")
def messages_after_key(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(messages.messages_after(raw_messages(spark, sf), 100, 50))


@query("messages_latest", f"""
WITH {STORE}, page AS (SELECT * FROM store WHERE NOT deleted ORDER BY key DESC LIMIT 10)
SELECT {_MESSAGE} FROM page WHERE NOT bad
""")
def messages_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(messages.latest_messages(raw_messages(spark, sf), 10))


@query("messages_high_water_mark", "SELECT coalesce(max(event_id), 0) AS latest_key FROM events")
def messages_high_water_mark(spark: SparkSession, sf: str) -> DataFrame:
    return messages.latest_key(raw_messages(spark, sf))


@query("source_health", f"""
WITH {STORE}, top AS (SELECT * FROM store WHERE NOT deleted ORDER BY key DESC LIMIT 1)
SELECT CASE WHEN NOT bad THEN '✅ 연결 OK — 쪽지 키 최대 ' || (SELECT max(key) FROM store) || ', 최근: ' || received[1:16] || ' ' || sender
            || CASE WHEN title = '' THEN '' ELSE ' 「' || title[1:20] || '」' END
       ELSE '✅ 연결 OK — 받은 쪽지가 없습니다 (키 최대 ' || (SELECT max(key) FROM store) || ')' END AS status FROM top
""")
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    return messages.health(raw_messages(spark, sf))


@query("receive_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE strftime(o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE, '%Y-%m-%d %H:%M:%S') END AS received
FROM orders WHERE o_orderkey % 7 <> 0
""")
def receive_dates(spark: SparkSession, sf: str) -> DataFrame:
    text = ("CASE o_orderkey % 7 WHEN 0 THEN '2026/13/45 17:04:52' WHEN 1 THEN date_format(t, 'yyyy/M/d H:mm:ss') "
            "ELSE concat(date_format(t, 'yyyy/MM/dd HH:mm:ss'), ' (목)') END")
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderdate + make_dt_interval(0, 0, int(o_orderkey % 1440)) AS t").selectExpr(
        "o_orderkey", f"{messages.receive_date(text)} AS received")
    return rows.filter("received IS NOT NULL").selectExpr(
        "o_orderkey", "date_format(received, 'yyyy-MM-dd HH:mm:ss') AS received")


@query("open_tasks", """
SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 10 <> 0
""")
def open_tasks(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "if(o_orderkey % 10 = 0, ' \\t', o_orderpriority) AS title",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'needsAction' END AS status")
    return services.open_tasks(tasks).select("id", "title")


@query("events_in_range", """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' AND o_orderstatus <> 'F'
""")
def events_in_range(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_orderdate", "if(o_orderstatus = 'F', 'cancelled', 'confirmed') AS status")
    found = services.events_between(events, "o_orderdate", "1996-01-01 00:00:00", "1996-07-01 00:00:00")
    return found.selectExpr("id", "date_format(o_orderdate, 'yyyy-MM-dd') AS day")


@query("list_by_name", "SELECT n_nationkey AS id, n_name AS title FROM nation WHERE n_name = 'NATION_7'")
def list_by_name(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS title", "n_nationkey AS ord")
    return services.find_list(lists, " nation _ 7 ")


@query("calendar_catalogue", """
SELECT CASE WHEN p THEN 'primary' ELSE id END AS id, CASE WHEN p THEN name || ' (기본)' ELSE name END AS name
FROM (SELECT 'c' || n_nationkey AS id, n_nationkey = 3 AS p,
             CASE WHEN n_nationkey % 4 = 0 THEN 'My ' || n_name WHEN n_nationkey % 4 = 1 THEN 'c' || n_nationkey ELSE n_name END AS name
      FROM nation)
""")
def calendar_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    cals = table(spark, sf, "nation").selectExpr(
        "concat('c', n_nationkey) AS id", "if(n_nationkey % 4 = 1, null, n_name) AS summary",
        "CASE n_nationkey % 4 WHEN 0 THEN concat('My ', n_name) WHEN 2 THEN '' END AS summary_override",
        "if(n_nationkey = 3, true, null) AS is_primary")
    return services.calendars(cals)


@query("settings_defaults", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 30 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS alarm_minutes,
       'auto' AS default_target, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'p' || user_id END AS persona,
       1500 AS source_text_chars, 1 AS alarm_enabled
FROM events
""")
def settings_defaults(spark: SparkSession, sf: str) -> DataFrame:
    text = ("concat('{\"schedule\": {\"alarm_minutes\": ', get_json_object(props, '$.k'), ', \"persona\": \"p', user_id, "
            "'\", \"unknown\": [1]}', if(event_id % 7 = 0, '', '}'))")
    rows = table(spark, sf, "events").selectExpr("event_id", f"{text} AS json")
    return settings.read_settings(rows, "json", section="schedule").selectExpr(
        "event_id", "alarm_minutes", "default_target", "persona", "source_text_chars", "int(alarm_enabled) AS alarm_enabled")
