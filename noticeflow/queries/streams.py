"""Streaming operators.  Each stream runs over the whole table with ``availableNow`` into a table, which is read back;
the SQL is that of the batch result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators import responses as R
from noticeflow.operators.pii_mask import mask
from noticeflow.operators.quotes import split_quotes
from noticeflow.plans.durable import shared_folder
from noticeflow.queries import query, table
from noticeflow.queries.messages import STORE, raw_messages
from noticeflow.queries.personal_data import EMAIL
from noticeflow.sources.sinks import published, write_batch
from noticeflow.streaming import errors, idle, polling


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    spark = stream.sparkSession
    out = shared_folder(spark)
    run = (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@query("polled_messages", f"""
WITH {STORE} SELECT key, sender, title FROM store WHERE NOT deleted AND NOT bad AND key > (SELECT max(key) - 500 FROM store)
""")
def polled_messages(spark: SparkSession, sf: str) -> DataFrame:
    """First run with a stored start key; later messages only."""
    raw = raw_messages(spark, sf)
    seen = raw.filter(F.col("MessageKey") <= raw.agg(F.max("MessageKey") - 500).scalar())
    state = f"{shared_folder(spark)}/start"
    key = polling.start_key(spark, seen, state)
    again = polling.start_key(spark, raw, state)
    return polling.after_key(raw, max(key, again)).select("key", "sender", "title")


def fed(parts: list[DataFrame], path: str, run: Callable[[], None]) -> None:
    """Write each part to a folder of ``path``, as many files as it has partitions, and run the stream to the end of what is there.

    Every part is a micro-batch of its own, and every run a restart from the checkpoint of the one before.
    """
    for n, part in enumerate(parts):
        part.write.parquet(f"{path}/part={n}")
        run()


def drained_in_parts(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame], **options: str) -> DataFrame:
    """What ``stream`` makes of the parts, one after the other, in a table that is read back."""
    spark, out = parts[0].sparkSession, shared_folder(parts[0].sparkSession)
    made = stream(spark.readStream.schema(parts[0].schema).options(**options).parquet(f"{out}/in/part=*"))

    def run() -> None:
        (made.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).start().awaitTermination())

    fed(parts, f"{out}/in", run)
    return spark.read.schema(made.schema).parquet(f"{out}/data")


@query("delivered_once", f"""
WITH {STORE} SELECT key FROM store WHERE NOT deleted AND NOT bad
""")
def delivered_once(spark: SparkSession, sf: str) -> DataFrame:
    """Copies across micro-batches; receive dates span years and come in any order, and none is dropped as late."""
    raw = raw_messages(spark, sf)
    return drained_in_parts([raw, raw], lambda stream: polling.deliver_once(polling.after_key(stream, -1)).select("key"))


@query("polled_stream", f"""
WITH {STORE} SELECT CAST(key AS VARCHAR) AS origin FROM store WHERE NOT deleted AND NOT bad AND key > (SELECT max(key) // 2 FROM store)
""")
def polled_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The poll path as a stream of files: start key stored at the first run, copies in another batch."""
    raw = raw_messages(spark, sf)
    old = raw.filter(F.col("MessageKey") <= raw.agg(F.floor(F.max("MessageKey") / 2)).scalar())
    state = f"{shared_folder(spark)}/start"
    polling.start_key(spark, old, state)
    key = polling.start_key(spark, raw, state)
    inputs = drained_in_parts([raw, raw], lambda stream: polling.stream_inputs(stream, key).select("origin_ref"))
    return inputs.select(F.col("origin_ref").alias("origin"))


def quarters(events: DataFrame) -> list[DataFrame]:
    """The events in four parts, in order; a part keeps the table's partitions."""
    top = events.agg(F.max("event_id")).scalar()
    part = F.coalesce(F.floor(F.col("event_id") * 4 / (top + 1)), F.lit(0))
    return [events.filter(part == q) for q in range(4)]


@query("polled_by_key", f"""
WITH {STORE}, m AS (SELECT max(key) AS top FROM store),
     a AS (SELECT key, bad, key > top - top // 40 AS later FROM store, m WHERE NOT deleted AND key > top - top // 20),
     n AS (SELECT *, (row_number() OVER (PARTITION BY later ORDER BY key) - 1) // 20 AS poll FROM a)
SELECT CAST(key AS VARCHAR) AS origin, 1 + poll + CASE WHEN later THEN (SELECT max(poll) + 1 FROM n WHERE NOT later) ELSE 0 END AS poll FROM n WHERE NOT bad
""")
def polled_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The store as a keyed source: what was there is skipped, twenty messages a poll in order, many polls a batch where as many are
    behind, and a restart goes on at the key."""
    raw = raw_messages(spark, sf)
    out = shared_folder(spark)
    top = raw.agg(F.max("MessageKey")).scalar()
    first, later, key = top - F.floor(top / 20), top - F.floor(top / 40), F.col("MessageKey")
    steps = (key <= first, (key > first) & (key <= later), key > later)

    def poll() -> None:
        inputs = polling.polled_inputs(polling.poll_store(spark, f"{out}/store", raw.schema, polls=256))
        run = (inputs.select("origin_ref", "Poll").writeStream.foreachBatch(lambda df, n: write_batch(df, f"{out}/inputs", n))
               .option("checkpointLocation", f"{out}/state").trigger(processingTime="0 seconds").start())
        try:
            run.processAllAvailable()
        finally:
            run.stop()

    for step in steps:    # the store grows between two runs of the query
        raw.filter(step).write.mode("append").parquet(f"{out}/store")
        poll()
    return spark.read.parquet(f"{out}/inputs").select(F.col("origin_ref").alias("origin"), F.col("Poll").alias("poll"))


@query("forced_fetch", f"""
WITH {STORE}, latest AS (SELECT * FROM store WHERE NOT deleted ORDER BY key DESC LIMIT 20)
SELECT key, 'unread' AS mode FROM (SELECT key FROM latest WHERE is_unread = 1 AND NOT bad ORDER BY key DESC LIMIT 5)
UNION ALL SELECT key, 'newest' FROM (SELECT key FROM latest WHERE NOT bad ORDER BY key DESC LIMIT 1)
UNION ALL SELECT key, 'after' FROM (SELECT * FROM store WHERE NOT deleted AND key > 77 ORDER BY key LIMIT 20) WHERE NOT bad
UNION ALL SELECT key, CASE WHEN rn <= 60 THEN 'past unreadable' ELSE 'all the rest' END
FROM (SELECT *, row_number() OVER (ORDER BY key) AS rn FROM store WHERE NOT deleted AND key > 77) WHERE NOT bad AND key > 120
""")
def forced_fetch(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_messages(spark, sf)
    read = raw.withColumn("IsUnRead", F.lit(0))
    modes = ((raw, 0, "unread"), (read, 0, "newest"), (raw, 77, "after"))
    parts = [polling.fetch_now(df, key, 20)[0].select("key", F.lit(mode).alias("mode")) for df, key, mode in modes]
    broken = raw.withColumn("ReceiveDate", F.when(F.col("MessageKey").between(78, 120), "soon").otherwise(F.col("ReceiveDate")))
    last = 77
    for _ in range(3):
        rows, mark = polling.fetch_now(broken, last, 20)
        last = mark.first()["last_key"]
        parts.append(rows.select("key", F.lit("past unreadable").alias("mode")))
    parts.append(polling.fetch_now(broken, last)[0].select("key", F.lit("all the rest").alias("mode")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_POLLS = ("user_id AS source", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'no folder' WHEN 'view' THEN 'no file' "
          "WHEN 'click' THEN 'no file' END AS error")
_SUPPRESSED = """
WITH p AS (SELECT user_id AS source, event_id AS seq, CASE event_type WHEN 'error' THEN 'no folder' WHEN 'view' THEN 'no file'
                  WHEN 'click' THEN 'no file' ELSE '' END AS error FROM events),
     l AS (SELECT *, lag(error, 1, '') OVER (PARTITION BY source ORDER BY seq) AS before FROM p)
SELECT source, seq, error FROM l WHERE error <> '' AND error <> before
"""


@query("repeated_errors", _SUPPRESSED)
def repeated_errors(spark: SparkSession, sf: str) -> DataFrame:
    return errors.suppress_repeats(table(spark, sf, "events").selectExpr(*_POLLS))


@query("repeated_errors_stream", _SUPPRESSED)
def repeated_errors_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Several micro-batches of the events in order, so that a source's last outcome crosses from one to the next."""
    return drained_in_parts(quarters(table(spark, sf, "events")), lambda stream: errors.suppress_repeats_stream(stream.selectExpr(*_POLLS)))


@query("dead_letters", """
SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS input_id, CASE WHEN turn % 4 = 0 THEN '알 수 없는 입력 종류: fax' WHEN turn % 4 = 1 THEN '빈 텍스트입니다.'
       WHEN turn % 4 = 2 THEN 'cannot parse' ELSE 'ok' END AS outcome FROM conversations
""")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    inputs = stream_of(spark, sf, "conversations").selectExpr(
        "string(conv_id * 1000 + turn) AS input_id", "if(turn % 4 = 0, 'fax', 'text') AS kind",
        "if(turn % 4 = 1, ' ', text) AS text", "turn % 4 AS k")
    out = shared_folder(spark)

    def work(good: DataFrame) -> DataFrame:
        return good.selectExpr("input_id", "if(k = 2, 'cannot parse', null) AS error")

    writer = errors.process_inputs(inputs, work, f"{out}/done", f"{out}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    good = published(spark, f"{out}/done", "results", "input_id string").selectExpr("input_id", "'ok' AS outcome")
    return good.unionByName(published(spark, f"{out}/done", "dead", "input_id string, error string").selectExpr("input_id", "error AS outcome"))


@query("idle_gaps", """
WITH g AS (SELECT user_id, event_id, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0 AS gap FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN gap >= 1800 THEN 'sleeping' WHEN gap >= 300 THEN 'bored' WHEN gap IS NOT NULL THEN 'idle' ELSE '' END AS state FROM g
""")
def idle_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return idle.idle_gaps(table(spark, sf, "events")).selectExpr("user_id", "event_id", "coalesce(state, '') AS state")


_SESSIONS = """
WITH e AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER w > INTERVAL {minutes} MINUTE, TRUE) AS INTEGER) AS new FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
     o AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL {minutes} MINUTE AS b, count(*) AS n_events FROM s GROUP BY user_id, n)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end, n_events FROM o
"""


def _flat_sessions(df: DataFrame) -> DataFrame:
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.selectExpr("user_id", f"date_format(session_start, '{fmt}') AS session_start",
                         f"date_format(session_end, '{fmt}') AS session_end", "n_events")


@query("bored_sessions", _SESSIONS.format(minutes=5))
def bored_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_sessions(idle.activity_sessions(table(spark, sf, "events"), 5))


@query("sleeping_sessions_stream", _SESSIONS.format(minutes=30) + " WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def sleeping_sessions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions closed by the watermark."""
    return _flat_sessions(drained(idle.activity_sessions(stream_of(spark, sf, "events"), 30)))


@query("activity_states_stream", """
WITH g AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS pause FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     c AS (SELECT user_id, ts AS t, 'idle' AS state FROM g WHERE gap IS NULL OR gap >= 300000000
           UNION ALL SELECT user_id, ts + INTERVAL 5 MINUTE, 'bored' FROM g WHERE pause IS NULL OR pause >= 300000000
           UNION ALL SELECT user_id, ts + INTERVAL 30 MINUTE, 'sleeping' FROM g WHERE pause IS NULL OR pause >= 1800000000)
SELECT user_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS changed, state FROM c
""")
def activity_states_stream(spark: SparkSession, sf: str) -> DataFrame:
    """State changes over restarts; after the last event of all only the clock goes on, and every user falls asleep."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    tick = events.agg(F.max("ts").alias("ts")).selectExpr("-1L AS event_id", "cast(null as bigint) AS user_id", "ts + INTERVAL 1 HOUR AS ts")
    made = drained_in_parts([*quarters(events), tick], lambda stream: idle.activity_states(stream.filter("event_id >= 0"), stream.filter("event_id < 0")))
    return made.selectExpr("user_id", "date_format(at, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS changed", "state")


@query("masked_stream", f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents")
def masked_stream(spark: SparkSession, sf: str) -> DataFrame:
    found = mask(stream_of(spark, sf, "documents"), rules=["email"]).selectExpr("doc_id", "inline(spans)")
    return drained(found.select("doc_id", "value"))


@query("quotes_stream", """
SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS recent_md5, '홍님이 보낸글 >>' || chr(10) || 'old ' || turn AS older FROM conversations
""")
def quotes_stream(spark: SparkSession, sf: str) -> DataFrame:
    bodies = stream_of(spark, sf, "conversations").selectExpr("conv_id", "turn", "concat(text, '\\n홍님이 보낸글 >>\\n> old ', turn) AS body")
    marked = split_quotes(bodies).selectExpr("conv_id", "turn", "md5(recent) AS recent_md5", "older")
    return drained(marked.selectExpr("conv_id", "turn", "recent_md5", "replace(older, '> old', 'old') AS older"))


@query("late_items_stream", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_items, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS n_past FROM events
""")
def late_items_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Items dated before the message's own day are dropped row by row; no watermark is involved."""
    answers = stream_of(spark, sf, "events").selectExpr(
        "event_id", "to_date(ts) AS reference_date", "'s' AS source",
        "concat('{\"items\": [{\"title\": \"t\", \"date\": \"', date_add(to_date(ts), if(event_id % 2 = 0, 0, -1)), '\"}]}') AS raw")
    parsed = R.parse_responses(answers, drop_before="reference_date")
    return drained(parsed.selectExpr("event_id", "size(items) AS n_items", "n_past"))
