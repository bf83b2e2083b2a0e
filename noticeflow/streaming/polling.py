"""Message polling as a stream, with a stored start key and exactly-once delivery by key."""
from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from noticeflow.operators.inputs import messages_to_inputs
from noticeflow.sources.messages import (latest_key, latest_messages, messages_after, require_columns,
                                         to_messages)
from noticeflow.streaming import message_store

# ---- fixed values
DEFAULT_POLL_SECONDS, MIN_POLL_SECONDS = 30, 5
MAX_PER_POLL, FORCED_LATEST, FORCED_UNREAD = 20, 20, 5


def poll_trigger(seconds: int = DEFAULT_POLL_SECONDS) -> dict[str, str]:
    """Arguments for ``DataStreamWriter.trigger``."""
    return {"processingTime": f"{max(MIN_POLL_SECONDS, int(seconds))} seconds"}


def read_messages(spark: SparkSession, path: str, schema: str, max_files: int = MAX_PER_POLL) -> DataFrame:
    """Raw message files as a stream, oldest first, a bounded number of files per poll."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("latestFirst", "false")
            .parquet(path))


def poll_store(spark: SparkSession, path: str, schema: str | StructType, rows: int = MAX_PER_POLL, skip_existing: bool = True,
               polls: int = 1) -> DataFrame:
    """Raw messages of a store as a stream: ``rows`` of them a poll in the order of their keys, from the largest key present at the
    first run on (from the first message with ``skip_existing`` off).  The place is the key in the query's checkpoint, and deleted
    messages neither come nor count.  Poll with :func:`poll_trigger`; ``availableNow`` makes one poll.

    A stream that is behind catches up with up to ``polls`` polls a micro-batch; the column ``Poll`` then numbers them from 1 on, as
    micro-batches of one poll each would be.  A number goes on after a restart.
    """
    if polls > 1:
        fields = StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
        schema = StructType([f for f in fields if f.name != message_store.POLL]).add(message_store.POLL, "long")
    cloudpickle.register_pickle_by_value(message_store)    # the source's workers need not have this package installed
    spark.dataSource.register(message_store.MessageStore)
    raw = (spark.readStream.format("message_store").schema(schema).option("path", path).option("rows", rows).option("polls", polls)
           .option("skip_existing", str(skip_existing).lower()).load())
    return require_columns(raw).filter("DeletedDate IS NULL") if "DeletedDate" in raw.columns else require_columns(raw)


def polled_inputs(raw: DataFrame, history_chars: int | None = None) -> DataFrame:
    """Polled raw messages to input rows, with the number ``Poll`` of their poll if they have one; a message without text and title is none."""
    carry = [c for c in raw.columns if c == message_store.POLL]
    return messages_to_inputs(to_messages(raw, carry), history_chars, carry=carry)


def start_key(spark: SparkSession, raw: DataFrame, state_path: str, skip_existing: bool = True) -> int:
    """Largest key present at the first run (0 when existing messages are wanted), stored once and reused."""
    try:
        return int(spark.read.parquet(state_path).first()["start_key"])
    except AnalysisException:
        pass
    top = F.coalesce(F.max("MessageKey"), F.lit(0)) if skip_existing else F.max(F.lit(0))
    require_columns(raw).agg(F.coalesce(top, F.lit(0)).cast("bigint").alias("start_key")).write.parquet(state_path)
    return int(spark.read.parquet(state_path).first()["start_key"])


def after_key(raw: DataFrame, key: int) -> DataFrame:
    """Typed messages beyond a key.  The filter is on the raw key, so rows with unreadable dates never block it."""
    alive = raw.filter("DeletedDate IS NULL") if "DeletedDate" in raw.columns else raw
    return to_messages(require_columns(alive).filter(F.col("MessageKey") > F.lit(key)))


def deliver_once(messages: DataFrame, key: str = "key", delay: str = "7 days") -> DataFrame:
    """Each key once, however old its own date is.

    The watermark runs on the time of arrival (the clock of the micro-batch), so no message is ever late; the state keeps a
    key for ``delay`` after its arrival and drops the copies that come within it.
    """
    arrived = messages.withColumn("_arrived", F.current_timestamp())
    return arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark([key]).drop("_arrived")


def stream_inputs(raw: DataFrame, key: int, history_chars: int | None = None) -> DataFrame:
    """Raw message stream to input rows."""
    return messages_to_inputs(deliver_once(after_key(raw, key)), history_chars)


def fetch_now(raw: DataFrame, last_key: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Forced fetch: (messages, mark).

    Messages after the key (the first ``limit`` rows of the store, if given), or, when nothing was handled yet, up to five
    unread of the newest twenty, else the newest one; oldest first.  ``mark`` is one row ``last_key`` with the key to go on
    from: the largest that was looked at, so that rows with unreadable dates are passed over and never block.
    """
    if last_key:
        seen = require_columns(raw).filter(F.col("MessageKey") > F.lit(last_key))
        if limit is not None:
            alive = seen.filter("DeletedDate IS NULL") if "DeletedDate" in raw.columns else seen
            seen = alive.orderBy("MessageKey").limit(limit)
        mark = seen.agg(F.coalesce(F.max("MessageKey"), F.lit(last_key)).cast("bigint").alias("last_key"))
        return messages_after(raw, last_key, limit), mark
    latest = latest_messages(raw, FORCED_LATEST)
    unread = latest.filter("is_unread").orderBy(F.desc("key")).limit(FORCED_UNREAD)
    newest = latest.orderBy(F.desc("key")).limit(1)
    any_unread = unread.agg(F.count("*").alias("_n"))
    fallback = newest.filter(any_unread.scalar() == 0)
    return unread.unionByName(fallback).orderBy("key"), latest_key(raw).withColumnRenamed("latest_key", "last_key")
