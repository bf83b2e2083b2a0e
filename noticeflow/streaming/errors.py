"""Repeated errors are reported once; failing inputs go to a dead-letter table and the stream goes on."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from noticeflow.operators.inputs import route, split_errors
from noticeflow.operators.neighbours import neighbour
from noticeflow.plans.durable import durable
from noticeflow.sources.sinks import publish

BLOCK = 65_536


def suppress_repeats(polls: DataFrame, source: str = "source", seq: str = "seq", error: str = "error") -> DataFrame:
    """Errors that differ from the outcome of the poll before; a success (null or '') resets."""
    with_before = neighbour(polls.withColumn("_e", F.coalesce(error, F.lit(""))), [source], seq, "_e",
                            f"floor({seq} / {BLOCK})", "_before")
    return with_before.filter("_e <> '' AND _e <> coalesce(_before, '')").select(*polls.columns)


def suppress_repeats_stream(polls: DataFrame, source: str = "source", seq: str = "seq", error: str = "error",
                            forget: str = "30 days") -> DataFrame:
    """The same for a stream: (source, seq, error) of errors that differ from the outcome of the poll before.

    The state store holds one value a source, its last outcome, and drops it when the source has been silent for ``forget`` by
    the time of arrival (the clock of the batches); a batch costs what it brings, however many sources are known.  A source's
    polls must come in order from batch to batch; inside a batch they are put in order, for which a source's numbers and errors
    of one batch must fit a task: bound the batches.
    """
    silent = int(pd.Timedelta(forget).total_seconds() * 1000)
    rows = polls.select(F.col(source).alias("source"), F.col(seq).cast("long").alias("seq"), F.coalesce(error, F.lit("")).alias("error"),
                        F.current_timestamp().alias("arrived")).withWatermark("arrived", "1 hour")
    kind = rows.schema["source"].dataType.simpleString()

    def fresh(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")
        before = got["error"].shift(1)
        before.iloc[0] = state.get[0] if state.exists else ""
        state.update((got["error"].iloc[-1],))
        state.setTimeoutTimestamp(int(got["arrived"].max().timestamp() * 1000) + silent)
        yield got[(got["error"] != "") & (got["error"] != before)][["source", "seq", "error"]]

    found = rows.groupBy("source").applyInPandasWithState(fresh, f"source {kind}, seq long, error string", "last string", "append",
                                                          GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("source").alias(source), F.col("seq").alias(seq), F.col("error").alias(error))


def process_inputs(inputs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Stream writer: every input is handled on its own; rows with an error become dead letters and the stream goes on.

    ``work`` maps good inputs to results and marks its own failures in an ``error`` column, if it has one.  Its result is
    made durable before it is split, so that it runs once a batch and an input ends in one of the two tables.  ``results`` and
    ``dead`` (input_id, error) of a batch are published together at ``path``: read them by :func:`published`.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        good, bad = split_errors(route(df))
        done = durable(work(good.drop("parser")))
        dead = bad.select("input_id", "error")
        if "error" in done.columns:
            dead = dead.unionByName(done.filter("error IS NOT NULL").select("input_id", "error"))
            done = done.filter("error IS NULL").drop("error")
        publish(path, batch_id, results=done, dead=dead)

    return inputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
