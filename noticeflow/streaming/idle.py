"""Idle classification: no input for 5 minutes is bored, for 30 minutes sleeping."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from noticeflow.operators.neighbours import neighbour

# ---- fixed values
BORED_MINUTES, SLEEP_MINUTES = 5, 30


def idle_gaps(events: DataFrame, user: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """Per event the seconds to the user's next one and the state reached in between (null for the last one).

    Events of one instant are ordered by id.
    """
    rows = events.withColumn("_order", F.struct(ts, event))
    gaps = neighbour(rows, [user], "_order", ts, f"date_trunc('DAY', {ts})", "_next", following=True)
    seconds = f"(unix_micros(cast(_next as timestamp)) - unix_micros(cast({ts} as timestamp))) / 1000000"
    return gaps.select(user, event, ts, F.expr(seconds).alias("gap_seconds")).select(
        "*", F.expr(f"CASE WHEN gap_seconds >= {SLEEP_MINUTES * 60} THEN 'sleeping' "
                    f"WHEN gap_seconds >= {BORED_MINUTES * 60} THEN 'bored' WHEN gap_seconds IS NOT NULL THEN 'idle' END")
        .alias("state"))


def activity_sessions(events: DataFrame, minutes: int = BORED_MINUTES, user: str = "user_id", ts: str = "ts",
                      delay: str = "1 hour") -> DataFrame:
    """Runs of activity without a pause of ``minutes``: user, start, end (= when the state is reached), events.

    In a stream a session is emitted once the watermark passes its end.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, delay)
    return timed.groupBy(user, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("n_events")).select(user, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                                               F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events")


def activity_states(events: DataFrame, clock: DataFrame | None = None, user: str = "user_id", ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """State changes of a stream of events: (user, ``at``, ``state``), bored and sleeping by timers, idle again at the next event.

    Kept for each user are the last event, how far its silence was told, and events newer than the watermark; so events out of order
    by up to ``delay`` change nothing.  A timer of a user fires when the watermark passes it, which any user's event moves; ``clock``
    (a stream with a column ``ts`` only, such as the rate source's time) moves it when no one does anything.  The first event of a
    user makes it idle.  Events without a time are no events; a null user is a user.
    """
    rows = events.select(F.col(user).alias("user"), F.col(ts).cast("timestamp").alias("ts"), F.lit(False).alias("tick")).filter("ts IS NOT NULL")
    kind = rows.schema["user"].dataType.simpleString()
    if clock is not None:
        rows = rows.unionByName(clock.select(F.lit(None).cast(kind).alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("tick")))
    timed = rows.withWatermark("ts", delay)
    minutes = ((BORED_MINUTES * 60_000_000, "bored"), (SLEEP_MINUTES * 60_000_000, "sleeping"))
    none = -1 << 62

    def changes(key, parts, state):
        """Times are microseconds; ``told`` says how many of the states of silence have been told since ``last``."""
        if key[1]:
            return
        last, told, waiting = state.get if state.exists else (none, 0, [])
        waiting = list(waiting)
        if not state.hasTimedOut:
            for part in parts:
                waiting += (part["ts"].astype("datetime64[us]").astype("int64")).tolist()
        waiting.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        out = []

        def silence(until: int) -> None:
            nonlocal told
            while last != none and told < len(minutes) and last + minutes[told][0] <= until:
                out.append((last + minutes[told][0], minutes[told][1]))
                told += 1

        done = 0
        for at in waiting:
            if at > mark:
                break
            done += 1
            silence(at)
            if last == none or told:
                out.append((at, "idle"))
            last, told = max(last, at), 0
        silence(mark)
        waiting = waiting[done:]
        due = [waiting[0]] if waiting else []
        if last != none and told < len(minutes):
            due.append(last + minutes[told][0])
        state.update((last, told, waiting))
        if due:    # milliseconds, and after the watermark
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, -(-min(due) // 1000)))
        if out:
            yield pd.DataFrame({"user": pd.Series([key[0]] * len(out), dtype=object if key[0] is None else None),
                                "at": pd.to_datetime([a for a, _ in out], unit="us", utc=True), "state": [s for _, s in out]})

    found = timed.groupBy("user", "tick").applyInPandasWithState(
        changes, f"user {kind}, at timestamp, state string", "last long, told int, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("user").alias(user), "at", "state")
