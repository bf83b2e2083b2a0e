import pytest
from pyspark.sql import functions as F

from noticeflow.operators.completion import complete
from noticeflow.sources import files, messages, sinks
from noticeflow.streaming import errors, polling

RAW = "MessageKey bigint, Sender string, ReceiveDate string, Title string, MessageText string, IsUnRead int, DeletedDate string"


def raw(spark, *rows):
    return spark.createDataFrame([(k, "s", f"2026/07/16 17:04:0{k} (목)", f"t{k}", "b", u, None) for k, u in rows], RAW)


def test_missing_columns_are_named(spark):
    with pytest.raises(messages.SchemaContractError, match="ReceiveDate"):
        messages.latest_key(spark.createDataFrame([(1, "x")], "MessageKey int, Sender string"))


def test_optional_columns(spark):
    df = raw(spark, (1, 1), (2, 0)).drop("IsUnRead", "DeletedDate")
    assert [(r.key, r.is_unread) for r in messages.messages_after(df, 1).collect()] == [(2, False)]


def test_forced_fetch(spark):
    def fetched(df, key, limit=None):
        rows, mark = polling.fetch_now(df, key, limit)
        return [r.key for r in rows.collect()], mark.first()["last_key"]

    df = raw(spark, (4, 1), (5, 0), (6, 1), (7, 0))
    assert fetched(df, 0) == ([4, 6], 7)
    assert fetched(df, 7) == ([], 7)
    assert fetched(raw(spark, (4, 0), (8, 0)), 0) == ([8], 8)
    assert fetched(df, 3, 2) == ([4, 5], 5)
    unreadable = df.withColumn("ReceiveDate", F.when(F.col("MessageKey") < 7, "tomorrow").otherwise(F.col("ReceiveDate")))
    assert fetched(unreadable, 3, 2) == ([], 5) and fetched(unreadable, 5, 2) == ([7], 7)


def test_old_messages_and_copies_in_later_batches(spark, tmp_path):
    for n, rows in enumerate([[(1, "2026"), (2, "2026")], [(3, "2011"), (1, "2026")], [(4, "2026"), (3, "2011")]]):
        part = spark.createDataFrame([(k, "s", f"{year}/07/16 17:04:52", "t", "b") for k, year in rows],
                                     "MessageKey bigint, Sender string, ReceiveDate string, Title string, MessageText string")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = polling.read_messages(spark, str(tmp_path / "in"), part.schema, max_files=1)
        (polling.stream_inputs(stream, 0).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.origin_ref for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3", "4"]


def test_work_runs_once_an_input(spark, tmp_path):
    inputs = spark.createDataFrame([(str(i), "text", f"text {i}" if i else " ") for i in range(10)], "input_id string, kind string, text string")
    inputs.write.parquet(str(tmp_path / "in"))
    calls = str(tmp_path / "calls")

    def work(good):
        def counted(batches):
            for b in batches:
                for i in b["input_id"]:
                    with open(calls, "a") as f:
                        f.write(f"{i}\n")
                yield b[["input_id"]].assign(error=[None if int(i) % 2 else "odd" for i in b["input_id"]])
        return good.mapInPandas(counted, "input_id string, error string")

    stream = spark.readStream.schema(inputs.schema).parquet(str(tmp_path / "in"))
    done = str(tmp_path / "done")
    errors.process_inputs(stream, work, done, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(open(calls).read().split()) == [str(i) for i in range(1, 10)]
    assert sorted(r.input_id for r in sinks.published(spark, done, "results", "input_id string").collect()) == ["1", "3", "5", "7", "9"]
    assert sorted(r.input_id for r in sinks.published(spark, done, "dead", "input_id string, error string").collect()) == ["0", "2", "4", "6", "8"]


def test_start_key_is_stored_once(spark, tmp_path):
    state = str(tmp_path / "start")
    assert polling.start_key(spark, raw(spark, (1, 0), (2, 0)), state) == 2
    assert polling.start_key(spark, raw(spark, (1, 0), (5, 0)), state) == 2
    assert polling.start_key(spark, raw(spark, (1, 0)), str(tmp_path / "other"), skip_existing=False) == 0


def test_poll_interval():
    assert polling.poll_trigger(1) == {"processingTime": "5 seconds"}
    assert polling.poll_trigger() == {"processingTime": "30 seconds"}


def test_table_rows_with_leftover_cells(spark):
    cells = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "b", "", "", "x\ny", "", "z"])], "doc string, seq int, text string")
    counts = spark.createDataFrame([("d", 1, 2), ("d", 2, 2), ("d", 3, 1)], "doc string, row int, n int")
    got = [r.line for r in files.table_rows_by_count(cells, counts, "doc").orderBy("row").collect()]
    assert got == ["| a | b |", "| x y |", "| z |"]


def test_batch_sink_replaces_a_replayed_batch(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_batch(spark.range(3), path, 0)
    sinks.write_batch(spark.range(2), path, 1)
    sinks.write_batch(spark.range(3), path, 1)
    assert spark.read.parquet(path).count() == 6
    sinks.write_run(spark.range(3), str(tmp_path / "run"), "2026-01-01")
    sinks.write_run(spark.range(1), str(tmp_path / "run"), "2026-01-01")
    assert spark.read.parquet(str(tmp_path / "run")).count() == 1


def test_one_failing_call_does_not_stop_the_others(spark):
    def make_client():
        def client(prompt):
            if prompt == "bad":
                raise ValueError("boom")
            return prompt.upper()
        return client

    df = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c")], "input_id string, prompt string")
    got = {r.input_id: (r.raw, r.error) for r in complete(df, make_client).collect()}
    assert got == {"1": ("A", None), "2": (None, "ValueError: boom"), "3": ("C", None)}


def test_unsupported_files_are_never_opened(spark, tmp_path):
    (tmp_path / "note.TXT").write_bytes(b"hello")
    (tmp_path / "clip.mp4").write_bytes(b"x" * 5000)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        good, bad = files.read_files(spark, str(tmp_path))
        assert [(r.name, bytes(r.content)) for r in good.collect()] == [("note.TXT", b"hello")]
        assert [(r.name, r.length) for r in bad.collect()] == [("clip.mp4", 5000)] and "content" not in bad.columns
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def polled(spark, folder, rows=3, fail_at=None, **options):
    """Poll the store to its end and return the keys of each batch; with ``fail_at`` that batch fails once."""
    out = []

    def batch(df, n):
        if n == fail_at:
            raise ValueError("fell over")
        out.append(sorted(r.MessageKey for r in df.collect()))

    run = (polling.poll_store(spark, str(folder / "store"), RAW, rows, **options).writeStream.foreachBatch(batch)
           .option("checkpointLocation", str(folder / "state")).trigger(processingTime="0 seconds").start())
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return [b for b in out if b]


def stored_messages(spark, folder, keys, deleted=()):
    rows = [(k, "s", "2026/07/16 17:04:52", "t", "b", 0, "x" if k in deleted else None) for k in keys]
    spark.createDataFrame(rows, RAW).repartition(2).write.mode("append").parquet(str(folder / "store"))


def test_polls_start_at_the_end_and_go_on_after_a_restart(spark, tmp_path):
    stored_messages(spark, tmp_path, [1, 2, 9])
    assert polled(spark, tmp_path) == []
    stored_messages(spark, tmp_path, [5, 10, 11, 12, 13, 14, 15, 16], deleted=[11, 16])
    assert polled(spark, tmp_path) == [[10, 12, 13], [14, 15]]
    assert polled(spark, tmp_path) == []
    stored_messages(spark, tmp_path, [20, 18, 19, 17])
    assert polled(spark, tmp_path) == [[17, 18, 19], [20]]


def test_a_poll_that_fell_over_is_read_again(spark, tmp_path):
    stored_messages(spark, tmp_path, range(1, 8))
    with pytest.raises(Exception, match="fell over"):
        polled(spark, tmp_path, fail_at=1, skip_existing=False)
    stored_messages(spark, tmp_path, [8])
    assert polled(spark, tmp_path, skip_existing=False) == [[4, 5, 6], [7, 8]]


def test_a_batch_takes_many_polls_and_tells_their_numbers(spark, tmp_path):
    """eleven messages behind are four polls of three, in two batches and not in four; numbers go on after a restart."""
    out = []

    def run():
        raw = polling.poll_store(spark, str(tmp_path / "store"), RAW, 3, skip_existing=False, polls=3)
        one = (polling.polled_inputs(raw).writeStream.foreachBatch(
            lambda df, n: out.append(sorted((int(r.origin_ref), r.Poll) for r in df.collect())))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start())
        try:
            one.processAllAvailable()
        finally:
            one.stop()
        return [b for b in out if b]

    stored_messages(spark, tmp_path, range(1, 13), deleted=[5])
    keys = [k for k in range(1, 13) if k != 5]
    assert run() == [[(k, 1 + i // 3) for i, k in enumerate(keys)][:9], [(11, 4), (12, 4)]]
    out.clear()
    stored_messages(spark, tmp_path, [13, 14])
    assert run() == [[(13, 5), (14, 5)]]


def test_the_next_keys_need_few_groups(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import StructType
    from noticeflow.streaming.message_store import StoreReader

    (tmp_path / "_temporary").mkdir()
    pq.write_table(pa.table({"MessageKey": pa.array([1])}), tmp_path / "_temporary" / "part.parquet")
    pq.write_table(pa.table({"MessageKey": pa.array(range(100, 200))}), tmp_path / "a.parquet", row_group_size=10)
    pq.write_table(pa.table({"MessageKey": pa.array([None, *range(0, 50)])}), tmp_path / "b.parquet", write_statistics=False)
    reader, read = StoreReader(str(tmp_path), 5, False, StructType()), []
    keys = reader._keys
    monkeypatch.setattr(reader, "_keys", lambda *a: read.append(a[:2]) or keys(*a))
    assert reader.latestOffset() == {"key": 4} and len(read) == 1
    reader.partitions({"key": None}, {"key": 119})
    assert reader.latestOffset() == {"key": 124} and len(read) == 3
    reader.partitions({"key": 119}, {"key": 199})
    assert reader.latestOffset() == {"key": 199}
    assert StoreReader(str(tmp_path), 5, True, StructType()).initialOffset() == {"key": 199}
    assert StoreReader(str(tmp_path / "none"), 5, True, StructType()).initialOffset() == {"key": 0}


def in_runs(spark, folder, schema, runs, stream):
    """Rows that a stream gives over several runs, each of which finds one more file and the checkpoint of the one before."""
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        made = stream(spark.readStream.schema(schema).parquet(str(folder / "in")))
        (made.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state"))
         .trigger(availableNow=True).start().awaitTermination())
    return [tuple(r) for r in spark.read.schema(made.schema).parquet(str(folder / "out")).collect()]


def test_the_last_outcome_of_a_source_crosses_batches(spark, tmp_path):
    runs = [[("a", 2, "x"), ("a", 1, "x"), ("b", 1, None), ("c", 1, "y")], [("a", 3, "x"), ("a", 4, ""), ("b", 2, "x")],
            [("a", 5, "x"), ("c", 2, "z"), ("b", 3, "x"), ("c", 3, "z"), (None, 1, "x")], [(None, 2, "x")]]
    got = in_runs(spark, tmp_path, "source string, seq long, error string", runs, errors.suppress_repeats_stream)
    assert sorted(got, key=str) == sorted([("a", 1, "x"), ("a", 5, "x"), ("b", 2, "x"), ("c", 1, "y"), ("c", 2, "z"), (None, 1, "x")], key=str)


def test_timers_and_events_out_of_order(spark, tmp_path):
    from datetime import datetime, timedelta
    from noticeflow.streaming import idle

    def at(minute):
        return datetime(2026, 7, 16, 12) + timedelta(minutes=minute)

    runs = [[("a", at(0)), ("a", at(2)), ("b", at(1))], [("a", at(14)), (None, at(13)), (None, None)], [("a", at(8)), ("b", at(33))], [("clock", at(200))]]
    streams = lambda s: idle.activity_states(s.filter("coalesce(user_id, '') <> 'clock'"), s.filter("user_id = 'clock'"), delay="20 minutes")
    got = in_runs(spark, tmp_path, "user_id string, ts timestamp", runs, streams)
    want = [("a", 0, "idle"), ("a", 7, "bored"), ("a", 8, "idle"), ("a", 13, "bored"), ("a", 14, "idle"), ("a", 19, "bored"), ("a", 44, "sleeping"),
            ("b", 1, "idle"), ("b", 6, "bored"), ("b", 31, "sleeping"), ("b", 33, "idle"), ("b", 38, "bored"), ("b", 63, "sleeping"),
            (None, 13, "idle"), (None, 18, "bored"), (None, 43, "sleeping")]
    assert sorted(got, key=str) == sorted([(u, at(m), s) for u, m, s in want], key=str)


def test_borders_of_a_null_group(spark):
    from noticeflow.operators.neighbours import neighbour

    rows = spark.createDataFrame([(k, i, str(i)) for k in (None, "a") for i in range(4)], "k string, i int, v string")
    got = neighbour(rows, ["k"], "i", "v", "i div 2", "before").collect()
    assert {(r.k, r.i): r.before for r in got} == {(k, i): str(i - 1) if i else None for k in (None, "a") for i in range(4)}


def test_half_a_batch_is_never_seen(spark, tmp_path):
    """The second table fails to be written once: neither is there; the replay publishes both, and a second replay nothing."""
    path = str(tmp_path / "out")
    good, bad = spark.range(3), spark.range(2).selectExpr("id", "raise_error('fell over') AS error")
    fine = spark.range(2).selectExpr("id", "'late' AS error")

    def seen(name, schema):
        return sorted((r.id, r.batch_id) for r in sinks.published(spark, path, name, schema).collect())

    assert seen("results", "id bigint") == []
    assert sinks.publish(path, 0, results=good, dead=fine)
    with pytest.raises(Exception, match="fell over"):
        sinks.publish(path, 1, results=good, dead=bad)
    assert seen("results", "id bigint") == [(0, 0), (1, 0), (2, 0)] and seen("dead", "id bigint, error string") == [(0, 0), (1, 0)]
    assert sinks.publish(path, 1, results=good.limit(1), dead=fine)
    assert not sinks.publish(path, 1, results=good, dead=fine)
    assert seen("results", "id bigint") == [(0, 0), (0, 1), (1, 0), (2, 0)] and len(seen("dead", "id bigint, error string")) == 4


@pytest.mark.parametrize("at_once", [1, 3])
def test_a_task_that_dies_pays_only_for_what_was_not_written(spark, tmp_path, at_once):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")

    def client_that_dies(after):
        def make():
            def client(prompt):
                import os
                with open(log, "a") as f:
                    f.write(prompt + "\n")
                if after and len(open(log).read().split()) == after:
                    os._exit(1)
                if prompt == "p7":
                    raise ValueError("boom")
                return prompt.upper()
            return client
        return make

    df = spark.createDataFrame([(i, f"p{i % 30}") for i in range(40)], "input_id int, prompt string").coalesce(1)
    with pytest.raises(Exception):
        complete(df, client_that_dies(17), ledger=ledger, buckets=1, at_once=at_once).collect()
    got = {r.input_id: (r.raw, r.error) for r in complete(df, client_that_dies(0), ledger=ledger, buckets=1, at_once=at_once).collect()}
    assert got == {i: (None, "ValueError: boom") if i % 30 == 7 else (f"P{i % 30}", None) for i in range(40)}
    calls = open(log).read().split()
    paid_again = len(calls) - 30 - sum(c == "p7" for c in calls) + 1
    assert 1 <= paid_again <= at_once
    complete(df.filter("input_id <> 7 AND input_id <> 37"), client_that_dies(0), ledger=ledger, buckets=1).collect()
    assert len(open(log).read().split()) == len(calls)


def test_a_replayed_batch_without_rows_replaces_too(spark, tmp_path):
    """F8: a batch is written into its own folder at once."""
    path = str(tmp_path / "batches")
    sinks.write_batch(spark.range(2), path, 0)
    sinks.write_batch(spark.range(3), path, 1)
    sinks.write_batch(spark.range(3).filter("id < 0"), path, 1)
    assert sorted((r.id, r.batch_id) for r in spark.read.parquet(path).collect()) == [(0, 0), (1, 0)]
