"""Completion hook: a caller-supplied model client applied to prompts, with one repair and one request retry."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import let, once
from noticeflow.operators.responses import extract_json, has_request, items_of
from noticeflow.plans.durable import durable

# ---- fixed values: what the second requests add to a prompt
REPAIR = '이전 응답이 올바른 JSON이 아니었습니다. 같은 입력에 대해 규칙대로 JSON 하나만 다시 출력하세요.\n{"items": [...]}'
REQUEST_HINT = ('※ 이 입력에는 요청·부탁 표현이 있습니다. 날짜가 없더라도 요청된 행동을 각각 task(date=null)로 추출하세요.\n'
                '예: "명단 제출해 주세요" → {"title": "명단 제출", "date": null, "kind": "task"}')

Client = Callable[[str], str]


def complete(prompts: DataFrame, make_client: Callable[[], Client], key: str = "input_id",
             prompt: str = "prompt", ledger: str | None = None, buckets: int = 64, at_once: int = 20) -> DataFrame:
    """(key, raw, error): one client per partition; a failing call becomes an error row.

    ``ledger`` names a folder that all executors reach (local, HDFS, S3).  Answers are written there under the hash of their
    prompt, ``at_once`` of them at a time, and looked up before a call is made: a task that is lost, a job that is run again or a
    prompt that occurs twice pays at most for what was not written yet.  Prompts are dealt to ``buckets`` by hash, and a task
    reads the folders of its own buckets only.  Failed calls are not written.
    """
    key_type = prompts.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, raw string, error string"

    def ask(client: Client, text: str) -> tuple[str | None, str | None]:
        try:
            return client(text), None
        except Exception as e:  # noqa: BLE001 - one bad input must not stop the others
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            got = [ask(client, text) for text in batch[prompt]]
            yield pd.DataFrame({key: batch[key], "raw": [g[0] for g in got], "error": [g[1] for g in got]})

    def run_with_ledger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, root = pafs.FileSystem.from_uri(ledger) if "://" in ledger or ledger.startswith("file:/") else (pafs.LocalFileSystem(), ledger)
        known: dict[int, dict[str, str]] = {}

        def answers(bucket: int) -> dict[str, str]:
            if bucket not in known:
                known[bucket] = {}
                fs.create_dir(f"{root}/{bucket}")
                for info in fs.get_file_info(pafs.FileSelector(f"{root}/{bucket}")):
                    if info.path.endswith(".parquet"):
                        with fs.open_input_file(info.path) as f:
                            rows = pq.read_table(f).to_pydict()
                        known[bucket].update(zip(rows["hash"], rows["raw"]))
            return known[bucket]

        def write(bucket: int, new: dict[str, str]) -> None:
            name = f"{root}/{bucket}/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{name}.draft") as f:
                pq.write_table(pa.table({"hash": pa.array(list(new), pa.string()), "raw": pa.array(list(new.values()), pa.string())}), f)
            fs.move(f"{name}.draft", f"{name}.parquet")

        client = make_client()
        for batch in batches:
            out: list[tuple[str | None, str | None]] = [(None, None)] * len(batch)
            for bucket, places in batch.groupby("_bucket").indices.items():
                had, new = answers(int(bucket)), {}
                try:
                    for i in places:
                        digest = batch["_hash"].iloc[i]
                        if digest not in had:
                            raw, error = ask(client, batch[prompt].iloc[i])
                            if error is not None or raw is None:
                                out[i] = (raw, error)
                                continue
                            had[digest] = new[digest] = raw
                            if len(new) == at_once:
                                write(int(bucket), new)
                                new = {}
                        out[i] = (had[digest], None)
                finally:
                    if new:
                        write(int(bucket), new)
            yield pd.DataFrame({key: batch[key], "raw": [g[0] for g in out], "error": [g[1] for g in out]})

    if ledger is None:
        return prompts.select(key, prompt).mapInPandas(run, schema)
    hashed = prompts.select(key, prompt, F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256).alias("_hash"))
    dealt = hashed.withColumn("_bucket", F.pmod(F.xxhash64("_hash"), F.lit(buckets)).cast("int")).repartition(buckets, "_bucket")
    return dealt.mapInPandas(run_with_ledger, schema)


def complete_with_retries(requests: DataFrame, make_client: Callable[[], Client], key: str = "input_id",
                          prompt: str = "prompt", text: str = "text", ref: str = "reference_date", ledger: str | None = None) -> DataFrame:
    """(key, raw, error, attempts) after at most one JSON repair and one request retry.

    The requests and each pass are made durable before the next one reads them, so nothing is computed or called twice.  Only rows without JSON are
    repaired; only rows without items whose text asks for something are asked again, and a second answer counts only
    when it has items.  ``ledger`` as in :func:`complete`; it tells passes apart, since their prompts differ.
    """
    requests = durable(requests.select(key, prompt, text, ref))
    first = durable(complete(requests, make_client, key, prompt, ledger).withColumn("attempts", F.lit(1)))
    parsed = once(first, f"named_struct('_ok', {let('coalesce(raw, ' + chr(39) * 2 + ')', extract_json)} IS NOT NULL)")
    bad = parsed.filter("error IS NULL AND NOT _ok").select(key)
    again = requests.join(bad, key, "left_semi").withColumn(prompt, F.concat(prompt, F.lit("\n\n" + REPAIR)))
    second = durable(complete(again, make_client, key, prompt, ledger).withColumn("attempts", F.lit(2)))
    answers = parsed.drop("_ok").join(bad, key, "left_anti").unionByName(second)

    dated = answers.join(requests.select(key, ref, text), key)
    data = let("coalesce(raw, '')", extract_json)
    judged = once(dated, f"named_struct('_n', {let(data, lambda d: f'size({items_of(d, ref, chr(39) * 2)}.items)')}, "
                         f"'_json', {data} IS NOT NULL)")
    judged = judged.withColumn("error", F.expr(
        "if(error IS NULL AND NOT _json, '모델 응답을 해석할 수 없습니다', error)"))
    ask = judged.filter(f"error IS NULL AND _n = 0 AND {has_request(text)}").select(key)
    hinted = requests.join(ask, key, "left_semi").withColumn(prompt, F.concat(prompt, F.lit("\n\n" + REQUEST_HINT)))
    third = durable(complete(hinted, make_client, key, prompt, ledger)).join(requests.select(key, ref), key)
    better = once(third, f"named_struct('_m', {let(data, lambda d: f'size({items_of(d, ref, chr(39) * 2)}.items)')})")
    better = better.filter("error IS NULL AND _m > 0").select(key, F.col("raw").alias("_raw"))
    return judged.join(better, key, "left").select(
        key, F.coalesce("_raw", "raw").alias("raw"), "error",
        F.when(F.col("_raw").isNotNull(), F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"))
