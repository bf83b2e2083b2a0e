"""The strong model as one path: chunks, token scores, spans, and what chunks share put together again.

Only chunks of bounded length reach Python; spans come back to their row by its key.
"""
from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.spans import empty
from noticeflow.functions.text import fn, is_blank, let, once
from noticeflow.operators.pii_detect import FAMILIES, chunk_text, model_spans, trim_span
from noticeflow.operators.pii_mask import mask

#: For each text its tokens (start, end, label, score), in order; labels are ``B-x``, ``I-x``, ``S-x`` or ``O``.
Scorer = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]
TOKEN = "struct<start:int,end:int,label:string,score:double>"
FOUND = "struct<label:string,start:int,end:int,score:double>"
MIN_SCORE = 0.35


def score_chunks(chunks: DataFrame, make_scorer: Callable[[], Scorer], name: str = "model", text: str = "chunk_text",
                 at_once: int = 32) -> DataFrame:
    """``chunks`` with ``tokens``: the model is made once a worker process and kept there under ``name``; it gets ``at_once`` texts."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sys.modules.setdefault("_noticeflow_models", types.ModuleType("_noticeflow_models")).__dict__
        if name not in models:
            models[name] = make_scorer()
        token = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for i in range(0, len(batch), at_once):
                part = batch.slice(i, at_once)
                scored = models[name](part.column(text).to_pylist())
                rows = [[{"start": s, "end": e, "label": k, "score": p} for s, e, k, p in tokens] for tokens in scored]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, token)], names=[*part.schema.names, "tokens"])

    return chunks.mapInArrow(run, f"{kept}, tokens array<{TOKEN}>")


def decoded(tokens: str) -> str:
    """array<FOUND> of a chunk's tokens: a span starts at a B or S token, at a change of category and after an O or empty one; its
    score is the mean of its tokens'."""
    state = "struct<out:array<struct<label:string,start:int,end:int,sum:double,n:int>>,gap:boolean>"

    def step(acc: str, t: str) -> str:
        cat = f"if(contains({t}.label, '-'), substring({t}.label, instr({t}.label, '-') + 1), '')"
        last = f"get({acc}.out, size({acc}.out) - 1)"
        opens = f"substring_index({t}.label, '-', 1) IN ('B', 'S') OR {acc}.gap OR {last}.label <> {cat}"
        new = f"named_struct('label', {cat}, 'start', {t}.start, 'end', {t}.end, 'sum', {t}.score, 'n', 1)"
        grown = (f"named_struct('label', {last}.label, 'start', {last}.start, 'end', {t}.end, 'sum', {last}.sum + {t}.score, "
                 f"'n', {last}.n + 1)")
        return (f"cast(CASE WHEN {t}.start = {t}.end OR {t}.label = 'O' THEN named_struct('out', {acc}.out, 'gap', true) "
                f"WHEN {opens} THEN named_struct('out', array_append({acc}.out, {new}), 'gap', false) "
                f"ELSE named_struct('out', array_append(slice({acc}.out, 1, size({acc}.out) - 1), {grown}), 'gap', false) END as {state})")

    spans = f"aggregate({tokens}, cast(named_struct('out', array(), 'gap', true) as {state}), {fn(step, 'a', 't')}, a -> a.out)"
    return f"transform({spans}, s -> named_struct('label', s.label, 'start', s.start, 'end', s.end, 'score', s.sum / s.n))"


def reconciled(found: str) -> str:
    """One span for those of one label that overlap: seen by both of two chunks, or cut by the end of one of them.

    A chunk by itself never gives two spans that overlap, so overlapping ones are the same text, or its two parts.
    """
    def step(acc: str, s: str) -> str:
        last = f"get({acc}, size({acc}) - 1)"
        joined = (f"named_struct('label', {s}.label, 'start', {last}.start, 'end', greatest({last}.end, {s}.end), "
                  f"'score', greatest({last}.score, {s}.score))")
        return (f"cast(if(size({acc}) > 0 AND {last}.label = {s}.label AND {s}.start < {last}.end, "
                f"array_append(slice({acc}, 1, size({acc}) - 1), {joined}), array_append({acc}, {s})) as array<{FOUND}>)")

    return let(f"array_sort({found})", lambda ordered: f"aggregate({ordered}, {empty(f'array<{FOUND}>')}, {fn(step, 'a', 's')})")


def strong_spans(df: DataFrame, make_scorer: Callable[[], Scorer], key: str, text: str = "text", name: str = "model", size: int = 600,
                 overlap: int = 100, min_score: float = MIN_SCORE) -> DataFrame:
    """(key, ``found``): the model's spans of each row that has some, by character places of its whole text.

    Spans are trimmed in their chunk; those below ``min_score`` or blank are left out; what the ``overlap`` of two chunks shares or
    cuts is put together.  A span longer than the overlap is whole if every chunk sees its part of it.
    """
    chunks = chunk_text(df.select(key, F.col(text).alias("_text")), "_text", size, overlap).select(key, "chunk_start", "chunk_text")
    scored = score_chunks(chunks, make_scorer, name)
    spans = scored.selectExpr(key, "chunk_start", "chunk_text", f"inline({decoded('tokens')})").filter(F.col("score") >= min_score)
    value = "substring(chunk_text, start + 1, end - start)"
    trimmed = once(spans.withColumn("_value", F.expr(value)), f"named_struct('_t', {trim_span('label', '_value')})")
    placed = trimmed.filter(f"NOT {is_blank('_t.value')}").selectExpr(
        key, "label", "int(chunk_start + start + _t.lead) AS start", "int(chunk_start + start + _t.lead + length(_t.value)) AS end", "score")
    rows = placed.groupBy(key).agg(F.collect_list(F.struct("label", "start", "end", "score")).alias("_all"))
    return rows.select(key, F.expr(reconciled("_all")).alias("found"))


def mask_strong(df: DataFrame, make_scorer: Callable[[], Scorer], key: str, text: str = "text", name: str = "model", families=FAMILIES,
                rules=None, **chunking) -> DataFrame:
    """:func:`mask` with the model's spans beside the rules'; ``key`` tells the rows apart and is never null."""
    found = strong_spans(df, make_scorer, key, text, name, **chunking).withColumnRenamed("found", "_found")
    joined = df.join(found, key, "left")
    return mask(joined, text, families, rules, extra_spans=model_spans(text, "_found")).drop("_found")
