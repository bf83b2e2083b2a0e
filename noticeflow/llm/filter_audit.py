"""Filter interaction audit: one byte pass measures each text, then every order of the filters is accounted for."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import join_split, packed, stored, unpacked

#: Failure conditions over the measures of :func:`measures` and ``copy`` (an equal text has a smaller id).
FILTERS = {"A": "words < 200", "B": "100 * distinct_words < 50 * words", "C": "100 * capitals > 2 * chars", "D": "symbols > 0",
           "E": "copy"}
MEASURES = ("words", "distinct_words", "capitals", "chars", "symbols")
#: What the transducer puts out for a byte: white space, a capital, a symbol, a byte within a code point.
SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
OUT = np.zeros(256, np.uint8)
OUT[[9, 10, 11, 12, 13, 32]] = SPACE
OUT[65:91] = CAPITAL
OUT[list(b"#$%&*|")] = SYMBOL
OUT[128:192] = INNER
#: Bytes of text put together for one table of spans, and bytes that pass at a time.
TOGETHER, AT_ONCE = 1 << 20, 1 << 20
#: Eight bytes are hashed and compared at a time, so many times; the rest of a longer word goes as a whole.
ROUNDS = 8
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


class Spans:
    """Hash table of distinct spans (owner, bytes) of ``data``: open addressing, all spans of a block at once.

    Spans are the same only if owner, length and bytes are equal; the hash only finds candidates.  ``data`` ends with eight
    bytes that no span covers.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
        self.hash = np.empty(0, np.uint64)
        self.owner = self.start = self.size = np.empty(0, np.int64)
        self._table(1 << 12)

    def _table(self, slots: int) -> None:
        self.slots = np.full(slots, -1, np.int64)
        todo = np.arange(len(self.hash))
        at = self._slot(self.hash)
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = free
            todo = todo[self.slots[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & (slots - 1)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _chunks(self, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        return self.eight[start + 8 * k] & MASKS[np.minimum(size - 8 * k, 8)]

    def _hashes(self, owner: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        on = np.arange(len(start))
        for k in range(ROUNDS):
            on = on[size[on] > 8 * k]
            if not len(on):
                break
            h = (out[on] ^ self._chunks(start[on], size[on], k)) * np.uint64(0xBF58476D1CE4E5B9)
            out[on] = h ^ (h >> np.uint64(29))
        for i in on[size[on] > 8 * ROUNDS].tolist():
            rest = self.data[start[i] + 8 * ROUNDS:start[i] + size[i]]
            out[i] = out[i] ^ np.uint64(xxhash.xxh64_intdigest(rest))
        out = out * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(31))

    def _same(self, a: np.ndarray, b: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        same = (hashes[a] == hashes[b]) & (owner[a] == owner[b]) & (size[a] == size[b])
        on = np.flatnonzero(same)
        for k in range(ROUNDS):
            on = on[same[on] & (size[a[on]] > 8 * k)]
            if not len(on):
                break
            same[on] = self._chunks(start[a[on]], size[a[on]], k) == self._chunks(start[b[on]], size[b[on]], k)
        for i in on[same[on] & (size[a[on]] > 8 * ROUNDS)].tolist():
            p, q, n = start[a[i]], start[b[i]], size[a[i]]
            same[i] = np.array_equal(self.data[p + 8 * ROUNDS:p + n], self.data[q + 8 * ROUNDS:q + n])
        return same

    def insert(self, owner: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        known = len(self.hash)
        while 2 * (known + len(start)) > len(self.slots):
            self._table(4 * len(self.slots))
        new = self._hashes(owner, start, size)
        at = self._slot(new)
        owner, start, size = (np.concatenate(x) for x in ((self.owner, owner), (self.start, start), (self.size, size)))
        hashes = np.concatenate((self.hash, new))
        todo, first = np.arange(len(new)), [np.empty(0, np.int64)]
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = known + free
            holds = self.slots[at[todo]]
            mine = holds == known + todo
            first.append(todo[mine])
            left = ~mine
            left[left] = ~self._same(holds[left], known + todo[left], owner, start, size, hashes)
            todo = todo[left]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        first = np.sort(np.concatenate(first))
        self.slots[at[first]] = known + np.arange(len(first))
        keep = np.concatenate((np.arange(known), known + first))
        self.owner, self.start, self.size, self.hash = owner[keep], start[keep], size[keep], hashes[keep]


def measure(texts: list[bytes]) -> np.ndarray:
    """A row of :data:`MEASURES` for each text of UTF-8 bytes.

    The transducer has two states, within a word and outside; a byte's entry of ``OUT`` is what it puts out and, since white
    space alone leads outside, also its next state.  Texts go through one after the other with a space between them, in
    blocks: the state and the start of an open word are carried on, and the spans of ended words go into the table.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    data = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
    spans, total = Spans(data), int(starts[-1])
    counts = np.zeros((len(MEASURES), len(texts)), np.int64)

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=len(texts))

    inside, open_at = False, 0
    inner = np.zeros(len(texts), np.int64)
    for at in range(0, total, AT_ONCE):
        out = OUT[data[at:min(at + AT_ONCE, total)]]
        word = (out & SPACE) == 0
        change = np.flatnonzero(np.diff(word, prepend=inside)) + at
        borders = np.concatenate(([open_at], change)) if inside else change
        inside = bool(word[-1])
        if inside:
            open_at, borders = int(borders[-1]), borders[:-1]
        begin, end = borders[::2], borders[1::2]
        owner = np.searchsorted(starts, begin, "right") - 1
        counts[0] += np.bincount(owner, minlength=len(texts))
        spans.insert(owner, begin, end - begin)
        counts[2] += per_text(np.flatnonzero(out & CAPITAL) + at)
        counts[4] += per_text(np.flatnonzero(out & SYMBOL) + at)
        inner += per_text(np.flatnonzero(out & INNER) + at)
    counts[1] = np.bincount(spans.owner, minlength=len(texts))
    counts[3] = lengths - inner
    return counts


def measures(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with the numbers of ``words``, ``distinct_words``, ``capitals`` (A-Z), ``chars`` and ``symbols``.

    Words are maximal runs of anything but ASCII white space, told apart by their bytes; symbols are ``# $ % & * |``.  Null and
    empty texts measure zero.  An input column named like an output is replaced.
    """
    rows = packed(df, carry, _text=text_col).withColumn("_text", F.col("_text").cast("string").cast("binary"))
    schema = rows.select("_row").schema
    for name in MEASURES:
        schema = schema.add(f"_{name}", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column("_text"), 0
            while start < len(batch):
                part, size = [], 0
                while start + len(part) < len(batch) and size < TOGETHER:
                    part.append(texts[start + len(part)].as_py() or b"")
                    size += len(part[-1])
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(start, len(part)), *map(pa.array, measure(part))],
                                                 names=["_row", *(f"_{m}" for m in MEASURES)])
                start += len(part)

    return unpacked(rows.mapInArrow(run, schema), **{m: F.col(f"_{m}") for m in MEASURES})


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, id_col: str = "doc_id",
                 text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step: what that step removes and what it loses.

    (``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``,
    ``shapley``).  ``filters`` maps a letter to the condition under which a document fails, over the measures and ``copy``
    (default: :data:`FILTERS`; at most six).  Which filters a document fails does not depend on the order, so documents are counted
    by part and set of failed filters first, and the orders are worked out on these counts: at most 64 for a part.

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``; a document with several labels is good or toxic if one says so.  A null
    part is the empty string, a null text is empty.  A row is a copy if an equal text has a smaller id, so rows of one id are
    none of each other, and a row without an id neither is one nor makes one; it has no label.  An empty table has no parts.
    """
    filters = FILTERS if filters is None else filters
    if len(filters) > 6:
        raise ValueError("six filters have 720 orders; more are not supported")
    letters, hundred = list(filters), len(list(permutations(filters)))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("_part_of"),
                       F.col(f"`{text_col}`").alias("_text"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)).alias("_sha"))
    measured = stored(measures(base, "_text", ["_id", "_part_of", "_sha"]))
    first = measured.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    label = (labels.select(F.col("doc_id").alias("_id"), "quality", "toxic").groupBy("_id")
             .agg(F.max(F.expr("int(quality = 1)")).alias("_good"), F.max(F.expr("int(toxic = 1)")).alias("_toxic")))
    rows = join_split(join_split(measured, first, "_sha", "left"), label, "_id", "left")
    rows = rows.withColumn("copy", F.expr("coalesce(_first < _id, false)"))
    mask = " | ".join(f"if({filters[x]}, {1 << k}, 0)" for k, x in enumerate(letters))
    counts = (rows.groupBy("_part_of", F.expr(mask).alias("_mask"))
              .agg(F.count("*").alias("n"), F.sum(F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic")))
    parts = counts.groupBy("_part_of").agg(F.collect_list(F.struct(F.col("_mask").alias("m"), "n", "good", "toxic")).alias("_sets"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = (parts.select("*", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
             .withColumn("_own", F.expr(f"shiftleft(1, instr('{''.join(letters)}', substr(filter_order, step, 1)) - 1)"))
             .withColumn("_before", F.expr(f"aggregate(sequence(1, {len(letters)}), 0, (a, k) -> if(k < step, "
                                           f"a | shiftleft(1, instr('{''.join(letters)}', substr(filter_order, k, 1)) - 1), a))")))

    def total(value: str, where: str) -> str:
        return f"aggregate(_sets, 0L, (a, s) -> if({where}, a + {value}, a))"

    own, before = "(s.m & _own) <> 0", "(s.m & _before)"
    return steps.select(
        F.col("_part_of").alias("part"), "filter_order", "step",
        F.expr(total("s.n", f"{before} = 0 AND NOT {own}")).alias("kept"), F.expr(total("s.n", f"{own} AND {before} = 0")).alias("removed"),
        F.expr(total("s.n", f"{own} AND {before} <> 0")).alias("redundant"), F.expr(total("s.n", "s.m = _own")).alias("unique_fails"),
        F.expr(total("s.good", f"{own} AND {before} = 0")).alias("good_lost"), F.expr(total("s.toxic", f"{own} AND {before} = 0")).alias("toxic_lost"),
        F.expr(total(f"s.n * {hundred} div bit_count(s.m)", own)).alias("shapley"))
