"""Removal of long byte strings that occur more than once, whole corpus, by a sampled cover of positions.

A difference cover picks positions so that any two equal strings have a pair of picked positions at the same distance from
their starts; the picked positions are sorted and named first and decide about all others.  Here the cover is chosen by
content instead of by the position's remainder: in every window of ``length`` bytes the gram with the least hash is picked.
Two equal windows then pick the same place, and about one position in 90 is picked, where a cover by remainders modulo 3
picks two of three.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import join_split, packed, stored, unpacked

#: Bytes of a gram, bytes that a task works on at a time, words of a Bloom filter at most (16 MB).
GRAM, BLOCK, MOST_WORDS = 16, 1 << 20, 1 << 21
#: Kinds of runs around a gram that are compared in one task (some 5 MB of bytes, 60 MB of hashes); with more, their windows
#: are dealt out.
FEW = 16_384
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class _Powers:
    """Random numbers for bytes and powers of the base, grown as needed; sums over any range of a block become hashes."""

    bytes_ = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)
                cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE, np.uint64)], dtype=np.uint64)


class Block:
    """Some texts end to end, with the hash of any byte range and the runs of windows that share a picked position."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.data = b"".join(texts)
        data = np.frombuffer(self.data, np.uint8)
        n = len(data)
        _Powers.to(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(_Powers.bytes_[data] * _Powers.up[:n], dtype=np.uint64)]
        valid = np.zeros(n + 1, np.int8)
        long_ = sizes >= length
        valid[self.first[long_]] += 1
        valid[(self.first + sizes - length + 1)[long_]] -= 1
        starts = np.flatnonzero(np.cumsum(valid[:n]))
        if not len(starts):
            self.start = self.count = self.owner = np.empty(0, np.int64)
            self.gram = self.whole = np.empty(0, np.uint64)
            return
        grams = _mixed(self.hash(np.arange(n - GRAM + 1), GRAM))
        packed_ = (grams & ~np.uint64((1 << 26) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, step = length - GRAM + 1, 1
        least = packed_
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:len(packed_) - width + 1], least[width - step:][:len(packed_) - width + 1])
        picked = (least[starts] & np.uint64((1 << 26) - 1)).astype(np.int64)
        new = np.r_[True, (picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1)]
        at = np.flatnonzero(new)
        self.start = starts[at]
        self.count = np.diff(np.r_[at, len(starts)])
        self.gram = grams[picked[at]]
        self.whole = _mixed(self.hash(self.start, self.count + length - 1) + self.count.astype(np.uint64))
        self.owner = np.searchsorted(self.first, self.start, "right") - 1

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + size] - self.sums[start]) * _Powers.down[start]


def blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[Block, list[bytes], np.ndarray]]:
    """Blocks of a batch with ``_key`` and ``_text``; each with the key of every piece of text and its offset.

    A text longer than a block is cut into pieces that overlap by ``length - 1`` bytes, so that each window is in one piece.
    """
    keys, offsets, texts, size = [], [], [], 0
    for key, text in zip(batch.column("_key"), batch.column("_text")):
        raw = text.as_py().encode()
        for a in range(0, max(1, len(raw) - length + 1), BLOCK):
            piece = raw[a:a + BLOCK + length - 1]
            if len(piece) < length:
                continue
            keys.append(key.as_py())
            offsets.append(a)
            texts.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield Block(texts, length), keys, np.array(offsets)
                keys, offsets, texts, size = [], [], [], 0
    if texts:
        yield Block(texts, length), keys, np.array(offsets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def filter_words(keys: DataFrame, name: str) -> np.ndarray:
    """A Bloom filter of a column of longs as an array of 64-bit words; its size is bounded, beyond it it lets more through."""
    keys = keys.select(F.col(name).alias("_k"))
    words, wanted = 1024, keys.count() // 4
    while words < min(MOST_WORDS, wanted):
        words *= 2
    bit = [f"shiftleft(1L, cast(shiftrightunsigned(_k, {s}) & 63 as int))" for s in (24, 30, 36)]
    got = (keys.groupBy((F.col("_k").bitwiseAND(F.lit(words - 1))).cast("int").alias("w"))
           .agg(F.expr(f"bit_or({' | '.join(bit)})").alias("m")).toArrow())
    out = np.zeros(words, np.uint64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(keys), np.uint64)
    for s in (24, 30, 36):
        mask |= np.uint64(1) << ((keys >> np.uint64(s)) & np.uint64(63))
    return words[(keys & np.uint64(len(words) - 1)).astype(np.int64)] & mask == mask


def _place(keys: list[bytes], block: Block, offsets: np.ndarray, runs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Key and byte position of runs in their texts, and one number for both, to look them up by."""
    owner = block.owner[runs]
    position = block.start[runs] - block.first[owner] + offsets[owner]
    head = np.array([int.from_bytes(keys[i][:8], "little") for i in range(len(keys))], np.uint64)
    with np.errstate(over="ignore"):
        number = _mixed(head[owner] + position.astype(np.uint64) * BASE)
    return pa.array([keys[i] for i in owner], pa.binary()), position, number


def repeated_ranges(texts: DataFrame, length: int = 200) -> DataFrame:
    """(``_key``, ``_ranges``): byte ranges (start * 1024 + size) of the texts (``_key`` binary, ``_text``) that are covered
    by strings of ``length`` bytes which start more than once in the corpus.

    1. The windows of a text that pick the same position form a run.  The grams at the picked positions are counted over
       the corpus, with the least and greatest hash of the whole runs around them.
    2. A Bloom filter of the grams that occur twice lets about those runs through; they are joined with the exact counts.
       If all runs of a gram are equal, all their windows repeat.
    3. Elsewhere (where a common passage begins, ends or differs) one run of each kind is compared window by window with
       the others of its gram, in one task for a gram of few kinds, by a join of window hashes for a gram of many.  The
       windows of a run overlap, so the first and the last one that repeat say what to remove.
    Runs and windows are told apart by 64-bit hashes.  What is shuffled is 16 bytes for about every 90 bytes of text in the
    first step, far less in the second, and the bytes around the places where copies begin to differ in the third.
    """
    spark = texts.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _ in blocks(batch, length):
                yield pa.RecordBatch.from_arrays([_signed(block.gram), _signed(block.whole)], names=["_g", "_w"])

    found = stored(texts.mapInArrow(grams, "_g long, _w long").groupBy("_g")
                   .agg(F.count("*").alias("_n"), F.min("_w").alias("_low"), F.max("_w").alias("_high")).filter("_n > 1"))
    twice = spark.sparkContext.broadcast(filter_words(found, "_g"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, offsets in blocks(batch, length):
                runs = np.flatnonzero(may_hold(twice.value, block.gram))
                key, position, number = _place(keys, block, offsets, runs)
                yield pa.RecordBatch.from_arrays([key, pa.array(position), _signed(number), pa.array(block.count[runs]),
                                                  _signed(block.gram[runs]), _signed(block.whole[runs])],
                                                 names=["_key", "_at", "_no", "_count", "_g", "_w"])

    runs = stored(join_split(texts.mapInArrow(candidates, "_key binary, _at long, _no long, _count long, _g long, _w long"),
                             found, "_g").withColumn("_same", F.expr("_low = _high")).drop("_n", "_low", "_high"))
    kinds = stored(runs.filter("not _same").groupBy("_g", "_w").agg(F.count("*").alias("_n"), F.min("_no").alias("_no")))
    chosen = spark.sparkContext.broadcast(filter_words(kinds, "_no"))
    many = spark.sparkContext.broadcast(filter_words(kinds.groupBy("_g").count().filter(F.col("count") > FEW), "_g"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, offsets in blocks(batch, length):
                _, _, number = _place(keys, block, offsets, np.arange(len(block.start)))
                picked = np.flatnonzero(may_hold(chosen.value, number))
                ends = block.start[picked] + block.count[picked] + length - 1
                parts = [block.data[a:b] for a, b in zip(block.start[picked].tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [_signed(block.gram[picked]), _signed(block.whole[picked]), pa.array(parts, pa.binary()),
                     pa.array(may_hold(many.value, block.gram[picked]))], names=["_g", "_w", "_part", "_many"])

    around = stored(texts.mapInArrow(contexts, "_g long, _w long, _part binary, _many boolean"))
    here = (around.filter("not _many").select("_g", "_w", "_part").repartition("_g").sortWithinPartitions("_g")
            .mapInArrow(lambda rows: _compare(rows, length), MARKS))
    windows = around.filter("_many").select("_g", "_w", "_part").mapInArrow(lambda rows: _windows(rows, length), MARKS + ", _h long")
    again = windows.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h")
    marks = here.unionByName(join_split(windows, again, "_h").drop("_h"))
    marks = marks.groupBy("_g", "_w").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    whole = kinds.filter("_n > 1").select("_g", "_w", F.lit(0).alias("_first"), F.lit(length).alias("_last"))
    both = F.xxhash64("_g", "_w").alias("_gw")
    marks = stored(whole.unionByName(marks).groupBy("_g", "_w").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
                   .select(both, F.col("_g").alias("_g2"), F.col("_w").alias("_w2"), "_first", "_last"))
    mixed = (join_split(runs.filter("not _same").select("*", both), marks, "_gw").filter("_g = _g2 and _w = _w2")
             .withColumn("_last", F.least("_last", F.col("_count") - 1))
             .select("_key", F.expr(f"(_at + _first) * 1024 + _last - _first + {length}").alias("_range")))
    pieces = mixed.union(runs.filter("_same").select("_key", F.expr(f"_at * 1024 + _count + {length - 1}")))
    return pieces.groupBy("_key").agg(F.collect_set("_range").alias("_ranges"))


MARKS = "_g long, _w long, _first int, _last int"


def _windows_of(g: list[np.ndarray], w: list[np.ndarray], parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(gram, kind, place in its run, hash) of every window of some runs' bytes."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    _Powers.to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_Powers.bytes_[data] * _Powers.up[:len(data)], dtype=np.uint64)]
        count = sizes - length + 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(sizes) - sizes, count) + nth
        hashes = _mixed((sums[start + length] - sums[start]) * _Powers.down[start])
    return np.repeat(np.concatenate(g), count), np.repeat(np.concatenate(w), count), nth, hashes


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            g, w, nth, hashes = _windows_of([part.column("_g").to_numpy()], [part.column("_w").to_numpy()],
                                            part.column("_part").to_pylist(), length)
            place = pa.array(nth.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(w), place, place, _signed(hashes)],
                                             names=["_g", "_w", "_first", "_last", "_h"])


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """First and last repeated window of each kind, for a partition sorted by gram; whole grams are compared at a time."""
    def close(g: list[np.ndarray], w: list[np.ndarray], parts: list[bytes]) -> pa.RecordBatch:
        grams, kinds, nth, hashes = _windows_of(g, w, parts, length)
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[inverse] > 1)
        grams, kinds, nth = grams[twice], kinds[twice], nth[twice]
        edge = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (kinds[1:] != kinds[:-1]) | (nth[1:] <= nth[:-1])]
                              if len(nth) else [])
        last = np.r_[edge[1:], len(nth)] - 1 if len(edge) else edge
        return pa.RecordBatch.from_arrays([pa.array(grams[edge]), pa.array(kinds[edge]), pa.array(nth[edge].astype(np.int32)),
                                           pa.array(nth[last].astype(np.int32))], names=["_g", "_w", "_first", "_last"])

    g, w, parts, size = [], [], [], 0
    for batch in batches:
        grams = batch.column("_g").to_numpy()
        kinds, held = batch.column("_w").to_numpy(), batch.column("_part").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(grams)) + 1).tolist(), len(grams)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if size >= BLOCK and g[-1][-1] != grams[a]:
                yield close(g, w, parts)
                g, w, parts, size = [], [], [], 0
            g.append(grams[a:b])
            w.append(kinds[a:b])
            parts += held[a:b]
            size += sum(map(len, held[a:b]))
    if parts:
        yield close(g, w, parts)


def text_key() -> Column:
    """Half of a text's SHA-256: equal texts share a key, and are cut alike."""
    return F.expr("substring(unhex(sha2(_text, 256)), 1, 16)")


def substring_dedup(df: DataFrame, length: int = 200, text_col: str = "text", id_col: str = "doc_id",
                    carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``kept_text`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Each byte is removed that is covered by a string of ``length`` bytes (up to 500) which also starts anywhere else, in the
    same text or another; overlapping occurrences count, matches never cross texts, and strings are judged on the input.
    What is kept may end within a character, so it is binary.

    Null texts count as empty; texts below ``length`` bytes lose nothing; rows that repeat a text of that length lose all of
    it.  An input column named like an output is replaced.  ``carry`` names the input columns to return (default: the id).
    """
    rows = packed(df, [id_col] if carry is None else carry, _text=text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    rows = rows.withColumn("_key", text_key())
    found = repeated_ranges(rows.filter(F.octet_length("_text") >= length).select("_key", "_text"), length)
    schema = rows.select("_row").schema.add("_kept", "binary").add("_bytes", "long").add("_removed", "long").add("_spans", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("_text"), batch.column("_ranges")):
                raw = text.as_py().encode()
                if not ranges.is_valid:
                    out.append((raw, len(raw), 0, 0))
                    continue
                packed_ = ranges.values.to_numpy()
                start = packed_ >> 10
                cover = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + (packed_ & 1023), minlength=len(raw) + 1)
                gone = np.cumsum(cover[:len(raw)]) > 0
                spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
                out.append((np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), spans))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([o[0] for o in out], pa.binary()),
                                              *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3))],
                                             names=["_row", "_kept", "_bytes", "_removed", "_spans"])

    joined = join_split(rows, found, "_key", "left").select("_row", "_text", "_ranges")
    return unpacked(joined.mapInArrow(cut, schema), kept_text=F.col("_kept"), n_bytes=F.col("_bytes"),
                    n_removed=F.col("_removed"), n_spans=F.col("_spans"))
