"""Byte-level BPE: pieces of equal length class are merged together as rows of padded matrices."""
from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import packed, unpacked

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes are merged one by one with a heap: a matrix row loses one column a round.
LONG_PIECE = 1024
#: Encoded pieces that a task remembers before it starts afresh; nothing but time depends on it.
REMEMBERED = 400_000
#: Characters of text that a task cuts into pieces at a time.
TEXT_AT_ONCE = 2_000_000
#: A space beside more white space.
WIDE_SPACE = re.compile(r" \s|\s ")
#: Cells of one matrix, so that it stays in a core's cache.
CELLS = 1 << 16


class Vocabulary:
    """Ranks of a vocabulary with a hash table of the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.byte_ids = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte_ids[b] = ranks[bytes([b])]
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._build(np.array(left, np.uint64), np.array(right, np.uint64), np.array(merged, np.int32))

    def _build(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing: all keys try their slot, those that lose move one on, until every key has a slot."""
        keys = (left << np.uint64(32)) | right
        self.shift = np.uint64(64 - max(10, int(4 * max(1, len(keys))).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, NONE, np.int32)
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slots[todo]] == np.uint64(2**64 - 1)]
            self.keys[slots[free]] = keys[free]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask
        self.values[slots] = merged

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of the merged pair, or NONE; ids below 0 are padding."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | right.astype(np.int64).view(np.uint64)
        keys = np.where((left < 0) | (right < 0), np.uint64(2**64 - 2), keys)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (at != np.uint64(2**64 - 1))]
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of pieces of similar length.

        Each round merges the leftmost pair of least rank in every row and closes the gap, so a round makes the matrix one
        column narrower; rows without a pair to merge leave it.
        """
        width, n = max(map(len, pieces)), len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out = [b""] * n
        rows = np.arange(n)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
        while len(rows):
            if ids.shape[1] > 1:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(rows)), at]
            else:
                at, least = np.zeros(len(rows), np.int64), np.full(len(rows), NONE)
            stop = least == NONE
            if stop.any():
                done = ids[stop]
                raw = done.astype("<i4").tobytes()
                step = 4 * done.shape[1]
                for i, (row, size) in enumerate(zip(rows[stop].tolist(), (4 * (done >= 0).sum(1)).tolist())):
                    out[row] = raw[i * step:i * step + size]
                go = np.flatnonzero(~stop)
                if not len(go):
                    break
                rows, at, ids, ranks, least = rows[go], at[go], ids[go], ranks[go], least[go]
            n, each = len(rows), np.arange(len(rows))
            ids[each, at] = least
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, -1)
            ranks = ranks[keep[:, 1:]].reshape(n, -1)
            if ids.shape[1] > 1:
                before = np.flatnonzero(at > 0)
                ranks[before, at[before] - 1] = self.pair_ranks(ids[before, at[before] - 1], ids[before, at[before]])
                after = np.flatnonzero(at < ids.shape[1] - 1)
                ranks[after, at[after]] = self.pair_ranks(ids[after, at[after]], ids[after, at[after] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Little-endian ids of one long piece: a heap of (rank, place) over a linked list, in the same order of merges."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        tokens, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = first.tolist() + [int(NONE)]

        def renew(i: int) -> None:
            if i < 0 or after[i] >= n:
                return
            pair = self.tokens[tokens[i]] + self.tokens[tokens[after[i]]]
            rank_at[i] = self.ranks.get(pair, int(NONE))
            if rank_at[i] != NONE:
                heapq.heappush(heap, (rank_at[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if tokens[i] < 0 or rank_at[i] != rank or after[i] >= n:
                continue
            gone = after[i]
            tokens[i], tokens[gone] = rank, -1
            rank_at[i] = rank_at[gone] = int(NONE)
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            renew(before[i])
        return np.array([t for t in tokens if t >= 0], "<i4").tobytes()

    @property
    def ranks(self) -> dict[bytes, int]:
        if not hasattr(self, "_ranks"):
            self._ranks = {t: i for i, t in self.tokens.items()}
        return self._ranks

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of distinct pieces, merged in buckets of lengths between powers of two."""
        out: dict[str, bytes] = {}
        buckets: dict[int, list[str]] = {}
        raw = {p: p.encode() for p in pieces}
        for p, b in raw.items():
            if len(b) > LONG_PIECE:
                out[p] = self.merge_long(b)
            else:
                buckets.setdefault((len(b) - 1).bit_length(), []).append(p)
        for bits, group in buckets.items():
            at_once = max(1, CELLS >> bits)
            for i in range(0, len(group), at_once):
                part = group[i:i + at_once]
                out.update(zip(part, self.merge_matrix([raw[p] for p in part])))
        return out


class Encoder:
    """Texts to ids and back, remembering what it has seen.

    A match of the pattern holds a space only as its first character or within a run of white space.  Where a single space
    stands between two other characters a match therefore begins, and a text without longer runs around its spaces may be
    cut there first: each word with its space is matched and merged once and looked up from then on.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: bool = True):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.words = words
        self.pieces: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.pieces)
        if new:
            self.pieces.update(self.vocabulary.encode_pieces(new))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        find = self.pattern.findall
        heads, tails = [], []
        for text in texts:
            if self.words and not WIDE_SPACE.search(text):
                head, *tail = text.split(" ")
            else:
                head, tail = text, []
            heads.append(find(head))
            tails.append(tail)
        new = {w: find(" " + w) for w in set().union(*tails).difference(self.spaced)}
        self._learn(set().union(*heads, *new.values()))
        of = self.pieces.__getitem__
        self.spaced.update({w: b"".join(map(of, p)) for w, p in new.items()})
        spaced = self.spaced.__getitem__
        out = [b"".join(map(of, h)) + b"".join(map(spaced, t)) for h, t in zip(heads, tails)]
        for known in (self.pieces, self.spaced):
            if len(known) > REMEMBERED:
                known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; it is a file of the Python environment, of about a megabyte."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder a Python worker."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(data), pattern)
    return _ENCODERS[key]


def encode_documents(spark: SparkSession, df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
                     carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``ids`` (little-endian unsigned 32-bit, as binary) and ``decoded`` (their bytes).

    The text is cut by ``pattern``; each piece is encoded by the ranks on its own, without special tokens.  The pieces of a
    few million characters at a time are made distinct, sorted into buckets by length and merged as rows of a matrix;
    pieces over 1,024 bytes are merged with a heap, so that a long run of letters costs n log n.  The rank file (about a
    megabyte) is the only thing sent to the tasks.  Nothing is shuffled, and no text is cut short.

    Null and empty texts have no ids and decode to nothing.  An input column named like an output is replaced.
    ``carry`` names the input columns to return (default: all).
    """
    data = spark.sparkContext.broadcast(read_ranks(ranks_path))
    rows = packed(df, carry, _text=text_col)
    schema = rows.select("_row").schema.add("_ids", "binary").add("_decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern)
        for batch in batches:
            texts = batch.column("_text")
            start = 0
            while start < len(texts):
                part, chars, stop = [], 0, start
                while stop < len(texts) and (not part or chars < TEXT_AT_ONCE):
                    part.append(texts[stop].as_py() or "")
                    chars += len(part[-1])
                    stop += 1
                ids = encoder.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(start, stop - start), pa.array(ids, pa.binary()),
                     pa.array([encoder.decode(x) for x in ids], pa.binary())], names=["_row", "_ids", "_decoded"])
                start = stop

    return unpacked(rows.mapInArrow(run, schema), ids=F.col("_ids"), decoded=F.col("_decoded"))


def token_digests(encoded: DataFrame, ids: list[str], *more: Column) -> DataFrame:
    """Per row of :func:`encode_documents`: the named columns, ``n_tokens``, hashes of the ids and of the decoded bytes."""
    return encoded.select(*ids, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
