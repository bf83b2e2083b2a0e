"""BPE by a merge list as a streaming transducer: tokens leave as soon as no later byte can change them."""
from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.bpe import read_ranks
from noticeflow.llm.common import packed, unpacked

#: The pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The classes of characters of which the pattern matches runs, white space last.
RUNS = (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")
#: Characters of text taken at a time; a match that reaches this length is encoded in parts.
CHUNK = 1 << 16
#: Bytes that the transducer gathers beyond the lookahead before it merges.
BLOCK = 4096
#: Characters of a piece up to which its ids are remembered, and the bytes of one of two generations of remembered pieces.
REMEMBERED_PIECE, REMEMBERED = 128, 64 << 20
#: No pair; pairs are held as ``rank << ID_BITS | id``.
NONE, ID_BITS = 1 << 62, 24
#: The contractions of the pattern have up to this many characters: a match may change while so few follow its start.
CONTRACTION = 3


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Merges:
    """A byte-level merge list: byte ids, pairs with rank and id, bytes of each id, and the lookahead that suffices."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"}
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("only plain byte-level BPE without a normalizer is supported")
        if cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError("only the byte-level pre-tokenizer without a prefix space is supported")
        vocab, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        known = set(self.byte_ids)
        for rank, merge in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = vocab[letters_of(merge)]
            if a not in known or b not in known or made in known:
                raise ValueError(f"merge {rank} joins tokens that no earlier merge makes, or makes a token again")
            known.add(made)
            self.pairs[a, b], self.parts[made] = rank << ID_BITS | made, (a, b)
        self.added: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError("only added tokens that match as they are written are supported")
            self.added[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after which a token can't change: the furthest that an unknown future reaches back through the merges.

        Merges happen in the order of the list, since each joins what earlier ones made.  At first all bytes that are known
        are certain.  A merge of (y, z) makes y uncertain only if y ends where certainty ends and z begins there; z then has
        the token that last became uncertain on its left spine (z, its left part, the left part of that, ...).  So the reach
        is the heaviest chain of merges in list order, each weighing its y, whose next z holds the last y on its spine.
        Left of that, and from any token's end there, all continuations merge alike, so tokens that end there are final.
        """
        reach: dict[int, int] = {}
        longest = 0
        for y, z in self.pairs:  # in list order
            back, spine = 0, z
            while True:
                back = max(back, reach.get(spine, 0))
                if spine not in self.parts:
                    break
                spine = self.parts[spine][0]
            here = len(self.bytes_of[y]) + back
            reach[y] = max(reach.get(y, 0), here)
            longest = max(longest, here)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data``: always the leftmost pair of least rank first."""
        ids = [self.byte_ids[b] for b in data]
        return self._merge_short(ids) if len(ids) <= 32 else self._merge_heap(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [best & (1 << ID_BITS) - 1]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            pair, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = pair & (1 << ID_BITS) - 1, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := get((ids[left], ids[right]))):
                    heapq.heappush(heap, (p, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


def letters_of(merge: str | list[str]) -> str:
    return merge.replace(" ", "") if isinstance(merge, str) else "".join(merge)


class Transducer:
    """Ids of one piece whose bytes arrive in parts.

    It holds at most ``BLOCK`` bytes, the lookahead and the part that arrives: what ends before the lookahead is final, leaves,
    and the rest is merged again from the end of the last token that left, which no merge crosses.
    """

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        if len(self.held) < self.block + self.merges.lookahead:
            return []
        out, end, sure = [], 0, len(self.held) - self.merges.lookahead
        for token in self.merges.merge(self.held):
            stop = end + len(self.merges.bytes_of[token])
            if stop > sure:
                break
            out.append(token)
            end = stop
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class Cutter:
    """Matches of the pattern in a text that arrives in chunks.

    A match is final when a later one follows and three characters stand after its start; the rest waits.  A last match of
    ``chunk`` characters or more is one run, which is handed on in parts while it lasts; of white space the last character
    waits, since it belongs to what follows.
    """
    pattern = regex.compile(PATTERN)
    runs = [regex.compile(r) for r in RUNS]

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.held, self.run = chunk, "", None

    def feed(self, text: str, last: bool = False) -> Iterator[tuple[list[str], str | None, bool]]:
        """(whole matches, None, False), or ([], part of a long match, whether it ends with that)."""
        text = self.held + text
        self.held = ""
        if self.run is not None:
            stop = self.run.match(text).end()
            open_ = stop == len(text) and not last
            keep = int(self.run is self.runs[-1] and (open_ or stop < len(text)))
            yield [], text[:stop - keep], not open_
            text = text[stop - keep:]
            if open_:
                self.held = text
                return
            self.run = None
        found, waits = self.pattern.findall(text), 0
        while found and not last and (not waits or len(text) - waits - len(found[-1]) > len(text) - CONTRACTION):
            waits += len(found.pop())
        if found:
            yield found, None, False
        self.held = text[len(text) - waits:]
        if waits >= self.chunk:
            self.run = next(r for r in self.runs if r.match(self.held[-1]).end())
            keep = int(self.run is self.runs[-1])
            yield [], self.held[:waits - keep], False
            self.held = self.held[waits - keep:]


class Encoder:
    """Texts in chunks to little-endian 32-bit ids; ids of short pieces are remembered, in two generations of bounded size."""

    def __init__(self, merges: Merges, chunk: int = CHUNK, block: int = BLOCK):
        self.merges, self.chunk, self.block = merges, chunk, block
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.added = regex.compile("|".join(map(regex.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None
        self.longest = max(map(len, merges.added), default=1)

    def _whole(self, pieces: list[str]) -> bytes:
        long = []
        for piece in set(pieces).difference(self.known):
            self.known[piece] = ids = self.old.get(piece) or self._piece(piece)
            if len(piece) > REMEMBERED_PIECE:
                long.append(piece)
            else:
                self.size += len(piece) + len(ids) + 200
        out = b"".join(map(self.known.__getitem__, pieces))
        for piece in long:
            del self.known[piece]
        if self.size > REMEMBERED:
            self.old, self.known, self.size = self.known, {}, 0
        return out

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) <= self.block:
            return raw(self.merges.merge(data))
        way = Transducer(self.merges, self.block)
        parts = [raw(way.feed(data[i:i + self.block])) for i in range(0, len(data), self.block)]
        return b"".join([*parts, raw(way.finish())])

    def _cut(self, chunks: Iterable[str]) -> Iterator[tuple[str, bool, int | None]]:
        """(text, whether a segment ends with it, the added token after it or None)."""
        held = ""
        for chunk in chunks:
            held += chunk
            if self.added is None:
                yield held, False, None
                held = ""
                continue
            at = 0
            for m in self.added.finditer(held):
                if m.start() + self.longest > len(held) and len(m[0]) < self.longest:
                    break  # a longer one may yet come of it
                yield held[at:m.start()], True, self.merges.added[m[0]]
                at = m.end()
            stop = next((i for i in range(max(at, len(held) - self.longest + 1), len(held))
                         if any(t.startswith(held[i:]) for t in self.merges.added)), len(held))
            yield held[at:stop], False, None
            held = held[stop:]
        if self.added is not None:
            at = 0
            for m in self.added.finditer(held):
                yield held[at:m.start()], True, self.merges.added[m[0]]
                at = m.end()
            held = held[at:]
        yield held, True, None

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Ids in parts as they become final."""
        cutter, way = Cutter(self.chunk), Transducer(self.merges, self.block)
        for text, ends, token in self._cut(chunks):
            for whole, part, stops in cutter.feed(text, ends):
                if part is None:
                    yield self._whole(whole)
                    continue
                data = part.encode()
                for i in range(0, len(data), self.block):
                    yield raw(way.feed(data[i:i + self.block]))
                if stops:
                    yield raw(way.finish())
            if token is not None:
                yield raw([token])

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(text[i:i + self.chunk] for i in range(0, len(text), self.chunk)))


def raw(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Decoder:
    """Ids in parts to text: an unfinished character waits for its next byte, what can't become one is replaced."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.text.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        return self.text.decode(b"", True)


def decode(merges: Merges, ids: bytes, at_once: int = 4 * CHUNK) -> str:
    machine = Decoder(merges)
    return "".join([*(machine.feed(ids[i:i + at_once]) for i in range(0, len(ids), at_once)), machine.finish()])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder a Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Merges(data))
    return _ENCODERS[key]


def stream_documents(spark: SparkSession, df: DataFrame, path: str, text_col: str = "text",
                     carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``ids`` (little-endian unsigned 32-bit, as binary) and ``decoded`` (the text of these ids).

    ``path`` names a tokenizer file with a byte-level merge list (about a megabyte, the only thing sent to the tasks).  A text
    goes through in chunks: added tokens are matched first, then the pattern's pieces; each is merged by the list's order and
    its ids leave as soon as they are final (:meth:`Merges._lookahead`), so a piece of any length takes constant memory
    beside the row itself.  Nothing is shuffled and no text is cut short.

    Null and empty texts have no ids and decode to the empty text.  An input column named like an output is replaced.
    ``carry`` names the input columns to return (default: all).
    """
    data = spark.sparkContext.broadcast(read_ranks(path))
    rows = packed(df, carry, _text=text_col)
    schema = rows.select("_row").schema.add("_ids", "binary").add("_decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value)
        for batch in batches:
            texts, start = batch.column("_text"), 0
            while start < len(batch):
                ids, back, chars = [], [], 0
                while start + len(ids) < len(batch) and chars < 32 * CHUNK:
                    text = texts[start + len(ids)].as_py() or ""
                    ids.append(encoder.encode(text))
                    back.append(decode(encoder.merges, ids[-1]))
                    chars += len(text)
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(start, len(ids)), pa.array(ids, pa.binary()),
                                                  pa.array(back, pa.string())], names=["_row", "_ids", "_decoded"])
                start += len(ids)

    return unpacked(rows.mapInArrow(run, schema), ids=F.col("_ids"), decoded=F.col("_decoded"))
