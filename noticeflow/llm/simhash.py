"""SimHash near-duplicates: fingerprints, a grid over segment bit counts, exact distances, components."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import join_split, packed, stored, unpacked
from noticeflow.llm.components import components

BITS = 64
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        votes += part.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; repeats count.

    A-Z are lower-cased, words end at ASCII white space, shingles are joined by one space.  A text of fewer words is one
    shingle; a text without words has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(),
                                                             ends[shingle - 1:].tolist())], np.uint64)
    return majority(hashes)


def fingerprints(df: DataFrame, shingle: int = 3) -> DataFrame:
    """``_row``, ``_id`` and the fingerprint ``_fp`` (as a signed long) of rows with ``_text``."""
    schema = df.drop("_text").schema.add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column("_text")]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, signed], names=[*kept.schema.names, "_fp"])

    return df.mapInArrow(run, schema)


def grid_keys(blocks: int, width: int = 2) -> tuple[list[str], list[str]]:
    """SQL of the grid cells of a fingerprint ``_fp``, one a choice of ``blocks - 3`` blocks, and of the blocks' counts.

    A fingerprint becomes a vector of bit counts of ``64 / width`` segments.  The Manhattan distance of two vectors is at
    most the number of differing bits, so vectors of a linked pair differ by 3 at most.  The segments are dealt into
    ``blocks`` blocks; with 3 steps to spend, at least ``blocks - 3`` blocks have the same counts.  A cell is a choice of
    that many blocks with their counts: a linked pair shares at least one cell.
    """
    segments = BITS // width
    mask = (1 << width) - 1
    block_of = [s * blocks // segments for s in range(segments)]
    counts = [f"bit_count(shiftrightunsigned(_fp, {s * width}) & {mask})" for s in range(segments)]
    packed_counts = []
    for b in range(blocks):
        own = [counts[s] for s in range(segments) if block_of[s] == b]
        packed_counts.append(" + ".join(f"{c} * {(width + 1) ** i}L" for i, c in enumerate(own)))
    return [f"xxhash64({k}, {', '.join(f'_c[{b}]' for b in chosen)})"
            for k, chosen in enumerate(combinations(range(blocks), blocks - 3))], packed_counts


def spanning_links(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect the same values as all pairs at ``most`` or fewer differing bits would.

    A breadth-first search: each value is compared with those not reached yet, so a dense group takes few comparisons, and
    there are fewer links than values.
    """
    links = []
    rest = np.arange(len(values))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= most
            if near.any():
                found = rest[near]
                links.extend((int(at), int(i)) for i in found)
                queue.extend(found)
                rest = rest[~near]
    return links


def _cell_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links inside each cell of a partition sorted by cell; a cell may go on in the next batch."""
    def links(fps: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(cells)) + 1
        us, vs = [], []
        first, last = np.r_[0, cuts], np.r_[cuts, len(cells)]
        for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
            for i, j in spanning_links(fps[a:b], most):
                us.append(fps[a + i])
                vs.append(fps[a + j])
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)],
                                          names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        cells = batch.column("_cell").to_numpy(zero_copy_only=False)
        fps = batch.column("_fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(cells):
            continue
        start = int(np.searchsorted(cells, cells[-1]))
        if start == 0 and held and held[-1][1][-1] == cells[-1]:
            held.append((fps, cells))
            continue
        if start or held:
            yield links(np.concatenate([*(h[0] for h in held), fps[:start]]),
                        np.concatenate([*(h[1] for h in held), cells[:start]]))
        held = [(fps[start:], cells[start:])]
    if held:
        yield links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def near_links(distinct: DataFrame, most: int = 3, blocks: int = 6) -> DataFrame:
    """(``u``, ``v``) of distinct fingerprints ``_fp``: enough links at ``most`` bits to connect all that are linked."""
    if most > 3:
        raise ValueError("the grid is laid out for distances up to 3")
    keys, counts = grid_keys(blocks)
    cells = (distinct.withColumn("_c", F.expr(f"array({', '.join(counts)})"))
             .select("_fp", F.expr(f"explode(array({', '.join(keys)}))").alias("_cell")))
    shared = cells.repartition("_cell").sortWithinPartitions("_cell")
    return shared.mapInArrow(lambda batches: _cell_links(batches, most), "u long, v long").distinct()


def simhash_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, most: int = 3,
                       blocks: int = 6, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    Rows are linked when their fingerprints differ in at most ``most`` bits; ``component_id`` is the smallest id that can be
    reached over links, the row's own included.  Equal fingerprints are collapsed before the search.  The search is a range
    join on a grid of bit counts (:func:`grid_keys`); each cell verifies distances exactly and gives out a spanning forest,
    never all pairs.  The more fingerprints a table has, the more ``blocks`` pay off; the result does not depend on it.

    Null texts count as empty; texts without words have fingerprint zero and are linked like others.  Rows with equal ids
    are rows of their own; null ids are no candidates for ``component_id``, which is null if no other id can be reached.
    An input column named like an output is replaced.  ``carry`` names the input columns to return (default: the id).
    """
    rows = stored(fingerprints(packed(df, [id_col] if carry is None else carry, _id=id_col, _text=text_col), shingle))
    distinct = stored(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    found = components(near_links(distinct.select("_fp"), most, blocks))
    roots = (distinct.join(found.select(F.col("u").alias("_fp"), F.col("v").alias("_to")), "_fp", "left")
             .withColumn("_root", F.coalesce("_to", "_fp")))
    least = roots.groupBy("_root").agg(F.min("_least").alias("_component"))
    classes = join_split(roots.select("_fp", "_root"), least, "_root").select("_fp", "_component")
    return unpacked(join_split(rows, classes, "_fp"), fingerprint=F.lower(F.lpad(F.hex("_fp"), 16, "0")),
                    component_id=F.col("_component"))
