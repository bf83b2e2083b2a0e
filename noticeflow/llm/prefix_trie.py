"""Prefix trie of conversations: subtree totals by time-forward processing within shards, then across shard roots."""
from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.chat import numbered
from noticeflow.llm.common import stored

#: A subtree of up to so many nodes stays in one shard; depths are cut into bands of so many levels above such subtrees.
SHARD, BAND = 65_536, 1024
#: Messages that a queue holds before it writes a sorted run, and messages of a run that are read at a time.
IN_MEMORY, READ = 500_000, 4096
#: Conversations of one piece of a list of ends.
ENDS = 4096
KEY = ["depth", "xa", "xb"]


class SpillingQueue:
    """Priority queue of messages of six longs, least first: a heap, and sorted runs in unnamed scratch files of the task.

    Nothing but the task reads the files, and a task that is run again writes its own.
    """
    record = struct.Struct("<6q")

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory = in_memory
        self.heap: list[tuple[int, ...]] = []
        self.heads: list[tuple[tuple[int, ...], int]] = []
        self.runs: list[Iterator[tuple[int, ...]]] = []

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.in_memory:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for i in range(0, len(part := sorted(self.heap)), READ):
            file.write(b"".join(self.record.pack(*m) for m in part[i:i + READ]))
        file.seek(0)
        self.heap = []
        self.runs.append(self._read(file))
        self._next(len(self.runs) - 1)

    def _read(self, file) -> Iterator[tuple[int, ...]]:
        with file:
            while block := file.read(READ * self.record.size):
                yield from self.record.iter_unpack(block)

    def _next(self, run: int) -> None:
        if message := next(self.runs[run], None):
            heapq.heappush(self.heads, (message, run))

    def take(self, key: tuple[int, int, int]) -> Iterator[tuple[int, ...]]:
        """The messages to ``key``, which is the least that any message has."""
        while self.heap and self.heap[0][:3] == key:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:3] == key:
            message, run = heapq.heappop(self.heads)
            yield message
            self._next(run)


def time_forward(nodes: DataFrame, shard: list[str], in_memory: int = IN_MEMORY) -> DataFrame:
    """``nodes`` with ``children``, ``leaves`` and ``saved`` summed over the subtrees within their shards.

    Spark deals the nodes out by ``shard`` and sorts each partition, on disk if need be, by falling depth.  So all children
    of a node come before it: each sends its totals to its parent through the queue, in which the least message is always for
    the next node.  A ``top`` node has no parent in its shard and sends nothing.
    """
    ready = nodes.repartition(*shard).sortWithinPartitions(F.col("depth").desc(), "xa", "xb")
    names = ["depth", "xa", "xb", "pa", "pb", "top", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(in_memory)
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for depth, xa, xb, pa_, pb, top, children, leaves, saved in zip(*(batch.column(n).to_pylist() for n in names)):
                for message in queue.take((-depth, xa, xb)):
                    children, leaves, saved = children + message[3], leaves + message[4], saved + message[5]
                if not top:
                    queue.push((1 - depth, pa_, pb, 1, leaves, saved))
                for column, value in zip(out, (children, leaves, saved)):
                    column.append(value)
            new = dict(zip(names[6:], (pa.array(x, pa.int64()) for x in out)))
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    return ready.mapInArrow(run, ready.schema)


def by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join with a table that has one row a key, where one key may hold a third of the left rows.

    A second key, derived from the first, makes Spark deal out both sides afresh, so that it can split a hot partition.
    """
    part = F.pmod(F.hash(*keys), F.lit(1 << 16)).alias("_part")
    return left.select("*", part).join(right.select("*", part), [*keys, "_part"], how).drop("_part")


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(``conv``, ``i``, ``a``, ``b``, ``bytes``): each turn's place from 1, a 128-bit hash of role and text, and the text's size.

    Turns are ordered by number, null first, then by role and text; repeated rows are turns of their own.  Null roles and texts
    are empty.  Rows without a conversation are in none and left out.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    turns = df.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").isNotNull().alias("_known"),
        F.col(f"`{turn_col}`").alias("_turn"), text(role_col).alias("_role"), text(text_col).alias("_text"))
    places = numbered(turns, "conv", ["_known", "_turn", "_role", "_text"])
    return stored(places.select("conv", (F.col("_at") + 1).alias("i"), F.xxhash64(F.lit(1), "_role", F.lit(2), "_text").alias("a"),
                                F.xxhash64("_text", F.lit(3), "_role").alias("b"), F.octet_length("_text").cast("long").alias("bytes")))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings, from :func:`ordered_turns`: their turns (``i`` is the place) and their ``length``.

    Conversation c starts with the first h turns of conversation c - c % ``group`` (none if there is no such one), h being the
    CRC-32 of its decimal id modulo ``most``; its own turns after its first h follow.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    own = stored(own)
    convs = (own.join(own.select(F.col("conv").alias("base"), F.col("n").alias("_nb")), "base", "left")
             .withColumn("m", F.least("h", F.coalesce("_nb", F.lit(0))))
             .select("conv", "base", "h", "m", F.expr("m + greatest(n - h, 0)").alias("length")))
    convs = stored(convs)
    opening = turns.filter((F.col("conv") % group == 0) & (F.col("i") < most)).withColumnRenamed("conv", "base")
    heads = opening.join(convs, "base").filter("i <= h").select("conv", "i", "a", "b", "bytes")
    tails = by_key(turns, convs, ["conv"], "inner").filter("i > h").select("conv", (F.col("i") - F.col("h") + F.col("m")).alias("i"), "a", "b", "bytes")
    return heads.unionByName(tails), convs.select("conv", "length")


def prefixes(turns: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """For each turn its prefix: ``depth``, key (``xa``, ``xb``), parent's key (``pa``, ``pb``) and the key at its band's top.

    The key of a prefix is the exclusive or of 128-bit hashes of its turns, each with its place, so a long conversation is added
    up band by band, and only one row a band is lined up over the whole of it.
    """
    rows = by_key(turns, lengths, ["conv"], "inner").select(
        "conv", F.col("i").alias("depth"), F.expr(f"(i - 1) div {band}").alias("band"), F.xxhash64("a", "b", "i").alias("ha"),
        F.xxhash64("i", "b", "a").alias("hb"), "bytes", "length")
    rows = stored(rows)
    sums = rows.groupBy("conv", "band").agg(F.expr("bit_xor(ha)").alias("sa"), F.expr("bit_xor(hb)").alias("sb"))
    above = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.select("conv", "band", F.coalesce(F.expr("bit_xor(sa)").over(above), F.lit(0)).alias("ka"),
                       F.coalesce(F.expr("bit_xor(sb)").over(above), F.lit(0)).alias("kb"))
    inside = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.select("*", F.expr("bit_xor(ha)").over(inside).alias("_a"), F.expr("bit_xor(hb)").over(inside).alias("_b"))
    keyed = here.join(tops, ["conv", "band"]).selectExpr("*", "_a ^ ka AS xa", "_b ^ kb AS xb")
    return stored(keyed.selectExpr("conv", "depth", "band", "xa", "xb", "xa ^ ha AS pa", "xb ^ hb AS pb", "ka", "kb", "bytes", "length"))


def _ends(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """Of each prefix at which conversations end, ``ends``: the hash of their ids, ascending and joined by commas.

    Ranges of prefix and id make pieces of lists first, so a prefix at which very many end is spread over tasks; its pieces are
    then hashed as they pass, in order.
    """
    own = paths.filter("depth = length").select(*KEY, "conv")
    none = lengths.filter("length = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv")
    ranged = own.unionByName(none).repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids: list[str] = []
            for depth, xa, xb, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if not out or out[-1][:3] != (depth, xa, xb) or len(ids) == ENDS:
                    if ids:
                        out[-1] += (",".join(ids),)
                    ids = []
                    out.append((depth, xa, xb, conv))
                ids.append(str(conv))
            if out:
                out[-1] += (",".join(ids),)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for depth, xa, xb, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == (depth, xa, xb):
                    state.update(f",{ids}".encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, xa, xb), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*KEY, "ends"])

    lists = ranged.mapInArrow(pieces, "depth long, xa long, xb long, first long, ids string")
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, xa long, xb long, ends string")


def _sent(nodes: DataFrame, depth: str, xa: str, xb: str, children: str) -> DataFrame:
    """What nodes send to parents in other shards, added up by parent."""
    return (nodes.selectExpr(f"{depth} AS depth", f"{xa} AS xa", f"{xb} AS xb", f"{children} AS c", "leaves", "saved")
            .groupBy(*KEY).agg(F.sum("c").alias("_c"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s")))


def _received(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    """``nodes`` with what was sent to them added to their own values."""
    added = {own: f"{own} + coalesce({more}, 0)" for own, more in (("children", "_c"), ("leaves", "_l"), ("saved", "_s"))}
    return by_key(nodes, sent, KEY).selectExpr(*[f"{added[c]} AS {c}" if c in added else c for c in nodes.columns])


def trie(turns: DataFrame, lengths: DataFrame, shard: int = SHARD, band: int = BAND, in_memory: int = IN_MEMORY) -> DataFrame:
    """One row for each distinct opening of the conversations; see :func:`prefix_trie`.

    A prefix with at most ``shard`` turns at and below it is light.  The shallowest light prefixes are the roots of shards: whole
    subtrees, of which a task takes many.  What is above them is cut into bands of ``band`` levels, and the nodes of one band
    below one node are a shard as well.  First the light shards are processed and their roots' totals sent up; then the bands, by
    themselves; then the bands' totals pass up the tree of bands; then the bands again with what they got from below.
    """
    paths = prefixes(turns, lengths, band)
    nodes = stored(paths.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("ka").alias("ka"),
        F.max("kb").alias("kb"), F.max("band").alias("band"), F.max("bytes").alias("bytes"),
        F.sum(F.expr("if(length = depth, 1, 0)")).alias("ended"), F.sum(F.expr("length - depth + 1")).alias("weight")))
    heavy_paths = by_key(paths.select("conv", *KEY), nodes.filter(F.col("weight") > shard).select(*KEY), KEY, "left_semi")
    deepest = heavy_paths.groupBy("conv").agg(F.max("depth").alias("above"))
    roots = (by_key(paths.select("conv", *KEY), deepest, ["conv"]).filter("depth = coalesce(above, 0) + 1")
             .selectExpr("conv", "depth AS first", "xa AS ra", "xb AS rb"))
    placed = by_key(nodes, roots, ["conv"]).selectExpr(
        *KEY, "pa", "pb", "ka", "kb", "band", "conv", "n", "ra", "rb", "coalesce(depth >= first, false) AS light", "coalesce(depth = first, false) AS top",
        "0L AS children", "if(n = ended, 1L, 0L) AS leaves", "(n - 1) * bytes AS saved")
    placed = stored(placed)
    light = stored(time_forward(placed.filter("light"), ["ra", "rb"], in_memory))
    up = stored(_sent(light.filter("top"), "depth - 1", "pa", "pb", "1L"))
    heavy = stored(_received(placed.filter("NOT light").withColumn("top", F.expr(f"(depth - 1) % {band} = 0")), up))
    alone = time_forward(heavy, ["band", "ka", "kb"], in_memory)
    bands = (alone.filter("top").groupBy("band", "ka", "kb")
             .agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    bands = stored(bands)
    # A band hangs on a node of the band above, or on the root; the tree of bands has a row for each.
    hangs = bands.join(heavy.selectExpr("depth AS _d", "xa AS ka", "xb AS kb", "ka AS pa", "kb AS pb").withColumn("band", F.expr(f"_d div {band}"))
                       .filter(f"_d % {band} = 0").drop("_d"), ["band", "ka", "kb"], "left")
    tree = hangs.selectExpr("band + 1 AS depth", "ka AS xa", "kb AS xb", "pa", "pb", "band = 0 AS top", "0L AS children", "leaves", "saved", "children AS n")
    across = stored(time_forward(tree.withColumn("one", F.lit(0)), ["one"], in_memory))
    down = stored(_sent(across, f"(depth - 1) * {band}", "xa", "xb", "n"))
    final = time_forward(_received(heavy, down), ["band", "ka", "kb"], in_memory)
    rows = lengths.selectExpr("conv", "1L AS n", "0L AS _c", "0L AS _l", "0L AS _s")
    for top in (up, down):
        rows = rows.unionByName(top.filter("depth = 0").selectExpr("CAST(NULL AS long) AS conv", "0L AS n", "_c", "_l", "_s"))
    root = rows.agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "_c", "_l", "_s")]).filter("n > 0").selectExpr(
        "0L AS depth", "0L AS xa", "0L AS xb", "-1L AS pd", "0L AS pa", "0L AS pb", "conv", "n", "_c AS children",
        "if(_c = 0, 1L, _l) AS leaves", "_s AS saved")
    whole = stored(light.unionByName(final).selectExpr(*KEY, "depth - 1 AS pd", "pa", "pb", "conv", "n", "children", "leaves", "saved").unionByName(root))
    parents = whole.selectExpr("depth AS pd", "xa AS pa", "xb AS pb", "conv AS parent")
    named = by_key(by_key(whole, parents, ["pd", "pa", "pb"]), _ends(paths, lengths), KEY)
    return named.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                shared: bool = False) -> DataFrame:
    """The trie of all distinct openings of the conversations in ``df``, one row a node, from the root without turns.

    (``conv_id``, the smallest member; ``depth``; ``parent_conv_id``; ``n_convs``, members; ``n_children``; ``n_leaves`` of the
    subtree; ``saved_tokens``, bytes that members after the first need not bring again, over the subtree; ``ends_sha256``, hash of
    the ids, ascending and joined by commas, of the conversations that end at the node).  Members of a node are the conversations
    that start with its turns.  With ``shared`` the conversations are rebuilt by :func:`rebuilt` first.

    Turns are ordered by number, null first, then by role and text; null roles and texts are empty, repeated rows are turns of
    their own, rows without a conversation are left out.  An empty table has no nodes.  Other columns are not read.  Openings are
    told apart by 128-bit hashes.
    """
    turns = ordered_turns(df, conv_col, turn_col, role_col, text_col)
    if shared:
        return trie(*rebuilt(turns))
    return trie(turns, turns.groupBy("conv").agg(F.count("*").alias("length")))
