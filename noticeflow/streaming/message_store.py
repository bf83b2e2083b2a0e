"""A message store as a streaming source whose offset is the message key.

``spark.dataSource.register(MessageStore)`` makes the format ``message_store``.  A query starts at the largest key present (or at the
first message), takes a bounded number of rows at each poll in the order of their keys, and keeps its place in the checkpoint: a
restart goes on after the last key, and a batch that was under way is read again with the same rows.  Where many polls are behind, a
micro-batch may take several of them; each row then tells the number of its poll.
"""
from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

KEY, DELETED, POLL = "MessageKey", "DeletedDate", "Poll"
#: Rows of a row group that are looked at together.
BATCH = 65_536


class Groups(InputPartition):
    """Some row groups of one file, and the keys wanted: after ``start`` up to ``end``; the last keys of polls and how many were before."""

    def __init__(self, path: str, groups: list[int], start: int | None, end: int, before: int = 0, ends: Sequence[int] = ()):
        self.path, self.groups, self.start, self.end, self.before, self.ends = path, groups, start, end, before, ends


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:/"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _between(keys: pa.ChunkedArray | pa.Array, start: int | None, end: int | None):
    """Which keys are wanted; null keys never are."""
    wanted = pc.is_valid(keys)
    if start is not None:
        wanted = pc.and_(wanted, pc.greater(keys, start))
    if end is not None:
        wanted = pc.and_(wanted, pc.less_equal(keys, end))
    return pc.fill_null(wanted, False)


class StoreReader(DataSourceStreamReader):
    """Offsets ``{"key": k}``: all messages up to key k are done; a null key stands for none yet.

    A poll opens the footers of new files only.  Row groups are visited in the order of their least keys and only their key column
    is read, until no further group can hold one of the next ``rows`` keys; so a poll costs what it admits, not what is stored.

    A batch takes up to ``polls`` polls.  With more than one, offsets also hold the number of the last poll and the last key of each poll of
    the batch, so that a batch that is read again has the same polls, and the column ``Poll`` of the schema, if there is one, tells them.
    """

    def __init__(self, path: str, rows: int, skip_existing: bool, schema: StructType, polls: int = 1):
        self.path, self.rows, self.skip_existing, self.schema, self.polls = path, rows, skip_existing, schema, polls
        self.at: dict | None = None
        self.footers: dict[str, list[tuple[int, int | None, int | None]]] = {}

    def _groups(self) -> list[tuple[int | None, int | None, str, int]]:
        """(least key, largest key, file, row group) of the whole store; null where the file does not tell."""
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in found:
            name = info.path[len(root):]
            if info.is_file and name.endswith(".parquet") and info.path not in self.footers and not any(
                    part[:1] in "_." for part in name.strip("/").split("/")):
                self.footers[info.path] = self._footer(fs, info.path)
        return [(low, high, file, group) for file, groups in self.footers.items() for group, low, high in groups]

    def _footer(self, fs: pafs.FileSystem, file: str) -> list[tuple[int, int | None, int | None]]:
        with fs.open_input_file(file) as f:
            meta = pq.ParquetFile(f).metadata
        out = []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = next((c.statistics for c in map(group.column, range(group.num_columns)) if c.path_in_schema == KEY), None)
            known = stats is not None and stats.has_min_max
            out.append((g, stats.min if known else None, stats.max if known else None))
        return out

    def _keys(self, file: str, group: int, start: int | None) -> Iterator[list[int]]:
        """Keys after ``start`` of messages that are not deleted, some at a time."""
        fs, _ = _open(self.path)
        with fs.open_input_file(file) as f:
            table = pq.ParquetFile(f)
            columns = [c for c in (KEY, DELETED) if c in table.schema_arrow.names]
            for batch in table.iter_batches(BATCH, [group], columns):
                wanted = _between(batch.column(KEY), start, None)
                if DELETED in columns:
                    wanted = pc.and_(wanted, pc.is_null(batch.column(DELETED)))
                yield batch.column(KEY).filter(wanted).to_pylist()

    def initialOffset(self) -> dict:
        if self.at is None:
            top = None
            if self.skip_existing:
                for low, high, file, group in self._groups():
                    keys = [high] if high is not None else [k for part in self._keys(file, group, None) for k in part]
                    top = max([*keys, *([] if top is None else [top])], default=None)
            self.at = {"key": top if top is not None else 0 if self.skip_existing else None}
        return self.at

    def latestOffset(self) -> dict:
        """The key of the last of the next messages, ``rows`` a poll; deleted ones take no place and are passed over."""
        at, wanted = self.initialOffset(), self.rows * self.polls
        start = at["key"]
        groups = sorted(((low, high, file, g) for low, high, file, g in self._groups() if start is None or high is None or high > start),
                        key=lambda x: (x[0] is not None, x[0] or 0))
        least: list[int] = []    # the smallest keys so far, negated: the largest of them on top
        for low, _, file, group in groups:
            if low is not None and len(least) == wanted and low > -least[0]:
                break
            for keys in self._keys(file, group, start):
                for key in keys:
                    if len(least) < wanted:
                        heapq.heappush(least, -key)
                    elif key < -least[0]:
                        heapq.heapreplace(least, -key)
        if not least:
            return at
        if self.polls == 1:
            return {"key": -least[0]}
        found = sorted(-k for k in least)
        ends, done = [], 0
        while done < len(found) and (len(found) < wanted or len(found) - done >= self.rows):    # else more may follow in a short poll
            ends.append(found[min(done + self.rows, len(found)) - 1])
            done = bisect_right(found, ends[-1])
        return {"key": ends[-1], "poll": at.get("poll", 0) + len(ends), "ends": ends}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """One partition for each file that holds keys of the batch, with the row groups concerned."""
        self.at = end    # also after a restart, when the last batch is planned again
        files: dict[str, list[int]] = {}
        for low, high, file, group in self._groups():
            after = start["key"] is None or high is None or high > start["key"]
            if end["key"] is not None and after and (low is None or low <= end["key"]):
                files.setdefault(file, []).append(group)
        ends = end.get("ends", [])
        return [Groups(file, groups, start["key"], end["key"], end.get("poll", 0) - len(ends), ends) for file, groups in files.items()]

    def commit(self, end: dict) -> None:
        if self.at is None:
            self.at = end

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = _open(self.path)
        wanted = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as f:
            table = pq.ParquetFile(f)
            there = [n for n in wanted.names if n in table.schema_arrow.names]
            for batch in table.iter_batches(BATCH, partition.groups, there):
                rows = batch.filter(_between(batch.column(KEY), partition.start, partition.end))
                polls = [partition.before + 1 + bisect_left(partition.ends, k) for k in rows.column(KEY).to_pylist()] if partition.ends else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(polls, f.type) if f.name == POLL and polls is not None else rows.column(f.name).cast(f.type) if f.name in there
                     else pa.nulls(len(rows), f.type) for f in wanted], schema=wanted)


class MessageStore(DataSource):
    """Options: ``path``, ``rows`` a poll, ``polls`` a batch at most, ``skip_existing`` (true or false).  The reader needs a schema that has
    ``MessageKey``; with several polls a batch its column ``Poll`` holds their numbers."""

    @classmethod
    def name(cls) -> str:
        return "message_store"

    def schema(self) -> StructType:
        raise ValueError("the message store needs a schema")

    def streamReader(self, schema: StructType) -> StoreReader:
        if KEY not in schema.names:
            raise ValueError(f"missing columns: ['{KEY}']")
        rows = int(self.options.get("rows", "20"))
        polls = int(self.options.get("polls", "1"))
        if rows < 1 or polls < 1:
            raise ValueError("a poll takes one row at least, a batch one poll")
        return StoreReader(self.options["path"], rows, self.options.get("skip_existing", "true").lower() == "true", schema, polls)
