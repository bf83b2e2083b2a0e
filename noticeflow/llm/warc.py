"""WARC archives: writing with revisit records, reading, and an ordered index merged from locally sorted runs."""
from __future__ import annotations

import bisect
import gzip
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import join_split, stored
from noticeflow.plans.durable import shared_folder

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 100
#: Records of one archive file; a reader holds one file at a time.
RECORDS = 500
#: Captures of one sorted run, of one piece of a run, and of one range of the merged index.
RUN, PIECE, RANGE = 4096, 256, 20_000

RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.LongType()), ("url", T.StringType()), ("date", T.StringType()), ("record_type", T.StringType()),
    ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()),
    ("payload", T.BinaryType()), ("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()),
    ("intact", T.BooleanType()))])


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``_id``, ``_url``, ``_html`` with digest, size, record type and, for a revisit, the page that it refers to.

    Of pages with equal payloads of at least ``least_bytes`` the smallest id is a response and the others revisit it.
    """
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"))
    base = base.withColumn("_digest", F.sha2("_html", 256)).withColumn("_size", F.octet_length("_html").cast("long"))
    first = base.filter(F.col("_size") >= least_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"))
    return (join_split(base, first, "_digest", "left")
            .withColumn("_refers", F.when(F.col("_first") < F.col("_id"), F.col("_first")))
            .withColumn("_type", F.when(F.col("_refers").isNull(), "response").otherwise("revisit")).drop("_first"))


def record_text(start_date: str) -> Column:
    """One record as text, without the line end that closes it (the text sink adds it).

    The date of a capture is ``start_date`` plus as many seconds as its id, since the table has none.  Control characters
    in a URL are written as %XX so that they cannot end a header line.
    """
    payload = F.when(F.col("_type") == "response", F.col("_html")).otherwise("")
    seconds = F.coalesce(F.col("_id"), F.lit(0))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start_date).cast("timestamp")) + seconds),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.col("_url")
    for c in ("\r", "\n"):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "_type"),
                       F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.lit(">")),
                       F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Target-URI: "), url),
                       F.concat(F.lit("WARC-Payload-Digest: sha256:"), "_digest"),
                       F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("_refers").cast("string"), F.lit(">")),
                       F.when(F.col("_type") == "revisit", F.lit(
                           "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                       F.concat(F.lit("X-Payload-Length: "), F.col("_size").cast("string")),
                       F.lit("Content-Type: text/html; charset=utf-8"),
                       F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), payload, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str | None = None, start_date: str = "2024-01-01", **columns) -> str:
    """Write one record per page and return the folder (a new one in the shared folder by default).

    Spark's text sink writes the files, so that a lost task is done again and nothing is kept twice, on any file system that
    Spark knows.  A file holds at most ``RECORDS`` records and is a WARC 1.1 file, compressed as a whole.
    """
    path = path or shared_folder(pages.sparkSession)
    (with_record_types(pages, **columns).select(record_text(start_date).alias("value"))
     .write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path))
    return path


def parse_records(data: bytes, file: str, payloads: bool = True) -> Iterator[tuple]:
    """Records of one archive file by their declared lengths; the payload is checked, and handed on if wanted."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        payload = data[end + 4:end + 4 + size]
        stop = end + 4 + size + 4
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        page, refers = (head.get(k, "<urn:page:null>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        kind = head["WARC-Type"]
        yield (None if page == "null" else int(page), head.get("WARC-Target-URI"), head["WARC-Date"], kind,
               int(head["X-Payload-Length"]), digest, None if refers == "null" else int(refers),
               payload if payloads else None, file, at,
               stop - at, kind == "revisit" or (len(payload) == int(head["X-Payload-Length"])
                                                and hashlib.sha256(payload).hexdigest() == digest))
        at = stop


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record below ``path`` with its file, offset and length (both before compression); ``intact`` compares a response with its digest.

    One archive file is read into a task at a time; it is bounded by its number of records.  Without ``payloads`` they are
    checked against their digests but not handed on, which an index does not need.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows = list(parse_records(gzip.decompress(content.as_py()), file.as_py(), payloads))
                for i in range(0, len(rows), 100):
                    yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in rows[i:i + 100]] for k, f in enumerate(RECORD.fields)},
                                                     schema=pa.schema([(f.name, t) for f, t in zip(RECORD.fields, ARROW)]))

    return files.mapInArrow(run, RECORD)


ARROW = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(),
         pa.int64(), pa.int64(), pa.bool_()]


def url_key(url: str | None) -> str:
    """Key that sorts the pages of a host together: reversed host, port, path and query; a null URL has an empty key."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.strip().lower()
    return f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


class LoserTree:
    """Merge of sorted iterators: each inner node holds the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        self.n = len(self.runs)
        self.losers = [-1] * max(1, self.n)
        for i in range(self.n):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` wins against run ``b``; an ended run loses, equal heads go by the run's number."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, at: int) -> None:
        """Send run ``at`` up from its leaf; an empty node keeps the first run that comes."""
        node = (at + self.n) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = at
                return
            if self._before(held, at):
                self.losers[node], at = at, held
            node //= 2
        self.losers[0] = at

    def __iter__(self) -> Iterator[tuple]:
        if not self.n:
            return
        while (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


#: A capture in the index, in the order that it is sorted by.
CAPTURE = T.StructType([T.StructField(n, t) for n, t in (
    ("url_key", T.StringType()), ("date", T.StringType()), ("page_id", T.LongType()), ("file", T.StringType()),
    ("offset", T.LongType()), ("length", T.LongType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()),
    ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("intact", T.BooleanType()))])
CAPTURE_ARROW = pa.schema([(f.name, t) for f, t in zip(CAPTURE.fields, (
    pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
    pa.int64(), pa.bool_()))])
NAMES = [f.name for f in CAPTURE.fields]


def _tuples(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(n).to_pylist() for n in NAMES)))


def _order(capture: tuple) -> tuple:
    """Key, date, page (null first), and the place in the archives, which no other capture has."""
    return capture[0], capture[1], -1 if capture[2] is None else capture[2], capture[3], capture[4]


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([keys, *(batch.column(n) for n in NAMES[1:])], schema=CAPTURE_ARROW)


PIECES = "range int, run string, piece int, captures array<struct<" + ", ".join(
    f"{f.name}: {f.dataType.simpleString()}" for f in CAPTURE.fields) + ">>"
PIECES_ARROW = pa.schema([("range", pa.int32()), ("run", pa.string()), ("piece", pa.int32()),
                          ("captures", pa.list_(pa.struct(list(CAPTURE_ARROW))))])


def _pieces(captures: list[tuple], bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One run: sorted here, cut at the bounds of the ranges and into pieces."""
    captures.sort(key=_order)
    run = hashlib.md5(repr(_order(captures[0])).encode()).hexdigest()
    orders = [_order(c) for c in captures]
    cuts = [bisect.bisect_left(orders, b) for b in bounds]
    out = []
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(captures)])):
        for p, i in enumerate(range(a, b, PIECE)):
            out.append((k, run, p, [dict(zip(NAMES, c)) for c in captures[i:min(b, i + PIECE)]]))
    yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(PIECES_ARROW.names)}, schema=PIECES_ARROW)


def _merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each range; the partition is sorted by range, run and piece."""
    def merged(k: int, runs: dict[str, list[list[dict]]]) -> Iterator[pa.RecordBatch]:
        def stream(pieces: list[list[dict]]) -> Iterator[tuple]:
            for piece in pieces:
                for c in piece:
                    values = tuple(c[n] for n in NAMES)
                    yield _order(values), values
        place, held = 0, []
        for _, values in LoserTree([stream(p) for p in runs.values()]):
            held.append((k, place, *values))
            place += 1
            if len(held) == 1000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([("range", pa.int32()), ("place", pa.int64()), *CAPTURE_ARROW])
        return pa.RecordBatch.from_pydict({n: [h[i] for h in held] for i, n in enumerate(schema.names)}, schema=schema)

    now, runs = None, {}
    for b in rows:
        for k, run, captures in zip(b.column("range").to_pylist(), b.column("run").to_pylist(), b.column("captures").to_pylist()):
            if k != now and runs:
                yield from merged(now, runs)
                runs = {}
            now = k
            runs.setdefault(run, []).append(captures)
    if runs:
        yield from merged(now, runs)


def capture_index(records: DataFrame, most_ranges: int = 10_000, samples: int = 10) -> DataFrame:
    """The captures of :func:`read_archives` in one order by URL key and date, with ``position`` from 0.

    Each task sorts what it reads into runs of at most ``RUN`` captures and cuts them at the bounds of about ``RANGE``
    captures; a range is then merged from its runs by a loser tree.  The bounds are full sort keys from a sample by hash (at
    most ``samples * most_ranges`` keys on the driver), so that one URL with very many captures spreads over ranges.  The
    place of a range in the whole follows from one count a range.
    """
    spark = records.sparkSession
    captures = stored(records.select(F.col("url"), *NAMES[1:]).mapInArrow(_with_keys, CAPTURE))
    ranges = max(1, min(most_ranges, -(-captures.count() // RANGE)))
    keys = sorted(_order(tuple(r)) for r in captures.select(*NAMES[:5]).orderBy(F.xxhash64("file", "offset"))
                  .limit(samples * ranges).collect()) if ranges > 1 else []
    bounds = spark.sparkContext.broadcast(keys[samples::samples][:ranges - 1])

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += _tuples(batch)
            while len(held) >= RUN:
                yield from _pieces(held[:RUN], bounds.value)
                held = held[RUN:]
        if held:
            yield from _pieces(held, bounds.value)

    merged = stored(captures.mapInArrow(sort_runs, PIECES).repartition("range").sortWithinPartitions("range", "run", "piece")
                    .mapInArrow(_merge, T.StructType([T.StructField("range", T.IntegerType()), T.StructField("place", T.LongType()),
                                                      *CAPTURE.fields])))
    sizes = merged.groupBy("range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (merged.join(F.broadcast(starts), "range")
            .select((F.col("_start") + F.col("place")).alias("position"), *NAMES))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages as WARC files, read them back and return the ordered index of their captures.

    One row a page.  A null text is an empty payload; a null URL has no target line and an empty key; a null id is written as
    such and never refers to another page.  Rows that repeat an id are records of their own, and both responses, since only
    a smaller id is referred to.  Other columns of the input are not read.
    """
    return capture_index(read_archives(pages.sparkSession, write_archives(pages, path, **options), payloads=False))
