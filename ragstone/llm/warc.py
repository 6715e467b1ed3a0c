"""Operator 3: WARC archives with revisit records, and their merged capture index.

Writing.  Every page becomes one WARC/1.1 record; payloads of at least
MIN_REVISIT bytes that repeat become revisit records (profile
identical-payload-digest) that refer to the record of the smallest page_id.  What
a record becomes is decided on ids and digests alone; payloads meet the decisions
by page_id, so a payload that very many pages share isn't gathered anywhere.
The block of a record is an HTTP response; that of a revisit holds its header
lines only, whose Content-Length states the size of the full payload.

Every record is one gzip member, whose extra field (`sl`) states the sizes of the
member and of the record: any record can be fetched by offset and length.  The text
sink writes the members, about ROW_BYTES of them as a row and ROWS_PER_FILE rows to
a file, so files appear whole or not at all when executors are lost; its line end is
an empty gzip member.

Reading.  Files come back through binaryFile, one member at a time is inflated and
parsed, and every payload's SHA-256 is computed and held against the record's own.

Index.  Each reading task sorts its captures by (URL key, timestamp, page_id)
into runs of at most RUN_ROWS entries; the runs are stored in blocks of RUN_BLOCK
entries that carry their first key.  The key range is dealt out, about RANGE_ROWS
entries a task, and in each range at most about FAN runs are merged at a time, through a
loser tree: a block enters when the merge comes to its first key, so a task holds
about one block of each of FAN runs, however many there are.  More runs than FAN are
merged in rounds: what a round merges is a run of the next, stored between them.
That gives the globally ordered capture history.  The key holds the page_id, so one
very common host or URL is cut like any other range.

Edge cases: null html is an empty payload; null url gives the empty URL key and
no target line; line ends in a URL are percent-encoded; rows that repeat a
page_id get a record each, and those with the group's smallest page_id are all
responses; null page_ids are never the smallest, unless all are null (then all
are responses); captures that tie in the whole key stand in the order of their
runs; page_ids may be any long; pages have the time EPOCH, unless a column of times is
named, and where that is null or beyond the years 1 to 9999; an empty table gives no
file and no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ragstone.llm.common import shared_dir, table, written

MIN_REVISIT = 100
ROW_BYTES, ROWS_PER_FILE = 1 << 20, 16
RUN_ROWS, RUN_BLOCK = 100_000, 512
#: runs that a task merges at a time, about, and entries of its range
FAN, RANGE_ROWS = 64, 1_000_000
#: when captures without a time of their own were made, and the times a record can state
EPOCH, TIMES = 1704067200, (-62135596800, 253402300799)

CAPTURE = "urlkey string, captured long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"


def date(pages: DataFrame, time: str | None) -> Column:
    """The WARC-Date of each page: its column time (a timestamp, or seconds since 1970), in UTC
    whatever the session's time zone."""
    if time is None:
        seconds = F.lit(EPOCH).cast("long")
    else:
        own = F.col(time)
        own = own.cast("long") if isinstance(pages.schema[time].dataType, NumericType) else own.cast("timestamp").cast("long")
        seconds = F.when(own.between(*TIMES), own).otherwise(F.lit(EPOCH)).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    two = (F.lpad(F.floor(F.pmod(seconds, F.lit(86400)) / unit % 60).cast("string"), 2, "0") for unit in (60, 1))
    hour = F.lpad(F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), hour, F.lit(":"), next(two), F.lit(":"), next(two), F.lit("Z"))


def records(pages: DataFrame, time: str | None = None) -> DataFrame:
    """The record of each page as one string column, value."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), date(pages, time).alias("date"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    keys = written(rows.where(F.col("size") >= MIN_REVISIT).select("page_id", "digest"), "payload-keys")
    first = written(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "payload-first")
    again = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = written(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first"), "payload-again")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").withColumn("revisit", F.col("first").isNotNull())

    def line(name: str, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise("")

    def urn(c):
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", urn("page_id")), line("WARC-Date", F.col("date")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("first")))), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("body").cast("string")), F.lit("\r\n"))
    return rows.withColumn("body", body).select(F.concat(head, F.col("body"), F.lit("\r\n\r\n")).alias("value"))


_HEAD = struct.Struct("<4sIBBHccHII")
#: an empty gzip member, the line end of the text sink
EMPTY = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03\0\0\0\0\0\0\0\0\0"


def member(record: bytes) -> bytes:
    """A record as one gzip member that states its own size and the record's."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = _HEAD.size + len(body) + 8
    return _HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def members(content) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each member of a file, without the empty ones."""
    view, at = memoryview(content).cast("B"), 0
    while at < len(view):
        if view[at: at + len(EMPTY)] == EMPTY:
            at += len(EMPTY)
            continue
        size = _HEAD.unpack_from(view, at)[8]
        yield at, size, zlib.decompress(view[at: at + size], 31)
        at += size


def write_archives(pages: DataFrame, path: str, time: str | None = None) -> str:
    """Write page_id, url, html as WARC files under path, captured when the column time says."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for record in batch.column("value").cast(pa.binary()):
                held.append(member(record.as_py()))
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([EMPTY.join(held)], pa.binary())], ["row"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([EMPTY.join(held)], pa.binary())], ["row"])

    made = records(pages, time).mapInArrow(rows, "row binary").select(F.col("row").cast("string").alias("value"))
    sink = made.write.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "none")
    sink.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)
    return path


def parse(record: bytes) -> tuple[dict, bytes]:
    """(header fields in lower case, block) of one record."""
    end = record.index(b"\r\n\r\n") + 4
    lines = record[: end - 4].decode().split("\r\n")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(head["content-length"])
    if not lines[0].startswith("WARC/1.") or record[end + n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return head, record[end: end + n]


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the top down, a leading www
    and the fragment left out."""
    rest = (url or "").partition("#")[0]
    rest = rest.partition("://")[2] if "://" in rest else rest
    cut = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host = rest[:cut].lower()
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:] if host else ""


def _page(urn: str | None) -> int | None:
    name = (urn or "")[len("<urn:x-page:"): -1]
    return int(name) if name not in ("", "null") else None


def captures(file: str, content: bytes) -> Iterator[tuple]:
    """A CAPTURE row for each record of one archive."""
    import calendar
    import time

    for offset, length, record in members(content):
        head, block = parse(record)
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = dict(x.partition(": ")[::2] for x in http.decode().split("\r\n")[1:])
        size, kind, digest = int(stated["Content-Length"]), head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"{file}: the payload at byte {offset} isn't the one that was written")
        when = calendar.timegm(time.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ"))
        yield url_key(head.get("warc-target-uri")), when, _page(head["warc-record-id"]), kind, _page(head.get("warc-refers-to")), size, digest, file, offset, length


def order(row: tuple) -> tuple:
    """The key of the capture index; null page_ids first."""
    return row[0].encode(), row[1], -1 << 63 if row[2] is None else row[2]


class LoserTree:
    """k-way merge of sorted iterators: each inner node holds the loser of its match,
    so the next row costs one path of log2 k comparisons.  Iterators may join later, which
    costs k comparisons: little, as k stays about FAN and an iterator holds a block."""

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs, self.heads = key, [], []
        for r in runs:
            self._enter(r)
        self._build()

    def _enter(self, run: Iterator) -> None:
        self.runs.append(iter(run))
        self.heads.append(self._next(len(self.runs) - 1))

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _build(self) -> None:
        self.k = len(self.runs)
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def add(self, run: Iterator) -> None:
        """Takes one more sorted iterator; those that have ended go."""
        live = [i for i, h in enumerate(self.heads) if h is not None]
        self.runs = [self.runs[i] for i in live]
        self.heads = [(self.heads[i][0], n, self.heads[i][2]) for n, i in enumerate(live)]
        self._enter(run)
        self._build()

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come here waits for its opponent
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def least(self):
        """The least key, None at the end."""
        head = self.heads[self.losers[0]] if self.k else None
        return head and head[0]

    def pop(self):
        i = self.losers[0]
        row = self.heads[i][2]
        self.heads[i] = self._next(i)
        self._replay(i)
        return row

    def __iter__(self):
        while self.least() is not None:
            yield self.pop()


def merged_blocks(blocks: Iterator[tuple], key) -> Iterator:
    """The rows of sorted blocks (first key, rows), which come in the order of their first
    keys (no row of a block is below it), in the order of key."""
    tree, following = LoserTree([], key), next(blocks, None)
    while following is not None or tree.least() is not None:
        if following is not None and (tree.least() is None or following[0] <= tree.least()):
            tree.add(iter(following[1]))
            following = next(blocks, None)
        else:
            yield tree.pop()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema.names)


_ARROW = pa.schema([("urlkey", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_FIRST = [("first_urlkey", pa.string()), ("first_captured", pa.int64()), ("first_page", pa.int64())]
_RUN_COLUMNS = "run long, place long, first_urlkey string, first_captured long, first_page long"
_RUN = pa.schema([*_ARROW, ("run", pa.int64()), ("place", pa.int64()), *_FIRST])


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under path in locally sorted, stored runs: each with
    its run, its place in it and the key of the first capture of its block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId() << 32, []

        def stored() -> Iterator[tuple]:
            held.sort(key=order)
            for place, row in enumerate(held):
                if place % RUN_BLOCK == 0:
                    first = row[:3]
                yield *row, run, place, *first

        def made() -> Iterator[tuple]:
            nonlocal run
            for batch in batches:
                for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                    held.extend(captures(file.as_py().rpartition("/")[2], content.as_buffer()))
                    if len(held) >= RUN_ROWS:
                        yield from stored()
                        run += 1
                        held.clear()
            yield from stored()

        return _batches(made(), _RUN)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return written(files.mapInArrow(rows, f"{CAPTURE}, {_RUN_COLUMNS}"), "capture-runs")


def _blocks(rows: Iterator[tuple], width: int) -> Iterator[tuple]:
    """(first key, captures) of each block of stored runs, as they come."""
    for _, held in itertools.groupby(rows, lambda r: (r[width], r[width + 1] // RUN_BLOCK)):
        held = list(held)
        yield order(held[0][width + 2:]), [r[:width] for r in held]


def merge_round(runs: DataFrame, parts: int, last: bool) -> DataFrame:
    """The runs of each group merged: into runs again, or, if this is the last round, into
    the captures of each shard with their place (at).  Without a column shard the key
    range is dealt out first."""
    width, ranged = len(_ARROW), "shard" not in runs.columns
    runs = runs.select(*_RUN.names, "group", *([] if ranged else ["shard"]))
    out, names = (pa.schema([*_ARROW, ("shard", pa.int64()), ("at", pa.int64())]), "shard long, at long") if last else (pa.schema([*_RUN, ("shard", pa.int64())]), _RUN_COLUMNS + ", shard long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def made() -> Iterator[tuple]:
            for (group, *shard), some in itertools.groupby(rows, lambda r: r[width + 5:]):
                shard = own if ranged else shard[0]
                for place, row in enumerate(merged_blocks(_blocks(some, width), order)):
                    if last:
                        yield *row, shard, place
                        continue
                    if place % RUN_BLOCK == 0:
                        first = row[:3]
                    yield *row, group, place, *first, shard

        return _batches(made(), out)

    dealt = runs.repartitionByRange(parts, "urlkey", "captured", "page_id") if ranged else runs.repartition(parts, "shard")
    by_block = ["first_urlkey", "first_captured", F.col("first_page").asc_nulls_first(), "run", "place"]
    by_group = ["group"] if ranged else ["group", "shard"]
    return written(dealt.sortWithinPartitions(*by_group, *by_block).mapInArrow(merge, f"{CAPTURE}, {names}"), "capture-index")


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures with rank, their place (from 0) in the global order of
    (URL key, timestamp, page_id)."""
    spark = runs.sparkSession
    n, captures = runs.agg(F.count_distinct("run"), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(captures / RANGE_ROWS))
    if n > FAN:  # run numbers aren't consecutive: by their hash a group has about half of FAN
        n = math.ceil(2 * n / FAN)
        runs = merge_round(runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n))), parts, False)
    while n > FAN:
        n = math.ceil(n / FAN)
        runs = merge_round(runs.withColumn("group", F.floor(F.col("run") / FAN)), parts, False)
    merged = merge_round(runs.withColumn("group", F.lit(0).cast("long")), parts, True)
    base, before = [], 0
    for r in merged.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect():  # one row for each range
        base.append((r["shard"], before))
        before += r["n"]
    return merged.join(F.broadcast(spark.createDataFrame(base, "shard long, base long")), "shard").withColumn("rank", F.col("base") + F.col("at")).drop("shard", "base", "at")


def fetch(spark: SparkSession, path: str, index: DataFrame, page_ids: list[int]) -> DataFrame:
    """page_id, record (bytes) of a few pages: of the files that hold one, only these
    members are inflated.  index: merged_index() of the archives under path."""
    places = {}
    for r in index.where(F.col("page_id").isin(list(page_ids))).select("file", "offset", "length", "page_id").collect():  # rows of page_ids
        places.setdefault(r["file"], []).append((r["page_id"], r["offset"], r["length"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                view = memoryview(content.as_buffer())
                own = places[file.rpartition("/")[2]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in own], pa.int64()), pa.array([zlib.decompress(view[a: a + n], 31) for _, a, n in own], pa.binary())], ["page_id", "record"])

    if not places:
        return spark.createDataFrame([], "page_id long, record binary")
    return spark.read.format("binaryFile").load([f"{path}/{f}" for f in places]).select("path", "content").mapInArrow(rows, "page_id long, record binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every page archived, read back, and in the merged capture index."""
    path = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return merged_index(sorted_runs(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "rank")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d),
u AS (
  SELECT p.*, f.first, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', '') AS host, regexp_replace(rest, '^[^/?]*', '') AS tail
  FROM (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^.*?://', '') AS rest FROM p) p LEFT JOIN f ON p.d = f.d AND p.n >= 100),
k AS (SELECT *, CASE WHEN host = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || tail END AS urlkey FROM u)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
       urlkey, row_number() OVER (ORDER BY urlkey, page_id) - 1 AS rank
FROM k
"""
