"""WARC records, and a fixity audit of two replicas by Merkle trees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayflow.llm.common import Scratch, empty_if_null

DATE = "2024-01-01T00:00:00Z"
#: How a metadata record begins.
META = "WARC/1.1\r\nWARC-Type: metadata\r\n"
#: Pages in a file of an archive built here.
FILE = 8192
#: Bytes decompressed or searched at a time, longest header, and bytes of records handed on at a time.
CHUNK, HEADER, AT_ONCE = 1 << 16, 1 << 16, 8 << 20
#: The smallest offset range has 2^16 bytes, and a node above has 2^6 of those below: up to 16 GiB in three steps.
RANGE_BITS, FAN_BITS, RANGE_LEVELS = 16, 6, 3
#: Above files, nodes gather those whose names' hashes begin with the same hex digits, of these numbers.
PREFIXES = (3, 1, 0)


# ---------------------------------------------------------------- records
def record_text(url: Column, html: Column, date: str = DATE) -> Column:
    """A response record with its HTTP message, whose identifier follows from its content."""
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), empty_if_null(html))
    digest = F.md5(F.concat(empty_if_null(url), F.lit("\n"), block))
    uuid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(header, block, F.lit("\r\n\r\n"))


def page_text(page_id: Column) -> Column:
    """A metadata record that names the page of the record before it."""
    block = F.concat(F.lit("page-id: "), F.coalesce(page_id.cast("string"), F.lit("")), F.lit("\r\n"))
    return F.concat(F.lit(META + "Content-Type: application/warc-fields\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def write_warc(pages: DataFrame, path: str, record: Column | None = None, date: str = DATE) -> None:
    """Pages as gzip files of at most FILE pages: for each its record and one that holds its ``page_id``.

    A task writes its rows as they come, so nothing is shuffled. Every record ends with the line feed that the
    text sink adds; ``record`` replaces the records (a column of the same length, ending alike).

    Defined cases: null urls have no target line, null html is an empty body, null ids an empty field; repeated
    rows are repeated records; an empty table writes no file; other columns are ignored, whatever their names.
    """
    whole = record_text(F.col("url").cast("string"), F.col("html").cast("string"), date)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.concat(whole if record is None else record, page_text(F.col("page_id"))).alias("value"))
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select(F.format_string("part-%05d-%05d", part, F.floor(place / FILE)).alias("file"), "row", F.expr("left(value, length(value) - 1)").alias("value"))
    rows.sortWithinPartitions("file", "row").select("file", "value").write.partitionBy("file").option("compression", "gzip").mode("overwrite").text(path)


class _Cut(Exception):
    pass


class _Data:
    """Bytes that come in chunks; what has been passed over is let go."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at, self.damaged, self.passed = chunks, bytearray(), 0, False, 0

    def need(self, n: int) -> bool:
        """Whether n bytes are there, as far as the source has them."""
        while len(self.held) - self.at < n and self.chunks is not None:
            try:
                self.held += next(self.chunks)
            except StopIteration:
                self.chunks = None
            except (_Cut, zlib.error):
                self.chunks, self.damaged = None, True
        return len(self.held) - self.at >= n

    def find(self, what: bytes, begin: int, most: int | None = None) -> int:
        """Where the bytes are next, counted from here; -1 if nowhere (among the first ``most``)."""
        while True:
            found = self.held.find(what, self.at + begin)
            if found >= 0:
                return found - self.at
            size = len(self.held) - self.at
            if (most is not None and size >= most) or not self.need(size + 1):
                return -1
            begin = max(begin, size - len(what) + 1)

    def take(self, n: int) -> bytes:
        out = bytes(self.held[self.at : self.at + n])
        self.skip(n)
        return out

    def skip(self, n: int) -> None:
        n = min(n, len(self.held) - self.at)
        self.at, self.passed = self.at + n, self.passed + n
        if self.at > 4 * CHUNK:
            del self.held[: self.at]
            self.at = 0


def _records(data: _Data) -> Iterator[tuple[int, bytes | None, str]]:
    """(length, record, status), one after the other; see ``parse_records``."""
    while data.need(1):
        size = None
        if data.need(5) and data.held[data.at : data.at + 5] == b"WARC/":
            head = data.find(b"\r\n\r\n", 0, HEADER)
            if head >= 0:
                fields = (line.split(b":", 1) for line in bytes(data.held[data.at : data.at + head]).split(b"\r\n")[1:])
                sizes = [f[1].strip() for f in fields if len(f) == 2 and f[0].strip().lower() == b"content-length"]
                size = head + 8 + int(sizes[0]) if sizes and sizes[0].isdigit() and len(sizes[0]) < 16 else None
            if size is not None and data.need(size) and data.held[data.at + size - 4 : data.at + size] == b"\r\n\r\n":
                yield size, data.take(size), "whole"
                continue
        following = data.find(b"WARC/1.", 5 if data.held[data.at : data.at + 5] == b"WARC/" else 0)
        used = following if following >= 0 else len(data.held) - data.at
        if size is not None:
            yield used, data.take(used), "damaged" if following >= 0 else "cut"
        else:
            lost = data.held[data.at : data.at + used].strip(b"\r\n")
            data.skip(used)
            if lost:
                yield used, None, "unreadable"


def _plain(data: memoryview) -> Iterator[bytes]:
    for at in range(0, len(data), CHUNK):
        yield data[at : at + CHUNK]


class _Member:
    """One gzip member of a file, decompressed by and by; ``end`` is then where it ends."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.begin, self.end = data, at, None

    def chunks(self) -> Iterator[bytes]:
        gzip, at = zlib.decompressobj(31), self.begin
        while not gzip.eof:
            if at >= len(self.data):
                raise _Cut
            part = self.data[at : at + CHUNK // 4]
            at += len(part)
            while len(part) and not gzip.eof:
                yield gzip.decompress(part, CHUNK)
                part = gzip.unconsumed_tail
        self.end = at - len(gzip.unused_data)


def _next_member(data: bytes, at: int) -> int:
    """Where the next gzip member begins that decompresses to a record."""
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 4096], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def parse_records(data: bytes) -> Iterator[tuple[int, int, bytes | None, str]]:
    """(offset, length, record, status) of what a file holds: plain, or gzip members of one or more records each.

    ``whole``: a record that ends as it should; ``damaged``: one that doesn't, up to the next record; ``cut``:
    one that the file ends in; ``unreadable``: bytes that are no record, up to the next one, or a gzip member
    from where it can't be decompressed (record is None). Offsets are the file's; in a gzip member they are
    the member's, plus the bytes before in what it decompresses to, and always beyond the record before. Every byte is passed over once.
    """
    view = memoryview(data)
    if view[:2] != b"\x1f\x8b":
        source = _Data(_plain(view))
        for size, record, status in _records(source):
            yield source.passed - size, size, record, status
        return
    at, last = 0, -1
    while at < len(view):
        member = _Member(view, at)
        source = _Data(member.chunks())
        for size, record, status in _records(source):
            if not (source.damaged and status != "whole" and record is None):
                last = max(at + source.passed - size, last + 1)
                yield last, size, record, status
        if not source.damaged and member.end is not None:
            at = member.end
            continue
        following = _next_member(data, at + 1)
        last = max(at + source.passed, last + 1)
        yield last, following - at, None, "unreadable"
        at = following


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What WARC files hold: ``file, offset, length, record, status``, by the files' names (or that of a folder ``file=...``).

    ``parse_records`` tells what the columns are and what becomes of damage: a row, and the rest of the file is
    read. An empty folder gives no rows. A file is one row of Spark's binary source, so of at most 2 GB.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "offset", "length", "record", "status"])

        for files in batches:
            for name, data in zip(files.column(0).to_pylist(), files.column(1)):
                rows, size = [], 0
                for offset, length, record, status in parse_records(data.as_py()):
                    rows.append((name, offset, length, record, status))
                    size += len(record or b"")
                    if size > AT_ONCE:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = F.split("path", "/")
    folder = F.regexp_extract(F.element_at(names, -2), "^file=(.*)$", 1)
    files = files.select(F.when(folder != "", folder).otherwise(F.element_at(names, -1)).alias("file"), "content")
    return files.mapInArrow(run, "file string, offset long, length long, record binary, status string")


# ---------------------------------------------------------------- trees
def _up(nodes: DataFrame, order: Column) -> DataFrame:
    """One node for each parent: the hash of its children's hashes in order. Keeps the columns that begin with ``up_``."""
    kept = [F.first(c).alias(c) for c in nodes.columns if c.startswith("up_")]
    children = F.array_sort(F.collect_list(F.struct(order.alias("order"), "key", "hash")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(" ", c["key"], c["hash"])), "\n")
    return nodes.groupBy(F.col("parent").alias("key")).agg(F.sha2(text, 256).alias("hash"), *kept)


def _range_key(file: str, offset: str, shift: int) -> Column:
    return F.concat_ws("/", file, F.coalesce(F.shiftright(offset, shift).cast("string"), F.lit("-")))


class Tree:
    """One replica's tree. ``leaves``: a row per (file, offset); ``levels``: ``key, parent, hash``, the root's children last.

    Leaves are records; the lowest nodes are the smallest offset ranges of a file, those above have up to 64
    ranges side by side; then come files, then files whose names' hashes begin alike. No node gathers more
    than its range's records or its children.
    """

    def __init__(self, records: DataFrame, scratch: Scratch, name: str):
        rows = records.select(F.col("file").cast("string").alias("file"), F.col("offset").cast("long").alias("offset"), F.coalesce(F.sha2("record", 256), F.lit("")).alias("digest"), F.octet_length("record").cast("long").alias("length"))
        # What repeats a place is one leaf. It isn't gathered: a sum and an exclusive or stand for its digests in any order.
        digests = F.concat_ws(" ", F.count(F.lit(1)), F.min("digest"), F.max("digest"), F.bit_xor(F.xxhash64("digest")), F.sum(F.xxhash64(F.lit(1), "digest").cast("decimal(38,0)")))
        leaves = rows.groupBy("file", "offset").agg(F.when(F.count(F.lit(1)) == 1, F.min("digest")).otherwise(digests).alias("hash"), F.sum("length").alias("length"))
        leaves = leaves.withColumn("up_file", F.coalesce(F.concat(F.lit("+"), "file"), F.lit("-")))
        self.leaves = scratch.save(leaves.withColumn("parent", _range_key("up_file", "offset", RANGE_BITS)), f"{name}-leaves")
        nodes = _up(self.leaves.select(F.coalesce(F.col("offset").cast("string"), F.lit("-")).alias("key"), "parent", "hash", "up_file", F.col("offset").alias("up_offset")), F.col("up_offset"))
        self.levels: list[DataFrame] = []
        for level in range(1, RANGE_LEVELS + 2):
            shift = RANGE_BITS + level * FAN_BITS
            parent = _range_key("up_file", "up_offset", shift) if level <= RANGE_LEVELS else F.col("up_file")
            self.levels.append(scratch.save(nodes.withColumn("parent", parent), f"{name}-range-{level}"))
            nodes = _up(self.levels[-1], F.col("up_offset"))
        nodes = nodes.select("key", "hash")
        for n in PREFIXES:
            whole = F.sha2("key", 256) if n == PREFIXES[0] else F.col("key")
            self.levels.append(scratch.save(nodes.withColumn("parent", F.substring(whole, 1, n)), f"{name}-files-{n}"))
            nodes = _up(self.levels[-1], F.col("key"))
        root = nodes.first()
        self.root: str | None = root.hash if root else None


def audit(one: DataFrame, other: DataFrame, scratch: Scratch) -> DataFrame:
    """Where two replicas of ``file, offset, record`` differ: ``file, offset, length, other_length, status``.

    Equal roots end the audit. Else each level compares the children of the nodes that differ above it, and
    no others, down to the records: 'changed', 'missing' (the other replica hasn't the place) or 'extra'
    (only the other has). A shorter or longer record moves what follows it to other places.

    Defined cases: rows without a file or with a null offset belong to a place of their own kind; a null
    record counts as changed against bytes; places that repeat are one leaf of all their records; an empty
    replica is all missing or all extra, and two empty ones agree; other columns are ignored, whatever their names.
    """
    a, b = Tree(one, scratch, "one"), Tree(other, scratch, "other")
    if a.root == b.root:
        return scratch.spark.createDataFrame([], "file string, offset long, length long, other_length long, status string")
    x, y = (rows.alias(name) for rows, name in zip(differing_leaves(a, b, scratch), "xy"))
    same = F.col("x.up_file") == F.col("y.up_file")
    both = x.join(y, same & F.col("x.offset").eqNullSafe(F.col("y.offset")), "full").filter(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
    place = (F.when(F.col("x.up_file").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in ("file", "offset"))
    status = F.when(F.col("y.up_file").isNull(), "missing").when(F.col("x.up_file").isNull(), "extra").otherwise("changed")
    return both.select(*place, F.col("x.length").alias("length"), F.col("y.length").alias("other_length"), status.alias("status"))


def differing_leaves(a: Tree, b: Tree, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Both trees' leaves in the offset ranges that differ, found from the root down: all that an audit looks at."""
    found = scratch.spark.createDataFrame([("",)], "key string")

    def below(level: DataFrame) -> DataFrame:
        return level.join(found.select(F.col("key").alias("parent")), "parent", "left_semi")

    for i in reversed(range(len(a.levels))):
        x = below(a.levels[i]).select("key", F.col("hash").alias("x"))
        y = below(b.levels[i]).select("key", F.col("hash").alias("y"))
        found = scratch.save(x.join(y, "key", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("key"), f"differ-{i}")
    return below(a.leaves), below(b.leaves)
