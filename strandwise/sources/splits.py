"""Read files as a splittable source: byte ranges of a file are the work of many tasks.

A record belongs to the range that holds its first byte. A task finds the first line that begins in its range, then the first
record: in FASTQ, a line that begins with ``@`` and isn't followed by another such line (after a quality line that begins
so stands the next header, and no sequence does). Plain files are split by bytes, block-gzip files (bgzf) at their blocks,
whose headers a task finds from any place; other gzip and zstd files can't be split and are one range each.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fastx import kind_of, lines

SPLIT, CHUNK, BATCH = 64 << 20, 4 << 20, 32_768
#: What a block of bgzf begins with, and the most bytes that one has.
MAGIC, BLOCK = b"\x1f\x8b\x08\x04", 1 << 16
SCHEMA = "file string, part bigint, at bigint, id string, seq string, qual string"


def opened(path: str):
    """A file to read at any place, where it lies."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def block_size(head: bytes) -> int:
    """Bytes of the bgzf block that begins with these 18 or more bytes, 0 if none does."""
    if len(head) < 18 or not head.startswith(MAGIC) or head[12:16] != b"BC\x02\x00":
        return 0
    return int.from_bytes(head[16:18], "little") + 1


def bgzf_blocks(raw, size: int, start: int) -> tuple[bool, Iterator[tuple[int, bytes]]]:
    """Whether a line begins with the first block at or after ``start``, and (place, content) of the blocks from there on."""

    def from_place(at: int) -> Iterator[tuple[int, bytes]]:
        while at < size:
            raw.seek(at)
            head = raw.read(BLOCK)
            n = block_size(head)
            if not n or n > len(head):
                raise ValueError(f"no block of gzip begins at {at}")
            data = zlib.decompress(head[18 : n - 8], -15)
            if zlib.crc32(data) != int.from_bytes(head[n - 8 : n - 4], "little"):
                raise ValueError(f"the block of gzip at {at} is damaged")
            yield at, data
            at += n

    if start == 0:
        return True, from_place(0)
    low = max(0, start - 2 * BLOCK)
    raw.seek(low)
    near = raw.read(start - low + BLOCK + 18)
    at = near.find(MAGIC)
    while at >= 0:
        # a header is real if the blocks after it follow each other up to the start
        places, here = [], at
        while low + here < start and (n := block_size(near[here : here + 18])):
            places.append(low + here)
            here += n
        if places and (low + here >= start) and (low + here >= size or block_size(near[here : here + 18])):
            before = b"".join(data for _, data in islice(from_place(places[-1]), 1))
            for place in reversed(places[:-1]):
                if before:
                    break
                before = next(from_place(place))[1]
            return before.endswith(b"\n") or not before, from_place(low + here)
        at = near.find(MAGIC, at + 1)
    return True, from_place(size)


def plain_chunks(raw, start: int) -> tuple[bool, Iterator[tuple[int, bytes]]]:
    """The same of a plain file, in chunks."""

    def from_place(at: int) -> Iterator[tuple[int, bytes]]:
        while True:
            raw.seek(at)
            data = raw.read(CHUNK)
            if not data:
                return
            yield at, data
            at += len(data)

    raw.seek(max(0, start - 1))
    return start == 0 or raw.read(1) == b"\n", from_place(start)


def placed_lines(chunks: Iterable[tuple[int, bytes]], fresh: bool, exact: bool) -> Iterator[tuple[int, str]]:
    """(place, line) of lines that begin within the chunks; place: of the line's first byte, or of the chunk that holds it."""
    held, begun = [], None
    for place, data in chunks:
        pieces = data.split(b"\n")
        for piece in pieces[:-1]:
            if begun is None:
                begun = place
            held.append(piece)
            if fresh:
                yield begun, b"".join(held).decode().rstrip("\r")
            fresh, held, begun = True, [], None
            place += (len(piece) + 1) * exact
        if pieces[-1]:
            begun = place if begun is None else begun
            held.append(pieces[-1])
    if held and fresh:
        yield begun, b"".join(held).decode().rstrip("\r")


def records_from(kind: str, source: Iterator[tuple[int, str]], end: float, first: bool = True) -> Iterator[tuple[str | None, str, str | None]]:
    """(id, seq, qual) of records that begin before ``end``; first: the lines begin with a record, else maybe within one."""
    if kind == "reads":
        for place, line in source:
            if place >= end:
                return
            yield None, line, None
    elif kind == "fastq":
        if not first:
            head = next(source, None)
            while (after := next(source, None)) is not None:
                if head[1].startswith("@") and not after[1].startswith("@"):
                    source = chain([head, after], source)
                    break
                head = after
        for place, name in source:
            if place >= end:
                return
            if name:
                seq, _, qual = (next(source, (0, None))[1] for _ in range(3))
                yield name[1:].split(" ")[0], seq or "", qual
    else:
        name, parts = None, []
        for place, line in source:
            if line.startswith(">"):
                if name is not None:
                    yield name, "".join(parts), None
                    name = None
                if place >= end:
                    return
                name, parts = line[1:].split(" ")[0], []
            elif name is not None:
                parts.append(line.strip())
        if name is not None:
            yield name, "".join(parts), None


@dataclass
class Range(InputPartition):
    """Bytes of a file; whole: it can't be split."""

    file: str
    kind: str
    start: int
    end: int
    size: int
    whole: bool = False


def ranges(files: list[tuple[str, int]], kind: str | None, split: int) -> list[Range]:
    """The ranges of all files. Of each gzip file the first bytes are read, to see whether it has blocks."""
    made = []
    for path, size in files:
        what = kind or kind_of(path)
        packed = path.lower().endswith((".gz", ".bgz", ".zst"))
        if packed and (path.lower().endswith(".zst") or not block_size(opened(path).read(18))):
            made.append(Range(path, what, 0, size, size, True))
        else:
            made += [Range(path, what, a, min(a + split, size), size) for a in range(0, size, split)]
    return made


def read_range(part: Range) -> Iterator[tuple]:
    """(id, seq, qual) of a range's records."""
    if part.whole:
        yield from records_from(part.kind, ((0, line) for line in lines(part.file)), float("inf"))
        return
    raw, packed = opened(part.file), part.file.lower().endswith((".gz", ".bgz"))
    fresh, chunks = bgzf_blocks(raw, part.size, part.start) if packed else plain_chunks(raw, part.start)
    yield from records_from(part.kind, placed_lines(chunks, fresh, not packed), part.end, part.start == 0)


class ReadFiles(DataSource):
    """``spark.read.format("strandwise_reads")``; options files (JSON of path and size), kind and split."""

    @classmethod
    def name(cls) -> str:
        return "strandwise_reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ReadFilesReader(self.options)


class ReadFilesReader(DataSourceReader):
    def __init__(self, options):
        self.files = [tuple(x) for x in json.loads(options["files"])]
        self.kind, self.split = options.get("kind") or None, int(options.get("split") or SPLIT)

    def partitions(self) -> list[Range]:
        return ranges(self.files, self.kind, self.split)

    def read(self, part: Range):
        import pyarrow as pa

        kinds = [("file", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("qual", pa.string())]
        found, at = read_range(part), 0
        while rows := list(islice(found, BATCH)):
            n = len(rows)
            columns = [[part.file] * n, [part.start] * n, range(at, at + n), *zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))
            at += n


def scan_reads(spark: SparkSession, path: str | list[str], kind: str | None = None, split: int = SPLIT) -> DataFrame:
    """(file, part, at, id, seq, qual) of all read files under a path or pattern (S5-S7), in ranges of ``split`` bytes.

    part is where a range begins and at the number of a record within it: together they give the order within the file
    (see ``number_reads``). Plain and block-gzip files are split. Spark lists the files; tasks read them through Arrow's
    file systems (local, S3, GCS, HDFS); for a store that only Spark reads, use ``fastx.read_fastx``. A file without records
    gives no rows; FASTQ has four lines a record, blank lines between records are left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").orderBy("path").collect()
    spark.dataSource.register(ReadFiles)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format(ReadFiles.name()).options(files=json.dumps([(f.path, f.length) for f in files]), kind=kind or "", split=split).load()


def number_reads(reads: DataFrame) -> DataFrame:
    """(file, row_idx, id, seq, qual) of scanned reads: row_idx counts within a file.

    The records of each range are counted first, so the files are read twice; what stands before a range is the sum over
    the ranges before it in its file.
    """
    counts = reads.groupBy("file", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return reads.join(starts, ["file", "part"]).select("file", (F.col("_before") + F.col("at")).alias("row_idx"), "id", "seq", "qual")


def write_bgzf(path: str, data: bytes, size: int = 0xFF00) -> None:
    """A local file of block gzip, for small files and tests; every gzip reader reads it."""
    with open(path, "wb") as out:
        for at in [*range(0, len(data), size), None]:
            plain = b"" if at is None else data[at : at + size]
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = packer.compress(plain) + packer.flush()
            head = MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little")
            out.write(head + body + zlib.crc32(plain).to_bytes(4, "little") + len(plain).to_bytes(4, "little"))
