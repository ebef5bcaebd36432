"""FASTA, FASTQ and plain read files as tables, each file the work of one task.

Files come whole through Spark's binary reader, so that any store works, but for large ones: of these only the path is
read, and the task streams the file through Arrow's file systems. Plain, gzip and zstd files are told apart by suffix.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of this many bytes or more are streamed.
LARGE = 256 << 20
FASTA, FASTQ = (".fasta", ".fa", ".fna"), (".fastq", ".fq")


def kind_of(path: str) -> str:
    """fasta, fastq or reads, from the suffix below that of the compression."""
    name = path.lower().removesuffix(".gz").removesuffix(".bgz").removesuffix(".zst")
    for kind, suffixes in (("fasta", FASTA), ("fastq", FASTQ), ("reads", (".reads",))):
        if name.endswith(suffixes):
            return kind
    raise ValueError(f"unknown kind of file: {path}")


def stream(path: str):
    """A file opened where it lies."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream(path.removeprefix("file:"), compression=None)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_stream(name, compression=None)


def lines(path: str, content: bytes | None = None) -> Iterator[str]:
    """Lines of a file, given whole or streamed from its path, decompressed as they are read."""
    raw: io.BufferedIOBase = stream(path) if content is None else io.BytesIO(content)
    if path.lower().endswith((".gz", ".bgz")):
        raw = gzip.open(raw)
    elif path.lower().endswith(".zst"):
        import pyarrow as pa

        raw = pa.CompressedInputStream(raw, "zstd")
    return (line.rstrip("\r\n") for line in io.TextIOWrapper(raw, "utf-8"))


def from_files(spark: SparkSession, path: str, rows: Callable, schema: str, columns: list[str], batch: int, large: int) -> DataFrame:
    """What ``rows(path, lines)`` yields for each file under a path, in batches of so many rows."""

    def run(tables):
        import pandas as pd

        for table in tables:
            contents = table["content"] if "content" in table else [None] * len(table)
            for name, content in zip(table["path"], contents, strict=True):
                source = iter(rows(name, lines(name, content)))
                while part := list(islice(source, batch)):
                    yield pd.DataFrame(part, columns=columns)

    files = spark.read.format("binaryFile").load(path)
    whole = files.where(F.col("length") < large).select("path", "content")
    streamed = files.where(F.col("length") >= large).select("path")
    return whole.mapInPandas(run, schema).unionByName(streamed.mapInPandas(run, schema))


def records(kind: str, source: Iterator[str]) -> Iterator[tuple[str | None, str, str | None]]:
    """(id, seq, qual) of each record; FASTA sequences over several lines are joined."""
    if kind == "reads":
        yield from ((None, line, None) for line in source)
    elif kind == "fastq":
        for head in filter(None, source):
            seq, _, qual = next(source, ""), next(source, ""), next(source, None)
            yield head[1:].split(" ")[0], seq, qual
    else:
        name, parts = None, []
        for line in source:
            if line.startswith(">"):
                if name is not None:
                    yield name, "".join(parts), None
                name, parts = line[1:].split(" ")[0], []
            else:
                parts.append(line.strip())
        if name is not None:
            yield name, "".join(parts), None


def read_fastx(spark: SparkSession, path: str, kind: str | None = None, large: int = LARGE) -> DataFrame:
    """(file, row_idx, id, seq, qual) of all files under a path or pattern (S3, S5-S7); row_idx counts within a file.

    Records of one file can't be found without reading what stands before them, so a file is one task's work; it may
    have any size, since files of ``large`` bytes or more are streamed. An empty file gives no rows.
    """

    def rows(name: str, source: Iterator[str]) -> Iterator[tuple]:
        return ((name, at, *record) for at, record in enumerate(records(kind or kind_of(name), source)))

    schema = "file string, row_idx bigint, id string, seq string, qual string"
    return from_files(spark, path, rows, schema, ["file", "row_idx", "id", "seq", "qual"], 65_536, large)


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct barcodes (bc) of FASTA files, each line that isn't a header being one (S4); gzip and zstd files are read
    too, another suffix than that of FASTA is an error."""

    def rows(name: str, source: Iterator[str]) -> Iterator[tuple]:
        if kind_of(name) != "fasta":
            raise ValueError(f"no FASTA file: {name}")
        return ((line,) for line in source if not line.startswith(">"))

    found = from_files(spark, path, rows, "value string", ["value"], 65_536, LARGE)
    return found.select(F.upper(F.trim("value")).alias("bc")).where("bc != ''").distinct()


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(row_idx, r1, r2) of the read files of two mates, lane by lane, as far as both go."""
    from ..operators.distill import zip_reads

    return zip_reads([first, second])
