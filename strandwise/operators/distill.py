"""Read distillation: reads of parallel files, aligned by row and sorted together."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def lanes(sides: list[DataFrame]) -> list[DataFrame]:
    """(row_idx, seq) of each side from (file, row_idx, seq), numbered over all files of a side alike.

    A side's files, in order of their names, are its lanes. Of a lane, all sides keep the rows that each of them has; rows
    are numbered on from lane to lane. An error if the sides have different numbers of files. Only names and sizes of
    files, found by a count of each side, come to the driver.
    """
    sizes = [sorted((r.file, r.n) for r in side.groupBy("file").agg((F.max("row_idx") + 1).alias("n")).collect()) for side in sides]
    if len({len(s) for s in sizes}) > 1:
        raise ValueError(f"sides have different numbers of files: {[[name for name, _ in s] for s in sizes]}")
    most = [min(n for _, n in lane) for lane in zip(*sizes, strict=True)]
    starts = list(accumulate(most, initial=0))
    out = []
    for side, named in zip(sides, sizes, strict=True):
        table = [(name, n, start) for (name, _), n, start in zip(named, most, starts, strict=False)]
        table = side.sparkSession.createDataFrame(table, "file string, _most bigint, _start bigint")
        own = side.join(F.broadcast(table), "file").where("row_idx < _most")
        out.append(own.select((F.col("_start") + F.col("row_idx")).alias("row_idx"), "seq"))
    return out


def zip_reads(files: list[DataFrame]) -> DataFrame:
    """(row_idx, r1, r2, ...) of the rows that all sides (row_idx, seq) have; sides with a column ``file`` are put together
    lane by lane (J10, J11)."""
    if all("file" in f.columns for f in files):
        files = lanes(files)
    named = [f.select("row_idx", F.col("seq").alias(f"r{i}")) for i, f in enumerate(files, 1)]
    return reduce(lambda a, b: a.join(b, "row_idx"), named)


def distill(reads: DataFrame) -> DataFrame:
    """Rows sorted by all read columns in order, in ranges; columns stay aligned (O5, AG26)."""
    columns = [c for c in reads.columns if c != "row_idx"]
    return reads.select(*columns).orderBy(*columns)


def numbered(rows: DataFrame) -> DataFrame:
    """The rows in order of all columns, with ``place``, a row's rank: from 1, ties in any order.

    Rows are sorted in ranges, equal ones over as many ranges as it takes, and kept in this form; a rank is the number of
    rows in the ranges before, of which there are as many as partitions, and the place within the range.
    """
    columns = rows.columns
    ranges = rows.withColumn("_salt", F.rand(1)).repartitionByRange(*columns, "_salt").sortWithinPartitions(*columns).drop("_salt")
    held = cut(ranges.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = held.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.select(*columns, (F.col("_start") + within + 1).alias("place"))
