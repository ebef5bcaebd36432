"""Barcode counts over files of reads as they arrive; an extension of the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.counting import count_single


def stream_counts(reads: DataFrame, library: DataFrame, start: int, length: int, left: str, right: str):
    """A writer of running counts (barcode, documented, count) for a stream of reads (r1).

    Files are counted by small batches; counts of each batch are appended to a table keyed by batch, so a batch that is
    run again after a failure replaces its own rows. The caller adds checkpoint location, trigger and target folder.
    """

    def into(path: str):
        def batch(rows: DataFrame, number: int) -> None:
            counted = count_single(rows, library, start, length, left, right)
            counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

        return batch

    return lambda path: reads.writeStream.foreachBatch(into(path))


def totals(spark, path: str) -> DataFrame:
    """Counts over all batches so far."""
    return spark.read.parquet(path).groupBy("barcode", "documented").sum("count").withColumnRenamed("sum(count)", "count")
