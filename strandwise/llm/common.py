"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, forget, written

__all__ = ["WORD", "cut", "forget", "hex64", "read_table", "text_of", "words_of", "written"]

#: A word is a run of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def hex64(value: Column) -> Column:
    """Sixteen lowercase hex digits of a 64-bit integer."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
