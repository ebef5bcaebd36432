"""Places chosen along a line so that each lies at least a given distance after the one before.

A line is cut into stretches. What a stretch's last choice is depends only on where the one before ends, within one distance;
from a table of these, each stretch's beginning follows, and stretches choose on their own. So no line's places come together
in one row, only as many as a stretch has, and a line's table of ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written

#: Places of a stretch.
BIN = 4_096


def last_taken(places: np.ndarray, begin: int, size: int) -> np.ndarray:
    """For each threshold from ``begin`` to ``begin + size - 1``: the last place taken if the first one is the first at or after it,
    and each further one ``size`` after the one before; -1 if none is."""
    n, after = len(places), np.searchsorted(places, places + size)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    entry = np.searchsorted(places, begin + np.arange(size))
    return np.where(entry < n, places[last[np.minimum(entry, n - 1)]], -1)


def taken(places: np.ndarray, begin: int, size: int) -> list[int]:
    """Numbers of the places taken, the first at or after ``begin``."""
    out, after = [], np.searchsorted(places, places + size)
    i = int(np.searchsorted(places, begin))
    while i < len(places):
        out.append(i)
        i = int(after[i])
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ends(places: pd.Series, begin: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([last_taken(np.asarray(p), b, s) for p, b, s in zip(places, begin, size, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _taken(places: pd.Series, begin: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([taken(np.asarray(p), b, s) for p, b, s in zip(places, begin, size, strict=True)], dtype=object)


def spaced(places: DataFrame, key: list[str], size: int, width: int = BIN, long: Column | None = None) -> DataFrame:
    """The rows chosen of (key, at, ...): within a key, in order of ``at`` (not negative, each once), the first, then each that
    lies ``size`` (above 0) or more after the one chosen before.

    long: whether a key's places may go beyond its first stretch, from the key and the stretch's number ``_bin``, where that
    can be told without a shuffle. Of the other keys only what is chosen is written, without it all places are.
    """
    width = max(width, size)
    item = F.struct("at", *(c for c in places.columns if c not in (*key, "at")))
    bins = places.select(*key, F.floor(F.col("at") / width).alias("_bin"), item.alias("_item"))
    bins = bins.groupBy(*key, "_bin").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    step, begin = F.lit(size), F.col("_bin") * width
    done = None
    if long is not None:
        own = F.transform(_taken("_items.at", begin, step), lambda i: F.col("_items")[i])
        bins = bins.withColumn("_long", long).withColumn("_items", F.when(F.col("_long"), F.col("_items")).otherwise(own))
    bins = written(bins)  # used twice
    if long is not None:
        done = bins.where("not _long").select(*key, F.explode("_items").alias("_c")).select(*key, "_c.*")
        bins = bins.where("_long")
    long = bins.where("_bin > 0").select(*key).distinct()
    ends = bins.join(long, key, "left_semi").select(*key, F.struct(F.col("_bin").alias("bin"), _ends("_items.at", begin, step).alias("ends")).alias("_b"))
    lines = ends.groupBy(*key).agg(F.sort_array(F.collect_list("_b")).alias("_bins"))
    state = F.struct(F.lit(-size).cast("bigint").alias("last"), F.array().cast("array<struct<_bin:bigint,_last:bigint>>").alias("seen"))

    def along(s: Column, b: Column) -> Column:
        end = F.get(b["ends"], F.greatest(F.lit(0), s["last"] + size - b["bin"] * width).cast("int"))
        seen = F.concat(s["seen"], F.array(F.struct(b["bin"].alias("_bin"), s["last"].alias("_last"))))
        return F.struct(F.when(end >= 0, end).otherwise(s["last"]).alias("last"), seen.alias("seen"))

    known = lines.select(*key, F.inline(F.aggregate("_bins", state, along)["seen"]))
    begun = bins.join(known, [*key, "_bin"], "left").withColumn("_from", F.greatest(begin, F.coalesce("_last", F.lit(-size)) + size))
    chosen = begun.select(*key, "_items", F.explode(_taken("_items.at", "_from", step)).alias("_i"))
    chosen = chosen.select(*key, F.col("_items")[F.col("_i")].alias("_c")).select(*key, "_c.*")
    return chosen if done is None else done.unionByName(chosen)
