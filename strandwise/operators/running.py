"""Running sums within keys of any number of rows: no window spans more than one range of rows.

Rows are sorted by key and order in ranges. What stands before a row is what stands before it in its range, and what its
key has in the ranges before; only the first key of a range can have any, so these carries are one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written


#: Rows that a task has at a time, unless said otherwise.
SHARE = 100_000


def parts_of(rows: DataFrame, share: int = SHARE) -> int:
    """Partitions in proportion to the rows, as many as a shuffle has at least: a task's memory then doesn't grow with them.
    The rows are counted: written ones, or a table's."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // share))


def running(
    rows: DataFrame,
    key: list[str],
    order: list[str | Column],
    sums: dict[str, Column] | None = None,
    xors: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Adds running sums and running exclusive ors (of bigint), the row's own value included, along ``order`` within ``key``.

    An empty key runs over all rows. Null values count as 0, null keys as one key; rows that tie come in any order, and
    equal rows may fill several ranges. Columns of these names are replaced. The rows are read twice (ranges are found by
    a sample) and kept once, as a table. parts: how many ranges there are, by default as many as a shuffle has partitions.
    """
    sums, xors = sums or {}, xors or {}
    named = {name: F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")) for name, value in (sums | xors).items()}
    valued = rows.withColumns({f"_v_{name}": value for name, value in named.items()} | {"_salt": F.rand(1)})
    ranges = valued.repartitionByRange(*([parts] if parts else []), *key, *order, "_salt").sortWithinPartitions(*key, *order, "_salt").drop("_salt", *named)
    held = written(ranges.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    total = lambda name: (F.sum if name in sums else F.bit_xor)(f"_v_{name}")
    both = lambda name, a, b: a + b if name in sums else a.bitwiseXOR(b)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = held.groupBy("_part", *key).agg(F.count("*").alias("_n"), *(total(name).alias(f"_v_{name}") for name in named))
    carried = own.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_k_{c}") for c in key), F.sum("_n").over(before).alias("_before"), *(total(n).over(before).alias(f"_c_{n}") for n in named))
    carried = carried.where("_before > 0").drop("_before")
    # at most one row for each range
    meets = F.col("_part") == F.col("_p")
    for c in key:
        meets = meets & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    within = Window.partitionBy("_part", *key).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    dealt = held.repartition(parts, "_part", *key) if parts else held
    local = dealt.withColumns({name: total(name).over(within) for name in named})
    out = local.join(F.broadcast(carried), meets, "left")
    out = out.withColumns({name: both(name, F.col(name), F.coalesce(f"_c_{name}", F.lit(0))) for name in named})
    return out.select(*(c for c in rows.columns if c not in named), *named)
