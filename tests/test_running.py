"""Running sums against loops."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandwise.operators.running import running


@pytest.mark.parametrize("hot", [0, 0.7])
@pytest.mark.parametrize("key", [["k"], []])
def test_running_sums_over_ranges(spark, key, hot):
    r = random.Random(3)
    rows = [(None if r.random() < 0.1 else 0 if r.random() < hot else r.randrange(9), i, r.choice([None, *range(-5, 6)])) for i in range(400)]
    table = spark.createDataFrame(rows, "k long, at long, v long").repartition(5)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running(table, key, [F.desc("at")], {"n": F.lit(1), "s": F.col("v")}, {"x": F.col("v")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = set()
    of = (lambda row: str(row[0])) if key else (lambda row: "")
    for _, group in groupby(sorted(rows, key=lambda row: (of(row), -row[1])), of):
        n = s = x = 0
        for k, at, v in group:
            n, s, x = n + 1, s + (v or 0), x ^ (v or 0)
            expected.add((k, at, v, n, s, x))
    assert len(found) == len(rows) and set(map(tuple, found)) == expected


def test_equal_rows_fill_several_ranges(spark):
    table = spark.range(1000).select(F.lit("a").alias("k"))
    found = running(table, ["k"], [], {"n": F.lit(1)})
    assert sorted(row.n for row in found.collect()) == list(range(1, 1001))
    assert running(table.limit(0), ["k"], [], {"n": F.lit(1)}).count() == 0
