"""A stored index of seeds, for alignments of many sets of guides with two or three mismatches to the same chromosomes.

A guide with v mismatches, cut into v + 2 blocks, has two blocks without any. Windows are stored once for each pair of
blocks, in buckets of a key of both blocks' bases, so that guides come to the buckets and the index isn't shuffled again. Bases are
kept as bits: whether a window fits is a count of differing bits, without any text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from .near import spans_of
from .scan import windows


@dataclass(frozen=True)
class SeedIndex:
    """A stored index: its table, and what it was built for."""

    table: str
    length: int
    mismatches: int
    flank: int

    def drop(self, spark: SparkSession) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _bits(text: Column, ones: str) -> Column:
    """A bit for each base, the first one highest: whether it is one of ``ones``."""
    return F.conv(F.regexp_replace(F.regexp_replace(F.translate(text, "01", "NN"), f"[{ones}]", "1"), "[^1]", "0"), 2, 10).cast("bigint")


def _planes(text: str) -> dict[str, Column]:
    """A text as bits: b0 and b1 tell A, C, G and T apart, other marks any other letter."""
    return {"b0": _bits(F.col(text), "CT"), "b1": _bits(F.col(text), "GT"), "other": _bits(F.col(text), "^ACGT")}


def _pairs(length: int, mismatches: int) -> list[tuple[int, int]]:
    return list(combinations(range(mismatches + 2), 2))


def _seeds(text: str, length: int, mismatches: int) -> Column:
    """(pair, key) of each pair of blocks."""
    spans = spans_of(length, mismatches + 2)
    part = lambda k: F.substring(text, spans[k][0] + 1, spans[k][1] - spans[k][0])
    made = (F.struct(F.lit(n).alias("pair"), F.xxhash64(F.lit(n), part(i), part(j)).alias("key")) for n, (i, j) in enumerate(_pairs(length, mismatches)))
    return F.explode(F.array(*made))


def build_index(chrom: DataFrame, length: int, mismatches: int = 3, flank: int = 3, buckets: int | None = None) -> SeedIndex:
    """Stores the index of all windows of chromosomes (chr, seq, len, circular) as a bucketed table of the warehouse.

    It holds a row for each window and pair of blocks: ten a base for three mismatches. Windows have 63 bases at most.
    """
    if not 0 < length <= 63 or mismatches + 2 > length:
        raise ValueError(f"windows of 1 to 63 bases, at least two more than mismatches: {length}, {mismatches}")
    spark = chrom.sparkSession
    found = windows(chrom, length, flank).withColumns(_planes("window"))
    odd = F.when(F.col("other") != 0, F.col("window")).alias("odd")
    rows = found.select("chr", "len", "start", "b0", "b1", "other", odd, "before", "after", _seeds("window", length, mismatches).alias("s"))
    rows = rows.select("s.*", *(c for c in rows.columns if c != "s"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"seeds_{uuid4().hex}"
    rows.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").saveAsTable(name, format="parquet")
    return SeedIndex(name, length, mismatches, flank)


def align_to_index(guides: DataFrame, index: SeedIndex, mismatches: int | None = None) -> DataFrame:
    """What ``align`` gives for guides of the index's length with at most as many mismatches as it was built for.

    An error for guides of another length or with other letters than A, C, G and T. Of a place that several pairs of blocks
    find, the first one's row is taken.
    """
    spark, n, v = guides.sparkSession, index.length, index.mismatches
    most = v if mismatches is None else mismatches
    if most > v:
        raise ValueError(f"the index finds {v} mismatches at most")
    own = guides.select(F.upper("spacer").alias("spacer")).distinct()
    wrong = F.raise_error(F.concat(F.lit(f"guides must have {n} bases A, C, G or T: "), F.col("spacer"))).cast("string")
    own = own.select(F.when((F.length("spacer") == n) & S.is_dna("spacer"), F.col("spacer")).otherwise(wrong).alias("spacer"))
    strands = F.array(
        F.struct(F.lit("F").alias("strand"), F.col("spacer").alias("read")),
        F.struct(F.lit("R").alias("strand"), S.rev_comp("spacer").alias("read")),
    )
    own = own.select("spacer", F.explode(strands).alias("s")).select("spacer", "s.*")
    planes = _planes("read")
    own = own.select("spacer", "strand", planes["b0"].alias("g0"), planes["b1"].alias("g1"), _seeds("read", n, v).alias("s"))
    own = own.select("spacer", "strand", "g0", "g1", "s.key")
    differ = F.col("b0").bitwiseXOR(F.col("g0")).bitwiseOR(F.col("b1").bitwiseXOR(F.col("g1"))).bitwiseOR(F.col("other"))
    # on the key alone, by which the index lies in buckets; it holds the pair's number, and the blocks are compared below
    hits = own.join(spark.table(index.table), "key").withColumn("_differ", differ)
    hits = hits.withColumn("nm", F.bit_count("_differ").cast("int")).where(F.col("nm") <= most)
    masks = [sum(1 << (n - 1 - k) for k in range(*span)) for span in spans_of(n, v + 2)]
    free = lambda k: F.col("_differ").bitwiseAND(F.lit(masks[k]).cast("bigint")) == 0
    first = F.lit(False)
    for number, (i, j) in enumerate(_pairs(n, v)):
        alone = free(i) & free(j)
        for k in range(j):
            if k != i:
                alone = alone & ~free(k)
        first = first | ((F.col("pair") == number) & alone)
    bit = lambda plane, i: F.shiftright(plane, n - i).bitwiseAND(F.lit(1).cast("bigint"))
    base = lambda i: F.substring(F.lit("ACGT"), (1 + bit("b0", i) + 2 * bit("b1", i)).cast("int"), F.lit(1))
    text = F.concat(*(base(i) for i in range(1, n + 1)))
    hits = hits.where(first).withColumn("_window", F.coalesce("odd", text))
    return hits.select("spacer", "chr", "len", "start", (F.col("start") + n).alias("end"), "strand", "nm", S.oriented("_window", "strand").alias("target"), "before", "after")
