"""Overlap joins of half-open ranges.

Ranges are dealt into bins of ``width`` bases; a pair that shares several bins is kept in the one where its overlap
begins, so nothing is found twice. No row needs a number of its own, so the branches of a plan can't disagree about one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from .running import parts_of, running

WIDTH = 4_096
#: Features whose edges a task sweeps.
EDGED = 500_000


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def overlap_join(
    left: DataFrame, right: DataFrame, left_range, right_range, how: str = "inner", width: int = WIDTH, longest: int | None = None, keep: str | None = None, parts: int | None = None
) -> DataFrame:
    """Rows of both sides on the same chr whose ranges overlap (J1, J2); ``how``: inner or left.

    keep, parts (of a left join): a column for the bin in which a left row lies, so that all its pairs are together by chr and
    bin; how many partitions bins are dealt to (see ``parts_of``).

    left_range, right_range: names of the columns of start and end; other names must differ but for chr. Empty and null
    ranges overlap nothing. longest: the most bases that a range of the left side may have in a left join, found by a small
    aggregate if not given: each left row lies in the one bin where it begins, the right side also in the bins from which
    it can be reached, so that a plain outer join is enough. A longer left range is an error.
    """
    (ls, le), (rs, re) = (tuple(map(F.col, x)) for x in (left_range, right_range))
    meet = (ls < re) & (rs < le)
    if how == "inner":
        a = left.where(ls < le).withColumn("_bin", _bins(ls, le, width))
        b = right.where(rs < re).withColumn("_bin", _bins(rs, re, width))
        both = a.join(b, ["chr", "_bin"]).where(meet & (F.floor(F.greatest(ls, rs) / width) == F.col("_bin")))
        return both.drop("_bin")
    if longest is None:
        longest = max(1, left.agg(F.max(le - ls)).first()[0] or 0)
    too_long = F.raise_error(F.concat(F.lit(f"a range over {longest} bases: "), (le - ls).cast("string"))).cast("bigint")
    a = left.withColumn("_bin", F.when(le - ls > longest, too_long).when(ls < le, F.floor(ls / width)))
    b = right.where(rs < re).withColumn("_bin", _bins(rs - (longest - 1), re, width)).withColumnRenamed("chr", "_chr")
    b = b.withColumnRenamed("_bin", "_with")
    if parts is not None:
        a, b = a.repartition(parts, "chr", "_bin"), b.repartition(parts, "_chr", "_with")
    both = a.join(b, (F.col("chr") == F.col("_chr")) & (F.col("_bin") == F.col("_with")) & meet, "left")
    return (both.drop("_bin") if keep is None else both.withColumnRenamed("_bin", keep)).drop("_with", "_chr")


def ring_join(
    left: DataFrame, right: DataFrame, chrom: DataFrame, left_range, right_range, how: str = "inner", width: int = WIDTH, longest: int | None = None, keep: str | None = None
) -> DataFrame:
    """The same on chromosomes of which some are circles: ranges may begin before or end behind the origin.

    chrom: (chr, len, circular). On a circle, a left range is moved to where it begins within it, and the right side stands
    where it begins and once more a length before or behind, as far as a left range can reach it. Adds ``shift``, what is
    added to the right range to lie where the left range is, as given, and ``ring``, the circle's length (null on lines).
    A pair that meets on both sides of a circle is one row, that of the first meeting. A right range longer than its
    circle counts as long as it.
    """
    (ls, le), (rs, re) = (tuple(map(F.col, x)) for x in (left_range, right_range))
    rings = chrom.where("circular").select("chr", F.col("len").cast("bigint").alias("_ring"))
    if longest is None:
        longest = max(1, left.agg(F.max(le - ls)).first()[0] or 0)
    at = lambda x: F.when(F.col("_ring").isNotNull(), F.pmod(x, F.col("_ring"))).otherwise(x)
    a = left.join(rings, "chr", "left").withColumn("_ls", at(ls)).withColumn("_le", F.col("_ls") + (le - ls)).withColumnRenamed("_ring", "ring")
    b = right.join(rings, "chr", "left").withColumn("_rs", at(rs)).withColumn("_re", F.col("_rs") + F.least(re - rs, "_ring"))
    before = F.when(F.col("_re") > F.col("_ring"), -F.col("_ring"))
    behind = F.when(F.col("_rs") < longest, F.col("_ring"))
    b = b.withColumn("_by", F.explode(F.array_compact(F.array(F.lit(0).cast("bigint"), before, behind))))
    b = b.withColumns({"_rs": F.col("_rs") + F.col("_by"), "_re": F.col("_re") + F.col("_by"), "_moved": F.col("_rs") + F.col("_by") - rs}).drop("_by", "_ring")
    both = overlap_join(a, b, ("_ls", "_le"), ("_rs", "_re"), how, width, longest, keep)
    first = F.col("ring").isNull() | F.col("_rs").isNull() | (F.col("_re") - F.col("ring") <= F.col("_ls"))
    both = both.where(first).withColumn("shift", F.col("_moved") - (F.col("_ls") - ls))
    return both.drop("_ls", "_le", "_rs", "_re", "_moved")


def promoter_windows(features: DataFrame, up: int = 205, down: int = 95) -> DataFrame:
    """Features with window_start and window_end around their beginning, in which a target counts as upstream.

    Forward: from ``up`` bases before the start to ``down`` after it; else from ``down`` to ``up`` bases after the end. A
    forward feature across the origin, whose end lies beyond a column ``len``, has its window end ``down`` before it.
    """
    forward, back = F.col("strand") == 1, F.col("strand") == -1
    start = F.when(forward, F.col("feature_start") - up).when(back, F.col("feature_end") + down)
    across = F.col("feature_end") > F.col("len") if "len" in features.columns else F.lit(False)
    end = F.when(forward, F.col("feature_start") + F.when(across, -down).otherwise(down)).when(back, F.col("feature_end") + up)
    return features.withColumns({"window_start": start, "window_end": end})


def overlapping_genes(features: DataFrame) -> DataFrame:
    """(chr, locus_tag) of features that share a base with another one (AG10)."""
    own = features.select("chr", F.col("locus_tag").alias("a"), F.col("feature_start").alias("s1"), F.col("feature_end").alias("e1"))
    other = features.select("chr", F.col("locus_tag").alias("b"), F.col("feature_start").alias("s2"), F.col("feature_end").alias("e2"))
    both = overlap_join(own, other, ("s1", "e1"), ("s2", "e2")).where("a != b")
    return both.select("chr", F.col("a").alias("locus_tag")).distinct()


def ambiguous_coordinates(features: DataFrame) -> DataFrame:
    """(chr, bases) covered by more than one feature, by a sweep over starts and ends instead of single bases (AG9).

    Each place where the depth rises above one counts against, and each where it falls back for, the bases; the depth is a
    running sum over ranges of places, so that a chromosome of very many features is the work of many tasks.
    """
    features = written(features.select("chr", "feature_start", "feature_end"))  # counted, so that tasks are as many as they need
    parts = parts_of(features, EDGED)
    edge = lambda at, step: F.struct(F.col(at).alias("at"), F.lit(step).alias("step"))
    edges = features.select("chr", F.explode(F.array(edge("feature_start", 1), edge("feature_end", -1))).alias("e")).select("chr", "e.*")
    steps = edges.repartition(parts, "chr", "at").groupBy("chr", "at").agg(F.sum("step").alias("step"))
    swept = running(written(steps), ["chr"], ["at"], {"depth": F.col("step")}, parts=parts)
    deep = lambda depth: F.when(depth > 1, F.col("at")).otherwise(0)
    bases = F.sum(deep(F.col("depth") - F.col("step")) - deep(F.col("depth")))
    return swept.groupBy("chr").agg(bases.alias("bases")).where("bases > 0")
