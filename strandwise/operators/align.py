"""Ungapped alignment of guides to chromosomes with few mismatches, as equi-joins on keys.

Windows that can't lie near any guide are left out where tiles are read (see ``near``). The texts of the others meet guides on
keys of most of their blocks, what meets is compared base by base, and places join these pairs by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..lineage import written
from .near import bitmap, keyed, near_windows
from .scan import SMALL, tiled


def lengths_of(guides: DataFrame) -> list[int]:
    """The lengths of guides, of which there are few; empty guides don't count."""
    return sorted(r.n for r in guides.select(F.length("spacer").alias("n")).where("n > 0").distinct().collect())


def _both_strands(own: DataFrame) -> DataFrame:
    """(spacer, strand, read): each guide as it reads on either strand."""
    strands = F.array(
        F.struct(F.lit("F").alias("strand"), F.col("spacer").alias("read")),
        F.struct(F.lit("R").alias("strand"), S.rev_comp("spacer").alias("read")),
    )
    return own.select("spacer", F.explode(strands).alias("s")).select("spacer", "s.*")


def _pairs(windows: DataFrame, reads: DataFrame, mismatches: int, said) -> DataFrame:
    """(window, spacer, strand, nm): texts of the column ``window``, each of which is there once, and the guides that they match.

    Of windows, only keys that the bitmap of the reads has are dealt out; a key's rows are sorted, since Spark takes both sides
    for as small as before they were multiplied by their keys, and would gather one at the driver.
    """
    met = keyed(windows, "window", mismatches, said).join(keyed(reads, "read", mismatches).hint("merge"), ["_block", "_key"])
    met = met.where(F.length("window") == F.length("read")).withColumn("nm", S.hamming("window", "read"))
    return met.where(F.col("nm") <= mismatches).select("window", "spacer", "strand", "nm").distinct()


def align(
    guides: DataFrame,
    chrom: DataFrame,
    length: int | list[int] | None = None,
    mismatches: int = 0,
    flank: int = 0,
    pam: str | None = None,
    direction: str = "downstream",
) -> DataFrame:
    """(spacer, chr, len, start, end, strand, nm, target, before, after): each place where a guide lies on either strand
    with at most ``mismatches`` substitutions (J4).

    target reads in the guide's direction. On a circle, end may lie beyond the chromosome's length. All places are
    returned. length: of the guides, or several; None: those that they have. Guides of all lengths are aligned in one
    pass over the chromosomes' tiles, each as if it were aligned with its like alone; another length than said is an error.
    pam (``flank`` bases): only places that have it; others are left out where tiles are read, as most places of guides are.
    """
    own = guides.select(F.upper("spacer").alias("spacer")).where("length(spacer) > 0")
    sizes = sorted({length} if isinstance(length, int) else set(length) if length is not None else lengths_of(own))
    if not sizes:  # no guides: the same columns without rows
        sizes = [1]
    other = F.raise_error(F.concat(F.lit(f"guides must have {sizes} bases: "), F.col("spacer"))).cast("string")
    own = own.select(F.when(F.length("spacer").isin(sizes), F.col("spacer")).otherwise(other).alias("spacer")).distinct()
    own = written(_both_strands(own))  # used several times
    said = chrom.sparkSession.sparkContext.broadcast(bitmap(own, mismatches, sizes))
    found = near_windows(chrom, own, sizes, mismatches, flank, pam, direction, said)
    if mismatches == 0:
        pairs = own.select(F.col("read").alias("window"), "spacer", "strand", F.lit(0).alias("nm"))
    else:
        # texts of windows meet guides once, however often they stand in the chromosomes
        found = written(found)
        pairs = _pairs(found.select("window").distinct(), own, mismatches, said)
    hits = found.join(pairs.hint("merge"), "window")
    if pam is not None:
        got = S.extract_pam("before", "after", "strand", direction)
        hits = hits.where(~got.contains("-") & S.pam_matches(pam, got))
    return hits.select(
        "spacer",
        "chr",
        "len",
        "start",
        (F.col("start") + F.length("window")).alias("end"),
        "strand",
        "nm",
        S.oriented("window", "strand").alias("target"),
        "before",
        "after",
    )


def beyond_ends(guides: DataFrame, chrom: DataFrame, sizes: list[int], mismatches: int, k: int, direction: str = "downstream") -> DataFrame:
    """(spacer): guides that have a place at which a PAM of ``k`` bases would lie off a linear chromosome.

    Only windows at the ends of chromosomes are looked at, a few of each.
    """
    size = F.explode(F.array(*map(F.lit, sizes))).alias("_n")
    ends = chrom.where("not circular").select("seq", "len", size).where(F.col("len") >= F.col("_n") + k)
    first, last = ("R", "F") if direction == "downstream" else ("F", "R")
    last_start = F.col("len") - F.col("_n")
    off = lambda strand, starts: F.transform(starts, lambda x: F.struct(F.lit(strand).alias("strand"), x.cast("int").alias("at")))
    # a window fits beside a PAM, so there are k of them at each end but for a chromosome that is shorter than both
    places = F.concat(
        off(first, F.filter(F.array(*map(F.lit, range(k))), lambda x: x <= last_start)),
        off(last, F.filter(F.array(*(last_start - i for i in range(k))), lambda x: x >= 0)),
    )
    ends = ends.select("seq", "_n", F.explode(places).alias("p"))
    ends = ends.select(F.expr("upper(substring(seq, p.at + 1, _n))").alias("window"), F.col("p.strand").alias("strand")).distinct()
    ends = written(ends)
    own = written(_both_strands(guides.select("spacer")))
    said = chrom.sparkSession.sparkContext.broadcast(bitmap(own, mismatches, sizes))
    met = _pairs(ends.select("window").distinct(), own, mismatches, said)
    return met.join(ends.hint("merge"), ["window", "strand"]).select("spacer").distinct()


def placed(alignments: DataFrame, chrom: DataFrame, flank: int = 0) -> DataFrame:
    """Alignments made elsewhere (spacer, chr, start, end, strand, nm, target), in the form that ``align`` gives.

    Places behind a circle's end, where it was lengthened by its beginning, are moved into it, and what is then there twice
    is kept once. The bases around a place, and its target if it has none, are looked up in tiles of the chromosomes,
    which meet only the places that lie in them. Rows without a place, or on unknown chromosomes, are left out.
    """
    lengths = chrom.select("chr", "len", "circular")
    own = alignments.where("chr is not null").withColumn("chr", F.col("chr").cast(chrom.schema["chr"].dataType)).join(lengths.hint("merge"), "chr")
    start = F.when(F.col("circular"), F.pmod("start", "len")).otherwise(F.col("start")).cast("int")
    own = own.select("spacer", "chr", start.alias("start"), (F.col("end") - F.col("start")).alias("_n"), "strand", F.col("nm").cast("int").alias("nm"), "target")
    own = own.dropDuplicates(["spacer", "chr", "start", "_n", "strand"])
    longest = own.agg(F.max("_n")).first()[0] or 1
    tiles = tiled(chrom, 1, longest, flank)
    own = own.withColumn("_first", (F.col("start") - F.col("start") % SMALL).cast("int"))
    met = own.join(tiles.drop("circular"), ["chr", "_first"])
    cut = lambda first, n: F.substring("_bases", F.col("start") - F.col("_first") + 1 + first, n).cast("string")
    there = S.oriented(cut(F.lit(flank), F.col("_n")), "strand")
    return met.select(
        "spacer",
        "chr",
        "len",
        "start",
        (F.col("start") + F.col("_n")).alias("end"),
        "strand",
        "nm",
        F.coalesce(F.upper("target"), there).alias("target"),
        cut(F.lit(0), F.lit(flank)).alias("before"),
        cut(flank + F.col("_n"), F.lit(flank)).alias("after"),
    )


def capped(found: DataFrame, most: int) -> DataFrame:
    """At most ``most`` places of each guide, those first by chromosome, place and strand (O7); all are kept by default,
    since this leaves targets out."""
    order = Window.partitionBy("spacer").orderBy("chr", "start", "strand")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
