"""Target mapping: alignments with PAMs, genes, and notes on each guide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..lineage import written
from .align import align, beyond_ends, lengths_of
from .intervals import overlap_join, ring_join


def sites(aligned: DataFrame) -> DataFrame:
    """Alignments with coordinates within their chromosome, direction, type and differences."""
    start, end = S.normal_start("start", "end", "len"), S.normal_end("end", "len")
    out = aligned.select("*", start.cast("int").alias("tar_start"), end.cast("int").alias("tar_end"), F.col("strand").alias("sp_dir"))
    return out.select("spacer", "chr", "len", "target", "nm", "tar_start", "tar_end", "sp_dir", *_said(), "before", "after")


def _said() -> list[Column]:
    """What is said of a site and follows from its other columns, so that it needn't be written or shuffled."""
    return [
        S.coords("tar_start", "tar_end", "len").alias("coords"),
        F.when(F.col("nm") > 0, "mismatch").when(F.col("nm") == 0, "perfect").alias("type"),
        S.diff("spacer", "target").alias("diff"),
    ]


def _gated(found: DataFrame, pam: str, direction: str) -> DataFrame:
    """Sites with their PAM, a spacer alone where none matches, and ``_off``, whether the PAM would lie off the chromosome."""
    got = S.extract_pam("before", "after", "sp_dir", direction)
    found = found.withColumn("pam", F.when(~F.coalesce(got.contains("-"), F.lit(False)), got))
    ok = S.pam_matches(pam, "pam")
    kept = [F.when(ok, F.col(c)).alias(c) if c != "spacer" else F.col(c) for c in found.columns if c not in ("before", "after")]
    return found.select(*kept, F.col("pam").isNull().alias("_off"))


def gate_by_pam(found: DataFrame, pam: str, direction: str = "downstream", out_of_bounds: str = "demote") -> DataFrame:
    """Sites with their PAM; one without a matching PAM keeps its spacer alone.

    out_of_bounds: a site whose PAM would lie off the chromosome is demoted like any other, or dropped (P1').
    """
    rows = _gated(found, pam, direction)
    return (rows.where("not _off") if out_of_bounds == "drop" else rows).drop("_off")


def drop_untargeted(rows: DataFrame) -> DataFrame:
    """Without the empty rows of guides that have a target elsewhere (P2); of other empty rows, each guide keeps one.

    rows are used twice: cut their lineage first if they are dear. A guide of very many targets is never gathered: its
    rows stay where they are, only the guides without any meet the list of those with one.
    """
    targeted = rows.where("target is not null")
    idle = rows.where("target is null").dropDuplicates(["spacer"])
    return targeted.unionByName(idle.join(targeted.select("spacer").distinct(), "spacer", "left_anti"))


def with_genes(
    rows: DataFrame,
    features: DataFrame,
    by: tuple[str, str] = ("feature_start", "feature_end"),
    longest: int = 1_000,
    rings: DataFrame | None = None,
    keep: str | None = None,
) -> DataFrame:
    """Each site with each gene that it overlaps, offset, overlap and the gene's direction; once with nulls if none.

    by: the columns of the range in which a site belongs to a gene; offset and overlap refer to the gene's own. longest:
    the most bases that a site has. rings: (chr, len, circular), if genes are to be met across the origin of circles too.
    keep: a column for the bin of a site, so that its rows are together by chr and bin.
    """
    start, end = F.col("feature_start"), F.col("feature_end")
    if rings is None:
        joined = overlap_join(rows, features, ("tar_start", "tar_end"), by, "left", longest=longest, keep=keep)
        overlap = S.overlap("tar_start", "tar_end", start, end)
    else:
        joined = ring_join(rows, features, rings, ("tar_start", "tar_end"), by, "left", longest=longest, keep=keep)
        start, end = ((x + F.col("shift")).cast("int") for x in (start, end))
        # a gene nearly as long as its circle may meet a site with both ends
        overlap = S.overlap("tar_start", "tar_end", start, end)
        again = S.overlap("tar_start", "tar_end", start + F.col("ring"), end + F.col("ring"))
        overlap = overlap + F.when(F.col("ring").isNotNull(), again).otherwise(0)
    joined = joined.withColumn("tar_dir", S.strand_letter("strand"))
    return joined.withColumns(
        {
            "gene": S.gene_name("gene", "locus_tag"),
            "offset": S.offset("tar_dir", "tar_start", "tar_end", start, end),
            "overlap": F.when(F.col("locus_tag").isNotNull(), overlap.cast("int")),
        }
    ).drop("strand", "feature_start", "feature_end", "shift", "ring", *({*by} - {"feature_start", "feature_end"}))


def notes(rows: DataFrame, counts: DataFrame | None = None, place: str = "", idle: str = "non-targeting") -> DataFrame:
    """(spacer, count, sites, genes, intergenic, note) of each guide (AG1-AG4, F22).

    place follows the number of genes, idle is the note of a guide without sites. counts: (spacer, name) of the guides as they came; without it each guide came once.
    A column ``_first`` of rows, if there is one, tells the first row of each of a guide's sites, which then are only counted.
    """
    if "_first" in rows.columns:
        sites = F.count_if("_first")
    else:
        sites = F.count_distinct(F.when(F.col("target").isNotNull(), F.concat_ws("_", F.col("chr").cast("string"), "coords")))
    out = rows.groupBy("spacer").agg(
        sites.alias("sites"),
        F.count_if(F.col("locus_tag").isNotNull()).alias("genes"),
        F.count_if(F.col("locus_tag").isNull() & F.col("target").isNotNull()).alias("intergenic"),
    )
    if counts is None:
        out = out.withColumn("count", F.lit(1).cast("bigint"))
    else:
        own = counts.groupBy("spacer").agg(F.count_distinct("name").alias("count"))
        out = out.join(own, "spacer", "left").fillna(0, "count")
    return out.select("spacer", "count", "sites", "genes", "intergenic", S.note("sites", "genes", "intergenic", place, idle).alias("note"))


def map_aligned(
    guides: DataFrame,
    aligned: DataFrame,
    chrom: DataFrame,
    features: DataFrame,
    pam: str = "NGG",
    direction: str = "downstream",
    out_of_bounds: str = "demote",
    circular: str = "strict",
    by: tuple[str, str] = ("feature_start", "feature_end"),
    longest: int = 1_000,
    **wording: str,
) -> DataFrame:
    """Every target of every guide with its genes, and a note on each guide, from alignments as ``align`` gives them.

    guides: (spacer) or (name, spacer); chrom: (chr, seq, len, circular); features: (chr, locus_tag, gene, feature_start,
    feature_end, strand). circular: "strict" joins genes by the places that sites have, "full" also across the origin of
    circles. longest: the most bases of a guide. Guides without a target have one row of nulls; with out_of_bounds "drop",
    those whose only sites were dropped have none. Sites that passed the gate, then sites with genes, are written as tables.
    """
    if circular not in ("strict", "full"):
        raise ValueError(f"circular is strict or full: {circular}")
    # of a site that loses its PAM its spacer alone is kept, so sites are gated before they are written
    found = written(_gated(sites(aligned), pam, direction)).drop("coords", "type", "diff")
    own = guides.select(F.upper("spacer").alias("spacer")).distinct()
    idle = own.join(found.where("target is not null").select("spacer").distinct(), "spacer", "left_anti")
    if out_of_bounds == "drop":
        placed, inside = found.select("spacer").distinct(), found.where("not _off").select("spacer").distinct()
        idle = idle.join(placed.join(inside, "spacer", "left_anti"), "spacer", "left_anti")
    return _map(guides, found.where("target is not null").drop("_off"), idle, chrom, features, circular, by, longest, **wording)


def _map(
    guides: DataFrame, targets: DataFrame, untargeted: DataFrame, chrom: DataFrame, features: DataFrame, circular: str, by: tuple[str, str], longest: int, **wording: str
) -> DataFrame:
    """The map of sites that have their PAM, and of guides (spacer) that have none but are to be shown.

    Rows of a site are together where it meets genes, so that equal ones and its first are told without a shuffle.
    """
    rows = with_genes(targets, features, by, longest, chrom if circular == "full" else None, "_bin").dropDuplicates()
    place = Window.partitionBy("chr", "_bin", "spacer", "tar_start", "tar_end").orderBy("spacer")
    rows = written(rows.withColumn("_first", F.row_number().over(place) == 1).drop("_bin"))
    blank = written(untargeted.select("spacer"))
    blank = blank.select(*(F.col(c) if c == "spacer" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    rows = rows.unionByName(blank)
    counts = guides.select("name", F.upper("spacer").alias("spacer")) if "name" in guides.columns else None
    out = rows.join(notes(rows, counts, **wording), "spacer").drop("_first")
    at = out.columns.index("sp_dir") + 1
    return out.select(*out.columns[:at], *_said(), *out.columns[at:])


def map_targets(
    guides: DataFrame, chrom: DataFrame, features: DataFrame, length: int | list[int] | None = 20, pam: str = "NGG", mismatches: int = 0, **how
) -> DataFrame:
    """The whole mapping flow: guides are aligned, then mapped as by ``map_aligned``, whose options follow.

    length: of the guides, or several, or None for those that they have; a guide of another length is an error. Only places
    that have the PAM leave the tiles of the genome, which are scanned once. With out_of_bounds "drop" they are scanned again for
    guides that have a place at the end of a line and none with a PAM.
    """
    length = lengths_of(guides) if length is None else [length] if isinstance(length, int) else list(length)
    how = {"direction": "downstream", "out_of_bounds": "demote", "circular": "strict", "by": ("feature_start", "feature_end")} | how
    direction, out_of_bounds = how.pop("direction"), how.pop("out_of_bounds")
    if how["circular"] not in ("strict", "full"):
        raise ValueError(f"circular is strict or full: {how['circular']}")
    own = written(guides.select(F.upper("spacer").alias("spacer")).distinct())
    aligned = sites(align(own, chrom, length, mismatches, len(pam), pam, direction))
    found = written(_gated(aligned, pam, direction).drop("coords", "type", "diff", "_off"))
    idle = own.join(found.select("spacer").distinct(), "spacer", "left_anti")
    if out_of_bounds == "drop":
        idle = written(idle)
        ends = written(beyond_ends(idle.where("length(spacer) > 0"), chrom, length, mismatches, len(pam), direction))
        if not ends.isEmpty():  # those that have no place with room for a PAM are dropped
            inside = _gated(sites(align(ends, chrom, length, mismatches, len(pam))), pam, direction).where("not _off")
            idle = idle.join(ends.join(inside.select("spacer").distinct(), "spacer", "left_anti"), "spacer", "left_anti")
    return _map(guides, found, idle, chrom, features, longest=max(length, default=1), **how)


def drop_uninformative(rows: DataFrame) -> DataFrame:
    """Without count, pam and nm where these say nothing, as a report shows them: one small aggregate is computed."""
    said = rows.agg(
        F.coalesce(F.min("count") == 1, F.lit(True)) & F.coalesce(F.max("count") == 1, F.lit(True)),
        F.count_distinct("pam") <= 1,
        F.coalesce((F.min("nm") == 0) & (F.max("nm") == 0) & (F.count_if(F.col("nm").isNull()) == 0), F.lit(False)),
    ).first()
    return rows.drop(*(c for c, idle in zip(("count", "pam", "nm"), said, strict=True) if idle))


def ordered(rows: DataFrame) -> DataFrame:
    """By chromosome, place and spacer, then by gene (O1)."""
    nulls_last = lambda *names: [F.col(c).asc_nulls_last() for c in names]
    return rows.orderBy(*nulls_last("chr", "tar_start", "spacer", "locus_tag", "offset"))
