"""Figures of a mapping as (metric, value) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapping_report(rows: DataFrame, chrom: DataFrame, features: DataFrame, levels: int = 2) -> DataFrame:
    """Genes and chromosomes there and targeted, barcodes by kind, perfect ones and those of up to ``levels`` mismatches
    (AG11-AG18).

    Rows are first reduced to one for each guide, gene and chromosome, so that no row is expanded for a distinct count.
    """
    target, gene = F.col("target").isNotNull(), F.col("locus_tag").isNotNull()
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    kinds = {"perfect": F.col("nm") == 0} | {f"{k}_mismatch{'es' * (k > 1)}": F.col("nm") == k for k in range(1, levels + 1)}
    kinds |= {"intergenic": target & ~gene, "non_targeting": ~target}
    per = rows.groupBy("spacer").agg(F.count_distinct("coords").alias("n"), *(any_of(c).alias(k) for k, c in kinds.items()))
    genes = rows.where(gene).groupBy("locus_tag").agg(any_of(F.col("genes") > 1).alias("overlapping"))
    tables = [
        rows.where("chr is not null").select("chr").distinct().agg(F.count("*").alias("chromosomes_targeted")),
        genes.agg(F.count("*").alias("genes_targeted"), F.count_if("overlapping").alias("overlapping_genes_targeted")),
        per.agg(F.count("*").alias("barcodes"), F.count_if(F.col("n") > 1).alias("barcodes_off_targeting"), *(F.count_if(k).alias(f"barcodes_{k}") for k in kinds)),
        features.select("chr", "locus_tag").distinct().agg(F.count("*").alias("genes")),
        chrom.agg(F.count("*").alias("chromosomes"), F.count_if("circular").alias("circular_chromosomes")),
    ]
    return reduce(DataFrame.unionByName, (t.unpivot([], t.columns, "metric", "value") for t in tables))


def systematic_name(lengths: DataFrame, pam: str, direction: str = "downstream") -> DataFrame:
    """A library's name from its guides' lengths and PAM."""
    all_lengths = F.array_join(F.array_sort(F.collect_set(F.length("spacer"))).cast("array<string>"), ",")
    parts = [all_lengths, F.lit(pam)] if direction == "downstream" else [F.lit(pam), all_lengths]
    return lengths.agg(F.concat_ws("-", *parts).alias("name"))


def genome_figures(chrom: DataFrame, features: DataFrame) -> DataFrame:
    """(section, name, value): topologies and lengths with their chromosomes, organisms where there are any, and genes of
    each chromosome (AG8, AG25). Sets are rows, so that they may be of any size."""
    topology = F.when(F.col("circular"), "circular").otherwise("linear")
    sets = {"topology": topology, "length": F.col("len").cast("string")}
    if "organism" in chrom.columns:
        sets["organism"] = F.col("organism")
    figures = F.array(*(F.struct(F.lit(k).alias("section"), c.alias("name")) for k, c in sets.items()))
    own = chrom.select(F.explode(figures).alias("f")).groupBy("f.section", "f.name").agg(F.count("*").alias("value"))
    genes = features.groupBy(F.col("chr").cast("string").alias("name")).agg(F.count("*").alias("value"))
    return own.select("section", "name", "value").unionByName(genes.select(F.lit("genes").alias("section"), "name", "value"))
