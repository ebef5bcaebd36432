"""Alignments from SAM text: target bases from CIGAR and MD, and the same map as by our own alignment."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import align, mapping
from strandwise.plans import flows
from strandwise.sources import tables


@pytest.mark.parametrize(
    "seq, cigar, md, expected",
    [
        ("ACGT", "4M", "4", "ACGT"),
        ("ACGT", "4M", "0T3", "TCGT"),
        ("ACGT", "4M", "1A0A1", "AAAT"),
        ("ggACGTgg", "2S4M2S", "4", "ACGT"),
        ("ACTTGT", "2M2I2M", "4", "ACGT"),
        ("ACGT", "2M3D2M", "2^TTA2", "ACTTAGT"),
        ("ACGT", "1H2M1D2M3H", "1G0^C0A1", "AGCAT"),
        ("ACGT", "4=", "4", "ACGT"),
        ("ACGT", "4M", None, None),
    ],
)
def test_reference_bases(spark, seq, cigar, md, expected):
    row = spark.createDataFrame([(seq, cigar, md)], "seq string, cigar string, md string")
    assert row.select(tables.reference_bases(F.col("seq"), F.col("cigar"), F.col("md")).alias("x")).first().x == expected


def test_sam_gives_the_same_map(spark, tmp_path):
    r = random.Random(9)
    seqs = {"1": ("".join(r.choice("ACGT") for _ in range(3000)), True), "2": ("".join(r.choice("ACGT") for _ in range(500)), False)}
    chrom = spark.createDataFrame([(c, s, len(s), ring) for c, (s, ring) in seqs.items()], "chr string, seq string, len int, circular boolean")
    s = seqs["1"][0] * 2
    guides = {s[a : a + 20] for a in (0, 5, 1020, 2985, 2999)} | {s[40:59] + "A", "A" * 20, seqs["2"][0][480:], s[700:719]}
    guides |= {g[:10] + {"A": "C"}.get(g[10], "A") + g[11:] for g in list(guides)}
    table = spark.createDataFrame([(g, g) for g in sorted(guides)], "name string, spacer string")
    genes = spark.createDataFrame([("1", "g1", "", 10, 1100, 1), ("1", "g2", "x", 2990, 3030, -1), ("2", "g3", "y", 0, 499, 1)], "chr string, locus_tag string, gene string, feature_start int, feature_end int, strand int")
    found = align.align(table, chrom, None, 1, 3)
    # another aligner sees a circle with its beginning once more behind its end
    again = found.where("chr = '1' and start < 60").withColumns({"start": F.col("start") + 3000, "end": F.col("end") + 3000})
    lost = table.join(found, "spacer", "left_anti").select("spacer", *(F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "spacer"))
    tables.write_sam(found.unionByName(again).unionByName(lost), str(tmp_path / "sam"))
    for circular in ("strict", "full"):
        by_sam = flows.sam_targets(spark, str(tmp_path / "sam"), chrom, genes, "NGG", circular=circular)
        ours = mapping.map_targets(table, chrom, genes, None, "NGG", 1, circular=circular)
        assert sorted(map(str, by_sam.select(ours.columns).collect())) == sorted(map(str, ours.collect()))
    read = tables.read_sam(spark, str(tmp_path / "sam"))
    assert read.where("target is null and mapped").isEmpty() and read.where("not mapped").count() == lost.count() > 0
    # without MD the target is looked up in the chromosome
    bare = align.placed(read.where("mapped").withColumn("target", F.lit(None).cast("string")), chrom, 3)
    assert sorted(map(str, bare.select(found.columns).collect())) == sorted(map(str, found.collect()))
