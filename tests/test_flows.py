"""Whole flows on small inputs, and the registered queries' shape."""

import random

import pytest

import __spark_entry__ as entry
from strandwise.plans import flows

COMPLEMENT = str.maketrans("ATCG", "TAGC")


def test_paired_counting_finds_places_and_flanks(spark):
    r = random.Random(9)
    bcs = ["".join(r.choice("ACGT") for _ in range(12)) for _ in range(10)]
    rows, expected = [], {}
    for i in range(400):
        bc = r.choice(bcs)
        if i % 50 == 7:
            bc = "A" * 12
        read = "GCTTGACCTAGA" + bc + "GTTTTAGAGCCA"
        rows.append((i, read, read.translate(COMPLEMENT)[::-1]))
        expected[bc] = expected.get(bc, 0) + 1
    reads = spark.createDataFrame(rows, "row_idx long, r1 string, r2 string")
    library = spark.createDataFrame([(b,) for b in bcs], "bc string")
    found = {x.barcode: (x.documented, x["count"]) for x in flows.count_barcodes(reads, library).collect()}
    assert found == {b: (b in bcs, n) for b, n in expected.items()}
    swapped = reads.selectExpr("row_idx", "r2 AS r1", "r1 AS r2")
    again = {x.barcode: (x.documented, x["count"]) for x in flows.count_barcodes(swapped, library).collect()}
    assert again == found


def test_design(spark):
    r = random.Random(4)
    seq = "".join(r.choice("ACGT") for _ in range(900))
    chrom = spark.createDataFrame([("c", seq, 900, False)], "chr string, seq string, len int, circular boolean")
    genes = spark.createDataFrame([("c", "g1", "abc", 100, 500, 1), ("c", "g2", "", 600, 880, -1)], "chr string, locus_tag string, gene string, feature_start int, feature_end int, strand int")
    rows = flows.design_guides(chrom, genes, 20, "ngg", top=2, kept="both").collect()
    assert rows and {x.locus_tag for x in rows} == {"g1", "g2"} and {x.gene for x in rows} == {"abc", "g2"}
    assert all(x.intergenic == 0 and x.nm == 0 for x in rows)
    assert all(sum(x.locus_tag == g for x in rows) <= 2 for g in ("g1", "g2"))
    with pytest.raises(ValueError, match="PAM"):
        flows.check_pam("NXG")


@pytest.mark.parametrize(
    "name",
    ["revcomp_gc", "barcode_counts_single", "snv_variants", "gene_overlap_join", "lane_pairs", "mixed_length_targets", "design_tiling_full", "ring_promoters"],
)
def test_queries_agree_with_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("documents", "lineitem", "events"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    mine = entry.queries()[name](spark, sf).toPandas()
    theirs = db.sql(entry.oracle_sql()[name]).df()[list(mine.columns)]
    key = lambda df: sorted(tuple(map(str, x)) for x in df.itertuples(index=False))
    assert key(mine) == key(theirs)


def test_every_sql_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["spacer"]


def test_mismatch_guides(spark):
    """Each guide's variants nearest to the scores asked for, as the operator picks them."""
    guides = spark.createDataFrame([("ACGTACGTACGTACGTACGT",), ("TTGACCTAGAGTTTTAGAGC",)], "spacer string")
    rows = flows.mismatch_guides(guides, 0.0, 0.5, 0.25).collect()
    assert {x.original for x in rows} == {x.spacer for x in guides.collect()} and len(rows) == 2 * 3
    assert len({(x.original, x.variant) for x in rows}) == len(rows)
    assert all(sum(a != b for a, b in zip(x.original, x.variant, strict=True)) == 1 for x in rows)
