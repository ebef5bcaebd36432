"""Readers and writers on files made here."""

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from strandwise.sources import fastx, genbank, sinks, tables

RECORD = """LOCUS       C1   60 bp    DNA     circular BCT 01-JAN-2000
VERSION     C1.1
  ORGANISM  Some thing
FEATURES             Location/Qualifiers
     source          1..60
     gene            join(50..60,1..8)
                     /gene="abc"
                     /locus_tag="L1"
     gene            complement(20..31)
                     /locus_tag="L2"
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac
       31 acgtacgtac gtacgtacgt acgtacgtac
//
"""


def test_fastx(spark, tmp_path):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@x 1\nACGT\n+\nIIII\n@y\nTTTT\n+\nIIII\n")
    with pa.output_stream(str(tmp_path / "b.reads.zst"), compression="zstd") as f:
        f.write(b"GGGG\nCCCC\nAAAA\n")
    (tmp_path / "c.fa").write_text(">p q\nAC\nGT\n>r\nTT\n")
    one, two = (fastx.read_fastx(spark, str(tmp_path / n)) for n in ("a.fastq.gz", "b.reads.zst"))
    assert [(r.row_idx, r.id, r.seq) for r in one.collect()] == [(0, "x", "ACGT"), (1, "y", "TTTT")]
    assert {(r.r1, r.r2) for r in fastx.paired(one, two).collect()} == {("ACGT", "GGGG"), ("TTTT", "CCCC")}
    assert [(r.id, r.seq) for r in fastx.read_fastx(spark, str(tmp_path / "c.fa")).collect()] == [("p", "ACGT"), ("r", "TT")]
    assert {r.bc for r in fastx.read_barcodes(spark, str(tmp_path / "c.fa")).collect()} == {"AC", "GT", "TT"}


def test_large_files_are_streamed(spark, tmp_path):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@x 1\nACGT\n+\nIIII\n@y\nTTTT\n+\nIIII\n")
    with pa.output_stream(str(tmp_path / "b.reads.zst"), compression="zstd") as f:
        f.write(b"GGGG\n" * 70_000)
    (tmp_path / "c.fa").write_text(">p q\nAC\nGT\n>r\nTT\n")
    (tmp_path / "d e.fa").write_text("")
    for name in ("a.fastq.gz", "b.reads.zst", "c.fa", "d e.fa"):
        path = str(tmp_path / name)
        whole, streamed = fastx.read_fastx(spark, path), fastx.read_fastx(spark, path, large=0)
        assert sorted(whole.collect()) == sorted(streamed.collect())
    (tmp_path / "a.gb").write_text(RECORD)
    whole, streamed = (genbank.read_genbank(spark, str(tmp_path / "a.gb"), large=n) for n in (1 << 20, 0))
    assert whole.collect() == streamed.collect() and whole.count() == 1


def test_qualifiers_with_slashes_and_over_lines():
    gene = """     gene            1..8
                     /note="see a/b, and
                     /gene=nothing in a note, ""quoted"" too"
                     /pseudo
                     /gene="x/y"
                     /gene="second"
                     /locus_tag="L9"
"""
    text = RECORD.replace("     gene            complement(20..31)\n", gene + "     gene            complement(20..31)\n")
    (record,) = genbank.parse(iter(text.splitlines()))
    assert [(f[0], f[1], f[2]) for f in record[4]] == [("source", None, None), ("gene", "L1", "abc"), ("gene", "L9", "x/y"), ("gene", "L2", None)]


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD)
    records = genbank.read_genbank(spark, str(tmp_path / "a.gb"))
    chrom = genbank.chromosomes(records)
    assert [tuple(r)[:2] + tuple(r)[3:] for r in chrom.collect()] == [("C1.1", "Some thing", 60, True)]
    found = genbank.features(records)
    assert {(r.locus_tag, r.gene, r.feature_start, r.feature_end, r.strand) for r in found.collect()} == {("L1", "abc", 49, 68, 1), ("L2", None, 19, 31, -1)}
    assert genbank.overhang(found, chrom).count() == 4
    assert {r.locus_tag for r in genbank.locus_names(found).collect()} == {"L1", "L2"}


def test_tables_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("ACGT", None), ("TTTT", 3)], "spacer string, n int")
    sinks.write_tsv(rows, str(tmp_path / "t"))
    assert {tuple(r) for r in tables.read_targets(spark, str(tmp_path / "t")).collect()} == {("ACGT", None), ("TTTT", "3")}
    assert {r.bc for r in tables.read_library(spark, str(tmp_path / "t"), "spacer").collect()} == {"ACGT", "TTTT"}
    sinks.write_fastq(rows, str(tmp_path / "q"))
    assert fastx.read_fastx(spark, str(tmp_path / "q"), "fastq").count() == 2
    sam = "@HD\nr1\t16\tc\t11\t9\t4M\t*\t0\t0\tAACC\tIIII\tNM:i:1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAAAA\tIIII\n"
    (tmp_path / "x.sam").write_text(sam)
    got = {r.name: r for r in tables.read_sam(spark, str(tmp_path / "x.sam")).collect()}
    assert (got["r1"].spacer, got["r1"].start, got["r1"].end, got["r1"].strand, got["r1"].nm) == ("GGTT", 10, 14, "R", 1)
    assert got["r2"].chr is None and not got["r2"].mapped
    sinks.write_counts(rows.select(F.col("spacer").alias("barcode"), F.lit(True).alias("documented"), F.lit(2).alias("count")), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 2


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from strandwise.operators.counting import count_single
    from strandwise.streaming.counting import stream_counts, totals

    library = spark.createDataFrame([("ACGT",)], "bc string")
    reads = spark.createDataFrame([(i, r) for i, r in enumerate(["AAACGTCC", "AAGGGGCC", "AAACGTCC"])], "row_idx long, r1 string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = stream_counts(stream, library, 0, 4, "AA", "CC")(str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    key = lambda rows: sorted((r.barcode, r.documented, r["count"]) for r in rows)
    assert key(totals(spark, str(tmp_path / "out")).collect()) == key(count_single(reads, library, 0, 4, "AA", "CC").collect())


def test_more_writers(spark, tmp_path):
    import json

    from strandwise.sources import sinks

    rows = spark.createDataFrame([("AC", None), ("GT", 2.0)], "r1 string, n double").coalesce(1)
    sinks.write_json_array(rows, str(tmp_path / "array"))
    (file,) = (tmp_path / "array").glob("part-*")
    assert json.loads(file.read_text()) == [{"r1": "AC", "n": None}, {"r1": "GT", "n": 2.0}]
    sinks.write_json_array(rows.limit(0), str(tmp_path / "none"))
    assert all(json.loads(f.read_text() or "[]") == [] for f in (tmp_path / "none").glob("part-*"))
    assert dict(sinks.integral(rows).dtypes) == {"r1": "string", "n": "bigint"}
    assert dict(sinks.integral(rows.selectExpr("n / 4 AS n")).dtypes) == {"n": "double"}


def test_flanks_of_mates():
    from strandwise.operators.counting import flanks_agree

    assert flanks_agree(("TTGA", "GTTT"), ("AAAC", "TCAA"))
    assert flanks_agree(("CCTTGA", "GTTT"), ("AAAC", "TCAA"))
    assert not flanks_agree(("TTGA", "GTTT"), ("AAAC", "TCAG"))


def test_lists_weights_and_reads_of_text(spark, tmp_path):
    from strandwise.sources import tables

    assert sorted(r.bc for r in tables.barcodes(spark, ["acg", "ACG", "TTT"]).collect()) == ["ACG", "TTT"]
    (tmp_path / "w.csv").write_text("feature,weight,other\nintercept,0.5,x\n0,-1.25,y\n")
    assert tables.read_weights(spark, str(tmp_path / "w.csv")) == {"intercept": 0.5, "0": -1.25}


def test_read_files_stay_aligned(spark, tmp_path):
    from strandwise.sources import fastx, sinks

    pairs = [(f"{i:03d}A", f"{i:03d}T") for i in range(50)]
    sinks.write_read_files(spark.createDataFrame(pairs, "r1 string, r2 string").repartition(3), str(tmp_path))
    import gzip

    read = {c: [gzip.open(f, "rt").read().split() for f in sorted((tmp_path / f"{c}.reads").glob("part-*"))] for c in ("r1", "r2")}
    assert [len(x) for x in read["r1"]] == [len(x) for x in read["r2"]]
    rows = [p for a, b in zip(read["r1"], read["r2"], strict=True) for p in zip(a, b, strict=True)]
    assert sorted(rows) == pairs and fastx.kind_of("x.reads.gz") == "reads"


def test_locations():
    assert genbank.location("1..9") == (1, [(0, 9)]) and genbank.location("<5..>9") == (1, [(4, 9)]) and genbank.location("7") == (1, [(6, 7)])
    assert genbank.location("complement(join(1..3,7..9))") == (-1, [(0, 3), (6, 9)])
    assert genbank.location("join(complement(1..3),7..9)") == (None, [(0, 3), (6, 9)])
    assert genbank.location("join(J00194.1:100..202,1..5)") == (1, [(0, 5)])
    assert genbank.location("123^124") == (1, [(123, 123)]) and genbank.location("order(1..2, complement(4..5))") == (None, [(0, 2), (3, 5)])
