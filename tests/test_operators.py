"""Operators on small genomes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions import seq as S
from strandwise.operators import align, counting, design, distill, intervals, mapping, scan
from strandwise.plans import fixtures

COMPLEMENT = str.maketrans("ATCG", "TAGC")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


@pytest.fixture(scope="module")
def genome(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ACGT") for _ in range(n)), n, i % 2 == 0) for i, n in enumerate((300, 260, 1500, 90, 20))]
    return rows, spark.createDataFrame(rows, "chr int, seq string, len int, circular boolean").cache()


def test_windows(genome):
    rows, table = genome
    expected = set()
    for c, seq, n, ring in rows:
        if n >= 23:
            for i in range(n if ring else n - 19):
                expected.add((c, i, (seq + seq if ring else seq)[i : i + 20]))
    found = scan.windows(table, 20, 3).select("chr", "start", "window").collect()
    assert len(found) == len(expected) and {tuple(x) for x in found} == expected


@pytest.mark.parametrize("direction", ["downstream", "upstream"])
def test_guides(genome, direction):
    rows, table = genome
    expected = set()
    for _, seq, n, ring in rows:
        if n < 23:
            continue
        whole = seq + (seq if ring else "")
        for s in (whole, rc(whole)):
            for i in range(len(s) - 22):
                pam = s[i + 20 : i + 23] if direction == "downstream" else s[max(i - 3, 0) : i]
                if len(pam) == 3 and pam[1:] == "GG":
                    expected.add(s[i : i + 20])
    assert {x.spacer for x in scan.guides(table, 20, "NGG", direction).collect()} == expected


def test_pams_that_do_not_overlap(spark):
    table = spark.createDataFrame([(1, "ACGTAGGGGTGG", 12, False)], "chr int, seq string, len int, circular boolean")
    found = sorted(x.spacer for x in scan.pam_sites(table, 4, "NGG").collect())
    assert found == ["ACGT", "GGGG"]


@pytest.mark.parametrize("mismatches", [0, 1, 2])
def test_alignment(spark, genome, mismatches):
    rows, table = genome
    r = random.Random(mismatches)
    guides = set()
    for _, seq, n, _ in rows:
        if n > 60:
            for _ in range(6):
                at = r.randrange(n - 20)
                g = list(seq[at : at + 20])
                for _ in range(r.randrange(3)):
                    g[r.randrange(20)] = r.choice("ACGT")
                guides.add(r.choice([rc, str])("".join(g)))
    expected = set()
    for c, seq, n, ring in rows:
        if n >= 20:
            for i in range(n if ring else n - 19):
                w = (seq + seq if ring else seq)[i : i + 20]
                for g in guides:
                    for strand, read in (("F", g), ("R", rc(g))):
                        nm = sum(a != b for a, b in zip(read, w, strict=True))
                        if nm <= mismatches:
                            expected.add((g, c, i, strand, nm))
    own = spark.createDataFrame([(g,) for g in guides], "spacer string")
    found = [tuple(x) for x in align.align(own, table, 20, mismatches).select("spacer", "chr", "start", "strand", "nm").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


@pytest.mark.parametrize("width", [3, 1000])
def test_overlap_join(spark, width):
    r = random.Random(3)
    span = lambda: (r.randrange(3), s := r.randrange(-20, 80), s + r.randrange(12))
    a, b = [(i, *span()) for i in range(60)], [(i, *span()) for i in range(60)]
    left = spark.createDataFrame(a, "a int, chr int, s1 int, e1 int")
    right = spark.createDataFrame(b, "b int, chr int, s2 int, e2 int")
    expected = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    both = intervals.overlap_join(left, right, ("s1", "e1"), ("s2", "e2"), "left", width).select("a", "b").collect()
    assert sorted((x.a, x.b) for x in both if x.b is not None) == expected
    assert {x.a for x in both if x.b is None} == {x[0] for x in a} - {x for x, _ in expected}


def test_mapping_demotes_and_notes(spark):
    seq = "TTTTTTTTTT" + "ACGTACCTGACCATGCATGA" + "TGG" + "CCCCCCCCCC" + "GATTACAGATTACAGATTAC" + "AAA" + "TTTTT"
    chrom = spark.createDataFrame([("c", seq, len(seq), False)], "chr string, seq string, len int, circular boolean")
    genes = spark.createDataFrame([("c", "g1", "", 5, 40, 1)], "chr string, locus_tag string, gene string, feature_start int, feature_end int, strand int")
    guides = spark.createDataFrame([("n1", seq[10:30]), ("n2", seq[10:30]), ("n3", seq[43:63])], "name string, spacer string")
    rows = {r.spacer: r for r in mapping.map_targets(guides, chrom, genes).collect()}
    hit, miss = rows[seq[10:30]], rows[seq[43:63]]
    assert (hit.gene, hit.offset, hit.overlap, hit.tar_dir, hit.note, hit["count"]) == ("g1", 5, 20, "F", "1 site, 1 gene", 2)
    assert miss.target is None and miss.chr is None and miss.note == "non-targeting"
    assert mapping.drop_uninformative(mapping.map_targets(guides, chrom, genes)).columns.count("pam") == 0


@pytest.mark.parametrize(("offsets", "expected"), [((0, 5, 20, 39, 40), {0, 20, 40}), ((3,), {3}), ((), set())])
def test_tiling(spark, offsets, expected):
    rows = spark.createDataFrame([("g", f"s{o}", o, 20) for o in offsets], "locus_tag string, spacer string, offset int, overlap int")
    assert {r.offset for r in design.tile(rows, 20).collect()} == expected


def test_keep_top_and_orientation(spark):
    rows = spark.createDataFrame(
        [("g", "a", 4, "F", "F"), ("g", "b", None, "F", None), ("g", "c", 1, "F", "R"), (None, "a", None, "F", None), (None, "d", None, "F", None)],
        "locus_tag string, spacer string, offset int, sp_dir string, tar_dir string",
    ).withColumns({"chr": F.lit(1), "tar_start": F.lit(1)})
    assert {r.spacer for r in design.keep_top(rows, 2).collect()} == {"a", "c"}
    assert design.keep_top(rows, 2).count() == 3
    assert {r.spacer for r in design.orientation(rows, "reverse").collect()} == {"a", "b", "c", "d"}


def test_counts_ignore_n_and_flag_unknown(spark):
    library = spark.createDataFrame([("ACGT",), ("TTTT",)], "bc string")
    reads = ["AAACGTCC", "AAACGTCC", "AAGGGGCC", "AANCGTCC", "AAACGTCG", "AA", "", None]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "row_idx long, r1 string")
    found = {tuple(x) for x in counting.count_single(table, library, 0, 4, "AA", "CC").collect()}
    assert found == {("ACGT", True, 2), ("GGGG", False, 1)}
    with pytest.raises(ValueError, match="library"):
        counting.validate_library(library)


def test_sampling_matches_a_loop(spark):
    r = random.Random(1)
    bcs = ["".join(r.choice("ACGT") for _ in range(6)) for _ in range(12)]
    reads = ["".join(r.choice("ACGT") for _ in range(r.randrange(3))) + r.choice(bcs + [rc(b) for b in bcs]) + "ACG" for _ in range(200)]
    n, expected = len(set(bcs)), []
    for start in range(0, len(reads), n):
        seen = set()
        for read in reads[start : start + n]:
            for i in range(len(read) - 5):
                k = read[i : i + 6]
                if k not in seen and (k in bcs or rc(k) in bcs):
                    seen.add(k)
                    expected += [(i, w) for w, ok in (("forward", k in bcs), ("reverse", rc(k) in bcs)) if ok]
    table = spark.createDataFrame(list(enumerate(reads)), "row_idx long, r1 string")
    lib = spark.createDataFrame([(b,) for b in bcs], "bc string")
    found = counting.hits(table, lib, n, 6).select("at", "orient").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_distilled_rows_stay_aligned(spark):
    one = spark.createDataFrame([(0, "C"), (1, "A"), (2, "B")], "row_idx long, seq string")
    two = spark.createDataFrame([(0, "x"), (1, "y")], "row_idx long, seq string")
    assert [tuple(r) for r in distill.distill(distill.zip_reads([one, two])).collect()] == [("A", "y"), ("C", "x")]
    placed = {(r.r1, r.place) for r in distill.numbered(distill.distill(distill.zip_reads([one, two]))).collect()}
    assert placed == {("A", 1), ("C", 2)}


def test_outer_overlaps_whatever_the_partitions(spark):
    """Every left row comes back with each range it overlaps, or once alone, however the rows are dealt out."""
    r = random.Random(21)
    left = [(i, r.choice("ab"), s, s + r.randrange(1, 30)) for i, s in enumerate(r.randrange(-20, 3000) for _ in range(300))] + [(900, "a", None, None), (901, "c", 5, 9)]
    right = [(f"g{i}", r.choice("ab"), s, s + r.randrange(0, 400)) for i, s in enumerate(r.randrange(0, 3000) for _ in range(40))]
    expected = set()
    for i, c, s, e in left:
        met = {(i, g) for g, d, x, y in right if s is not None and c == d and s < y and x < e and x < y}
        expected |= met or {(i, None)}
    a = spark.createDataFrame(left, "id int, chr string, s int, e int")
    b = spark.createDataFrame(right, "name string, chr string, x int, y int")
    for n in (1, 5):
        rows = intervals.overlap_join(a.repartition(n), b.repartition(n), ("s", "e"), ("x", "y"), "left", width=64, longest=30)
        found = [(x.id, x.name) for x in rows.select("id", "name").collect()]
        assert len(found) == len(expected) and set(found) == expected
    with pytest.raises(Exception, match="a range over 5 bases"):
        intervals.overlap_join(a, b, ("s", "e"), ("x", "y"), "left", longest=5).collect()


def test_the_genome_is_scanned_once_for_a_map(spark, sf):
    """Chromosomes pass by once in all jobs of a map, counted where they are read."""
    fixtures.register(spark, sf)
    passed, chrom = spark.sparkContext.accumulator(0), spark.table("chrom")

    def counted(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    rows = mapping.map_targets(spark.table("guide"), chrom.mapInPandas(counted, chrom.schema), spark.table("feature"), 20, "NGG", 1)
    assert rows.count() > 0 and passed.value == chrom.count()


@pytest.mark.parametrize(("found", "begins", "has"), [("AGG", True, True), ("TAGG", False, True), ("NGG", False, False), ("", False, False), (None, False, False)])
def test_pams_at_the_beginning_and_within(spark, found, begins, has):
    row = spark.createDataFrame([(found,)], "p string")
    got = row.select(S.pam_matches("NGG", "p", "[ATCG]").alias("a"), S.pam_matches("NGG", "p", "[ATCG]", anywhere=True).alias("b")).first()
    assert (got.a, got.b) == (begins, has)


def test_ranks_of_repeated_rows(spark):
    rows = [("AC",)] * 700 + [("AA",)] * 3 + [("T",), ("G",)]
    found = distill.numbered(spark.createDataFrame(rows, "r1 string").repartition(7)).collect()
    assert sorted(x.place for x in found) == list(range(1, len(rows) + 1))
    assert [x.r1 for x in sorted(found, key=lambda x: x.place)] == sorted(x for (x,) in rows)


def test_windows_over_the_edges_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(scan, "LARGE", 64)
    monkeypatch.setattr(scan, "SMALL", 16)
    r = random.Random(22)
    seqs = [(c, "".join(r.choice("ACGT") for _ in range(n)), n, c % 2 == 0) for c, n in enumerate((23, 64, 65, 200, 331))]
    found = {(x.chr, x.start): (x.before, x.window, x.after) for x in scan.windows(spark.createDataFrame(seqs, "chr int, seq string, len int, circular boolean"), 20, 3).collect()}
    expected = {}
    for c, s, n, ring in seqs:
        for i in range(n if ring else n - 19):
            at = lambda j: s[j % n] if ring else s[j] if 0 <= j < n else "-"  # noqa: B023, E731
            expected[c, i] = tuple("".join(map(at, range(a, b))) for a, b in ((i - 3, i), (i, i + 20), (i + 20, i + 23)))
    assert found == expected
