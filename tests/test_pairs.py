"""Guides of several lengths, circles, sampling of pairs, committed writers: each against a loop."""

import random
import warnings
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.operators import align, counting, intervals, mapping
from strandwise.plans import flows
from strandwise.sources import frames

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(TURN)[::-1]


@pytest.fixture(scope="module")
def genome(spark):
    r = random.Random(4)
    seqs = {1: ("".join(r.choice("ACGT") for _ in range(900)), True), 2: ("".join(r.choice("AC") for _ in range(300)), False), 3: ("ACGTTGCAAC", True), 4: ("ACGTACGTACGTACGTACGTACG", False)}
    return seqs, spark.createDataFrame([(c, s, len(s), ring) for c, (s, ring) in seqs.items()], "chr long, seq string, len int, circular boolean")


@pytest.mark.parametrize("mismatches", [0, 1, 2])
def test_guides_of_several_lengths(spark, genome, mismatches):
    seqs, chrom = genome
    guides = sorted({(seqs[1][0] * 2)[a : a + n] for a, n in [(0, 19), (0, 20), (50, 21), (885, 20), (885, 21), (890, 19)]} | {seqs[2][0][281:], seqs[2][0][-21:], rc(seqs[1][0][100:119]), "ACGTTGC", "A" * 20, "ACGTACGTACGTACGTACGTA"})
    expected = set()
    for c, (s, ring) in seqs.items():
        for g in guides:
            n = len(g)
            for at in range(len(s) if ring else len(s) - n + 1):
                w = (s * 3)[at : at + n] if ring else s[at : at + n]
                for strand, read in (("F", g), ("R", rc(g))):
                    nm = sum(x != y for x, y in zip(w, read))
                    if nm <= mismatches and len(s) >= n + 3:
                        around = s * 3 if ring else "---" + s + "---"
                        k = at + (len(s) if ring else 3)
                        expected.add((g, c, at, at + n, strand, nm, around[k - 3 : k], around[k + n : k + n + 3]))
    table = spark.createDataFrame([(g,) for g in guides], "spacer string")
    found = align.align(table, chrom, None, mismatches, 3).select("spacer", "chr", "start", "end", "strand", "nm", "before", "after").collect()
    assert len(found) == len(expected) and set(map(tuple, found)) == expected
    with pytest.raises(Exception, match="guides must have"):
        align.align(table, chrom, 20, mismatches).collect()


def test_lengths_map_as_separate_runs(spark, genome):
    """A library of mixed lengths maps as one run for each length does; none is called non-targeting for its length."""
    seqs, chrom = genome
    s = seqs[1][0]
    at = s.index("GG", 200)
    guides = [s[at - 1 - n : at - 1] for n in (19, 20, 21)]
    genes = spark.createDataFrame([(1, "g", "g", 0, 800, 1)], "chr long, locus_tag string, gene string, feature_start int, feature_end int, strand int")
    table = spark.createDataFrame([(g,) for g in guides], "spacer string")
    whole = mapping.map_targets(table, chrom, genes, None, "NGG", 1)
    each = [mapping.map_targets(table.where(F.length("spacer") == n), chrom, genes, n, "NGG", 1) for n in (19, 20, 21)]
    assert sorted(map(str, whole.collect())) == sorted(str(x) for e in each for x in e.collect())
    assert {x.note for x in whole.collect()} == {"1 site, 1 gene"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_ranges_on_circles(spark, how):
    r = random.Random(8)
    chroms = {1: (100, True), 2: (100, False), 3: (37, True)}
    place = lambda n, ring, m: (lambda a: (a, a + r.randrange(1, m)))(r.randrange(-n if ring else 0, n))
    left = [(c, i, *place(n, ring, 12)) for i in range(60) for c, (n, ring) in chroms.items()]
    right = [(c, i, *place(n, ring, n)) for i in range(25) for c, (n, ring) in chroms.items()]
    expected = set()
    for c, i, a, b in left:
        n, ring = chroms[c]
        mates = set()
        for d, j, x, y in right:
            bases = [{k % n for k in range(*z)} if ring else set(range(*z)) for z in ((a, b), (x, y))]
            if c == d and bases[0] & bases[1]:
                mates.add((c, i, j))
        expected |= mates or ({(c, i, None)} if how == "left" else set())
    tables = [spark.createDataFrame(rows, f"chr long, {p} long, {p}s int, {p}e int") for rows, p in ((left, "l"), (right, "r"))]
    chrom = spark.createDataFrame([(c, n, ring) for c, (n, ring) in chroms.items()], "chr long, len int, circular boolean")
    found = intervals.ring_join(*tables, chrom, ("ls", "le"), ("rs", "re"), how, width=16).collect()
    assert len(found) == len(expected) and {(x.chr, x.l, x.r) for x in found} == expected
    for x in found:
        if x.r is not None:  # the shifted range lies over the left one
            assert max(x.ls, x.rs + x["shift"]) < min(x.le, x.re + x["shift"]) and x["shift"] % chroms[x.chr][0] in ((0,) if chroms[x.chr][1] else (x["shift"],))


def test_genes_over_the_origin(spark):
    """On a circle, a site just behind the origin lies in a gene that begins before it, at an offset along the gene."""
    r = random.Random(1)
    s = "".join(r.choice("ACGT") for _ in range(400))
    s = s[:30] + "AGG" + s[33:]
    chrom = spark.createDataFrame([(1, s, 400, True)], "chr long, seq string, len int, circular boolean")
    genes = spark.createDataFrame([(1, "over", "", 380, 440, 1), (1, "back", "", 385, 420, -1)], "chr long, locus_tag string, gene string, feature_start int, feature_end int, strand int")
    guides = spark.createDataFrame([(s[10:30],)], "spacer string")
    rows = {circular: mapping.map_targets(guides, chrom, genes, 20, "NGG", circular=circular).collect() for circular in ("strict", "full")}
    assert [x.locus_tag for x in rows["strict"]] == [None]
    assert {(x.locus_tag, x.tar_start, x.offset, x.overlap) for x in rows["full"]} == {("over", 10, 30, 20), ("back", 10, -10, 10)}
    with pytest.raises(ValueError, match="strict or full"):
        mapping.map_targets(guides, chrom, genes, 20, "NGG", circular="x")


def loop(pairs, barcodes, chunk):
    """Sampling of pairs as one goes through them: hits by chunk, pairs passed over, and figures after each chunk."""
    n, k = len(barcodes), len(next(iter(barcodes)))
    back, hits, passed, figures = {rc(b) for b in barcodes}, [], [], []
    counts, offsets, every, total = [0, 0], [Counter(), Counter()], set(), 0
    for c in range(0, len(pairs), chunk):
        counted, seen = set(), set()
        for i, (r1, r2) in enumerate(pairs[c : c + chunk], c):
            if r1 in seen or r2 in seen:
                passed.append(i)
                continue
            every |= {r1, r2}
            for at in range(len(r1) - k + 1):
                for mate, read in enumerate((r1, r2)):
                    kmer = read[at : at + k]
                    if kmer in counted:
                        break  # mate 2 isn't looked at behind a barcode of mate 1
                    for orient, known in (("forward", barcodes), ("reverse", back)):
                        if kmer in known:
                            hits.append((c // chunk, i, mate + 1, at, orient, kmer))
                            counts[mate] += 1
                            offsets[mate][at] += 1
                            seen.add(read)
                    if kmer in barcodes or kmer in back:
                        counted.add(kmer)
        total += len(counted)
        enough = min(counts) >= 5 * n or (len(every) >= 5 * n and total > 0) or total >= 5 * n
        tops = [x.most_common(2) for x in offsets]
        sure = all(len(t) == 1 for t in tops) or all(len(t) > 1 and t[0][1] >= 2 * t[1][1] for t in tops)
        figures.append((c // chunk, *counts, total, len(every), enough, enough and sure))
    return hits, passed, figures


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sampling_of_pairs_equals_a_loop(spark, seed):
    r = random.Random(seed)
    barcodes = sorted({"".join(r.choice("ACGT") for _ in range(4)) for _ in range(14)})[:10]
    barcodes[-1] = "ACGT"  # its own reverse complement
    read = lambda: "".join(r.choice("ACGT") for _ in range(r.choice([0, 3, 9, 14])))
    pairs = []
    for _ in range(160):
        b = r.choice(barcodes)
        pairs.append(r.choice([("TT" + b + "GA", "C" + rc(b) + "AA"), (read(), read()), (read(), "C" + rc(b) + "AA"), pairs[-1] if pairs else ("", "")]))
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row_idx long, r1 string, r2 string")
    library = spark.createDataFrame([(b,) for b in barcodes], "bc string")
    found = counting.pair_hits(table, library, 10, 4)
    hits, passed, figures = loop(pairs, set(barcodes), 10)
    assert sorted(tuple(x)[:6] for x in found.collect()) == sorted(hits)
    assert sorted(x.row_idx for x in counting.passed_over(table, found, 10).collect()) == passed
    assert sorted(map(tuple, counting.pair_sampling(table, found, 10).collect())) == figures
    first, second, used = counting.sample_pairs(table, library)
    until = next((f[0] for f in figures if f[-1]), figures[-1][0])
    for sampled, mate in ((first, 1), (second, 2)):
        own = Counter(h[3] for h in hits if h[0] <= until and h[2] == mate)
        assert sampled.chunks == until + 1 and own[sampled.offset] == max(own.values())
    assert used.count() == sum(h[0] <= until for h in hits)


@pytest.mark.parametrize("swapped", [False, True])
def test_counting_files_of_two_lanes(spark, tmp_path, swapped):
    """From files of two lanes and mates to counts; mates that don't face each other are warned of."""
    r = random.Random(6)
    barcodes = sorted({"".join(r.choice("ACGT") for _ in range(12)) for _ in range(20)})
    expected = Counter()
    for lane in (1, 2):
        out = {1: [], 2: []}
        for i in range(300):
            b = r.choice(barcodes)
            expected[b] += 1
            whole = "TTGACCTAGA" + b + "GTTTTAGAGC"
            out[2 if swapped else 1].append(f"@r{i}\n{whole}\n+\n{'I' * 32}\n")
            out[1 if swapped else 2].append(f"@r{i}\n{rc(whole)}\n+\n{'@' * 32}\n")
        for mate, rows in out.items():
            (tmp_path / f"L{lane}_R{mate}.fastq").write_text("".join(rows))
    library = spark.createDataFrame([(b,) for b in barcodes], "bc string")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        counts = flows.count_files(spark, str(tmp_path / "*_R1.fastq"), library, str(tmp_path / "*_R2.fastq"))
    assert {x.barcode: x["count"] for x in counts.collect()} == dict(expected) and all(x.documented for x in counts.collect())


def test_frames_are_read_back_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("%05d", "id").alias("r1"), F.when(F.col("id") % 7 > 0, F.format_string("m%05d", "id")).alias("r2"))
    folders = frames.write_frames(rows.repartition(7).orderBy("r1"), str(tmp_path / "out"))
    for folder, column in zip(folders, ("r1", "r2"), strict=True):
        frames.join_frames(folder, str(tmp_path / f"{column}.reads.zst"))
        text = pa.CompressedInputStream(pa.OSFile(str(tmp_path / f"{column}.reads.zst")), "zstd").read().decode()
        assert text.split("\n")[:-1] == [x[column] or "" for x in rows.orderBy("r1").collect()]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["r1.reads.zst", "r2.reads.zst"]
    broken = rows.select(F.when(F.col("r1") == "04000", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("r1")).alias("r1"))
    before = sorted(str(p) for p in (tmp_path / "out").rglob("*"))
    with pytest.raises(Exception, match="stop"):
        frames.write_frames(broken, str(tmp_path / "out"))
    assert sorted(str(p) for p in (tmp_path / "out").rglob("*")) == before


def test_distilling_files(spark, tmp_path):
    r = random.Random(2)
    reads = [("".join(r.choice("ACGT") for _ in range(6)), "".join(r.choice("AC") for _ in range(5))) for _ in range(400)]
    for mate in (0, 1):
        (tmp_path / f"R{mate + 1}.fastq").write_text("".join(f"@{i}\n{x[mate]}\n+\n{'I' * len(x[mate])}\n" for i, x in enumerate(reads)))
    folders = flows.distill_files(spark, [str(tmp_path / f"R{m}.fastq") for m in (1, 2)], str(tmp_path / "sorted"))
    found = []
    for folder in folders:
        frames.join_frames(folder, folder + ".one")
        found.append(pa.CompressedInputStream(pa.OSFile(folder + ".one"), "zstd").read().decode().split())
    assert list(zip(*found, strict=True)) == sorted(reads)
