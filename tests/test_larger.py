"""What keeps work in proportion to its input: how often tables are read, and what is never expanded or written."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandwise import queries
from strandwise.functions import seq as S
from strandwise.operators import align, design, intervals, library, mapping, mismatch, report, scan, spacing


def plan(table):
    return table._jdf.queryExecution().optimizedPlan().toString()


def test_figures_read_chromosomes_once(spark):
    chrom = spark.createDataFrame([(1, "ACGT", 4, True), (2, "ACG", 3, False)], "chr int, seq string, len int, circular boolean")
    features = spark.createDataFrame([(1, "a"), (1, "b")], "chr int, locus_tag string")
    found = report.genome_figures(chrom, features)
    assert plan(found).count("LogicalRDD") == 2
    assert {tuple(x) for x in found.collect()} == {
        ("topology", "circular", 1), ("topology", "linear", 1), ("length", "4", 1), ("length", "3", 1), ("genes", "1", 2)
    }


def test_series_follow_from_a_guide_alone(spark):
    guides = ["ACGTTGCAACGTTGCAACGT", "GGGGGGGGGGGGGGGGGGGG", "TA", "acg"]
    found = mismatch.series(spark.createDataFrame([(g,) for g in guides], "spacer string"))
    assert "Generate" not in plan(found) and "collect_list" not in plan(found)
    w, expected = mismatch.WEIGHTS, {}
    for g in map(str.upper, guides):
        gc = sum(b in "GC" for b in g) / len(g)
        left = [(i, b, w["intercept"] + w[str(i)] + w[x + b] + w["GC_content"] * gc) for i, x in enumerate(g) for b in "ACGT" if b != x]
        for nth, score in enumerate(S.desired_scores(0.0, 1.0, 0.1)):
            if left:
                i, b, y = min(left, key=lambda v: (abs(v[2] - score), v[0], v[1]))
                left.remove((i, b, y))
                expected[g, nth] = (g[:i] + b + g[i + 1 :], f"{g[i]}{i + 1}{b}", y)
    assert {(x.original, x.nth): (x.variant, x.change_description, pytest.approx(x.y_pred)) for x in found.collect()} == expected


def test_lost_sites_are_not_written_whole(spark, monkeypatch):
    """A guide's many sites without a PAM come down to its spacer before the map is written."""
    genome = "".join(("ACGTTGCAACGTTGCAACTA" + "TTT") * 30)
    chrom = spark.createDataFrame([(1, genome, len(genome), False)], "chr int, seq string, len int, circular boolean")
    features = spark.createDataFrame([(1, "g", "", 0, 9, 1)], "chr int, locus_tag string, gene string, feature_start int, feature_end int, strand int")
    guides = spark.createDataFrame([("ACGTTGCAACGTTGCAACTA",)], "spacer string")
    kept, write = [], mapping.written
    monkeypatch.setattr(mapping, "written", lambda rows: kept.append(write(rows)) or kept[-1])
    rows = mapping.map_aligned(guides, align.align(guides, chrom, 20, 0, 3), chrom, features).collect()
    assert [x.note for x in rows] == ["non-targeting"]
    assert kept[0].count() == 30 and kept[0].where("target is not null or chr is not null or coords is not null").count() == 0


def _genomes(spark):
    """Lines and circles, repeats of a few words so that guides have many places, some of them at the ends of lines."""
    r, rows = random.Random(5), []
    words = ["ACGTTGCAACTG", "GATTACAGGCAT", "TTGGCCAAGGTC", "CCATGGACCTAA"]
    for c in range(24):
        seq = "".join(r.choice(words) for _ in range(r.choice((2, 3, 9, 40))))[r.randrange(5) :]
        rows.append((c, seq, len(seq), c % 3 == 0))
    rows.append((25, words[0] * 3 + "TATATCGCGTAT", 48, False))  # whose end is found nowhere else
    guides = sorted({s[i : i + 12] for _, s, n, _ in rows for i in (0, n - 12, n // 2) if len(s[i : i + 12]) == 12} | {"A" * 12, "C" * 12})
    genes = [(c, f"g{c}_{i}", "", i * 7, i * 7 + 30, 1 - 2 * (i % 2)) for c, _, n, _ in rows for i in range(n // 7)]
    chrom = spark.createDataFrame(rows, "chr int, seq string, len int, circular boolean")
    features = spark.createDataFrame(genes, "chr int, locus_tag string, gene string, feature_start int, feature_end int, strand int")
    return rows, spark.createDataFrame([(g,) for g in guides], "spacer string"), chrom, features


@pytest.mark.parametrize("direction", ["downstream", "upstream"])
def test_places_without_pam_do_not_leave_tiles(spark, monkeypatch, direction):
    """Aligned with a PAM: the places that have it, and no window without it on either strand goes on."""
    _, guides, chrom, _ = _genomes(spark)
    got = S.extract_pam("before", "after", "strand", direction)
    wanted = sorted(align.align(guides, chrom, 12, 1, 3).where(S.pam_matches("NGG", got) & ~got.contains("-")).collect())
    kept, near_windows = [], align.near_windows
    monkeypatch.setattr(align, "near_windows", lambda *a: kept.append(near_windows(*a)) or kept[-1])
    assert sorted(align.align(guides, chrom, 12, 1, 3, "NGG", direction).collect()) == wanted and wanted
    ahead, back = ("after", "before") if direction == "downstream" else ("before", "after")
    assert kept[0].where(~(F.col(ahead).rlike("^.GG") | F.col(back).rlike("^CC."))).count() == 0
    with pytest.raises(ValueError, match="a PAM of 3 bases"):
        align.align(guides, chrom, 12, 1, 3, "GG")


@pytest.mark.parametrize("direction", ["downstream", "upstream"])
@pytest.mark.parametrize("out_of_bounds", ["demote", "drop"])
def test_map_of_sites_with_pam_alone(spark, monkeypatch, direction, out_of_bounds):
    """The map is that of all alignments; sites without a PAM aren't written; what is together isn't shuffled again."""
    _, guides, chrom, features = _genomes(spark)
    how = {"direction": direction, "out_of_bounds": out_of_bounds}
    wanted = mapping.map_aligned(guides, align.align(guides, chrom, 12, 1, 3), chrom, features, "NGG", **how)
    kept, write = [], mapping.written
    monkeypatch.setattr(mapping, "written", lambda rows: kept.append((rows, write(rows))) or kept[-1][1])
    found = mapping.map_targets(guides, chrom, features, 12, "NGG", 1, **how)
    by = lambda rows: sorted(map(repr, rows.collect()))
    assert found.columns == wanted.columns and by(found) == by(wanted)
    sites = [table for _, table in kept if "pam" in table.columns]
    assert all(table.where("pam is null").count() == 0 for table in sites)
    joined = next(rows for rows, _ in kept if "_first" in rows.columns)
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # sites and genes


def test_dropped_guides_against_a_loop(spark):
    """A guide none of whose places has room for a PAM has no row; all others have one."""
    rows, guides, chrom, features = _genomes(spark)
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    inside, beyond = set(), set()
    for g in (x.spacer for x in guides.collect()):
        for _, seq, n, ring in rows:
            for i in range(n if ring else n - 11) if n >= 15 else ():
                w = (seq + seq)[i : i + 12] if ring else seq[i : i + 12]
                for strand, read in (("F", g), ("R", back(g))):
                    if sum(a != b for a, b in zip(w, read, strict=True)) <= 1:
                        room = ring or (i + 15 <= n if strand == "F" else i >= 3)
                        (inside if room else beyond).add(g)
    found = mapping.map_targets(guides, chrom, features, 12, "NGG", 1, out_of_bounds="drop")
    assert {x.spacer for x in found.collect()} == {x.spacer for x in guides.collect()} - (beyond - inside)
    assert beyond - inside and beyond & inside


def test_first_gene_is_a_combined_minimum(spark):
    """The first row of a guide is found without gathering or sorting its rows; a tag of null comes last."""
    _, guides, chrom, features = _genomes(spark)
    features = features.withColumn("locus_tag", F.when(F.col("feature_start") % 2 > 0, F.col("locus_tag"))).withColumn("type", F.lit("gene"))
    features = features.unionByName(features.where("feature_start = 14").withColumn("locus_tag", F.lit(None).cast("string")))
    source = chrom.where("chr % 4 > 0").selectExpr("chr", "'source' locus_tag", "'' gene", "0 feature_start", "len feature_end", "1 strand", "'source' type")
    found = align.align(guides, chrom, 12, 0, 3).select("spacer", "chr", "start", "end", "strand", "before", "after", "nm")
    own = library.GuideLibrary(found, features.unionByName(source), "NGG")
    best, key = {}, lambda x: tuple((x[c] is None, x[c]) if x[c] is not None else (True, "") for c in library.GuideLibrary.ORDER)
    targeted = {x.spacer for x in own.targets.where("type = 'source' and targeting").collect()}
    for x in own.targets.where("type = 'gene' and targeting").collect():
        if x.spacer in targeted and (x.spacer not in best or key(x) < key(best[x.spacer])):
            best[x.spacer] = x
    first = own.unambiguous()
    assert {x.spacer: key(x) for x in first.collect()} == {s: key(x) for s, x in best.items()} and best
    assert "Window" not in plan(first) and "Sort" not in plan(first)


@pytest.mark.parametrize("size", [7, 64, 65_536])
def test_pam_sites_from_tiles(spark, monkeypatch, size):
    """Places are chosen within tiles, and long runs over the edges of tiles as on the whole strand; sequences aren't shuffled again."""
    monkeypatch.setattr(scan, "LARGE", size)
    r = random.Random(3)
    seqs = ["".join(r.choice("ACGGGGN") for _ in range(n)) for n in (300, 90, 22, 5, 3, 2)] + ["G" * 200, "A" * 64 + "GG" * 40]
    chrom = spark.createDataFrame([(i, s, len(s), False) for i, s in enumerate(seqs)], "chr int, seq string, len int, circular boolean")
    for pam in ("NGG", "GGG"):
        expected = []
        for i, s in enumerate(seqs):
            for x in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))):
                expected += [(i, x[max(m.start() - 8, 0) : m.start()]) for m in re.finditer(pam.replace("N", "[ACGT]"), x)]
        found = scan.pam_sites(chrom, 8, pam)
        assert sorted((x.chr, x.spacer) for x in found.collect()) == sorted(expected)
    assert plan(found).count("MapInArrow") == 1  # spaced writes what comes from edges


def test_barcodes_are_looked_up_in_one_pass(spark, sf, monkeypatch):
    """Documents are read once; what is looked up is what the library has."""
    kept, write = [], queries.written
    monkeypatch.setattr(queries, "written", lambda rows: kept.append(write(rows)) or kept[-1])
    found = queries.QUERIES["sense_lookup"](spark, sf)
    assert [t.columns for t in kept] == [["chr", "bc"]] and "documents" not in plan(found) and "MapInArrow" not in plan(found)
    least = spark.table("library").agg(F.min("bc")).first()[0]
    assert least in {x.bc for x in found.collect()}


def _genes(spark):
    rows = [(c, f"g{c}_{k}", 37 * k % 9_000, 37 * k % 9_000 + 30 + k % 11 * 40) for c in (1, 2) for k in range(200)] + [(1, "long", 10, 9_990)]
    genes = spark.createDataFrame(rows, "chr int, locus_tag string, feature_start int, feature_end int")
    sites = genes.select("chr", F.col("locus_tag").alias("spacer"), F.col("feature_start").alias("tar_start"), (F.col("feature_start") + 1).alias("tar_end"))
    both = intervals.overlap_join(genes, sites, ("feature_start", "feature_end"), ("tar_start", "tar_end"), "left", keep="bin", parts=3).where("spacer != locus_tag")
    return both.select("chr", "bin", "locus_tag", "spacer", "tar_start", (F.col("tar_start") - F.col("feature_start")).alias("offset"), F.lit(20).alias("overlap"))


def test_candidates_of_a_gene_are_chosen_where_they_are(spark, monkeypatch):
    """Neither tiling nor ranking shuffles rows that are together; of short genes only what is chosen is written."""
    rows, within, kept = _genes(spark), ("chr", "bin"), []
    write = spacing.written
    monkeypatch.setattr(spacing, "written", lambda t: kept.append((t, write(t))) or kept[-1][1])
    physical = lambda t: t._jdf.queryExecution().executedPlan().toString()
    for width in (64, 1_000, 20_000):
        plain = {tuple(x) for x in design.tile_spacers(rows, 40, 20, width).collect()}
        assert {tuple(x) for x in design.tile_spacers(rows, 40, 20, width, within).collect()} == plain and plain
    assert physical(kept[-1][0]).count("Exchange hashpartitioning") == 2  # sites and genes
    assert kept[-1][1].selectExpr("sum(size(_items))").first()[0] < kept[-2][1].selectExpr("sum(size(_items))").first()[0]
    assert {tuple(x) for x in design.top_spacers(rows, 2, within).collect()} == {tuple(x) for x in design.top_spacers(rows, 2).collect()}
    top = design.head(rows, 2, within=within)
    assert physical(top).count("Exchange") == physical(rows).count("Exchange") and top.count() == design.head(rows, 2).count()


def test_sweep_takes_more_tasks_for_more_features(spark, monkeypatch):
    monkeypatch.setattr(intervals, "EDGED", 50)
    asked, run = [], intervals.running
    monkeypatch.setattr(intervals, "running", lambda *a, **k: asked.append(k["parts"]) or run(*a, **k))
    rows = [(1 + k % 2, k, k + 5 + k % 7) for k in range(0, 1_200, 3)]
    expected = {c: sum(sum(s <= x < e for o, s, e in rows if o == c) > 1 for x in range(1_300)) for c in (1, 2)}
    table = spark.createDataFrame(rows, "chr int, feature_start int, feature_end int")
    assert {x.chr: x.bases for x in intervals.ambiguous_coordinates(table).collect()} == {c: n for c, n in expected.items() if n}
    assert asked == [8]
