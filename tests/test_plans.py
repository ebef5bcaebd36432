"""Plans that hold at any size: what may not be broadcast, and keys that need no subquery."""

from __future__ import annotations

from strandwise.llm import pii, simhash
from strandwise.operators import align
from strandwise import queries as core
from strandwise.functions import seq as S
from strandwise.plans import fixtures
from strandwise.sources import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_features_need_no_subquery_and_no_broadcast(spark, sf):
    """A subquery in a key may not have finished where its side is broadcast; line items are estimated too low for it."""
    plan = plan_of(fixtures.view(spark, sf, "feature"))
    assert "ubquery" not in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def few(spark):
    """Two guides and the chromosomes that they lie in, one of them at an end without room for a PAM."""
    guides = [("ACGTTGCAAGCTTGACCATG",), ("TTGACCATGGGACGTTGCAA",)]
    chrom = [(0, "G" * 90 + guides[0][0] + "TGG" + "C" * 90, 203, False), (1, "C" * 180 + guides[1][0], 200, False)]
    return spark.createDataFrame(guides, "spacer string"), spark.createDataFrame(chrom, "chr long, seq string, len int, circular boolean")


def test_keys_of_windows_and_guides_are_not_broadcast(spark):
    """Texts are multiplied by their keys within a task, which Spark's estimate of their size leaves out."""
    guides, chrom = few(spark)
    found = align.align(guides, chrom, 20, 1, 3)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert sorted((r.spacer, r.chr, r.start, r.strand, r.nm) for r in found.collect()) == [(guides.first()[0], 0, 90, "F", 0), ("TTGACCATGGGACGTTGCAA", 1, 180, "F", 0)]


def test_places_beyond_ends_are_not_found_by_broadcast(spark):
    """The guides that promoter_map and insertion_map drop are found among windows at ends, by the same keys."""
    guides, chrom = few(spark)
    found = align.beyond_ends(guides, chrom, [20], 1, 3)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert [r.spacer for r in found.collect()] == ["TTGACCATGGGACGTTGCAA"]


def test_fingerprints_and_their_links_are_not_broadcast(spark):
    """Each fingerprint has a row for each of 35 tables, which Spark's estimate of their size leaves out."""
    fps = spark.createDataFrame([(0, 1), (1, 3), (2, -1)], "doc_id long, fp long")
    found = simhash.links(fps)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 3)]
    docs = spark.createDataFrame([(0, "a b c d e"), (1, "A B C D E"), (2, "x")], "doc_id long, text string")
    assert "BroadcastHashJoin" not in plan_of(simhash.near_duplicates(docs)) + plan_of(simhash.keep_one(docs))


def test_surrogates_of_a_text_are_not_broadcast(spark):
    docs = spark.createDataFrame([(0, "Mail ana@example.com or ana@example.com"), (1, "nothing")], "doc_id long, text string")
    found = pii.replace(docs)
    assert {r.doc_id: r.n_entities for r in found.collect()} == {0: 2, 1: 0}
    run = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in run and "BroadcastHashJoin" not in run


def test_alignments_written_as_text_have_their_pam(spark, sf, monkeypatch):
    """The map of SAM text shows places with a PAM only: others, of which there are very many, aren't written, guides without any are."""
    kept, write_sam = [], tables.write_sam
    monkeypatch.setattr(tables, "write_sam", lambda rows, path: kept.append(rows) or write_sam(rows, path))
    mapped = {(r.spacer, r.target is None) for r in core.QUERIES["sam_target_map"](spark, sf).collect()}
    there = kept[0].where("target is not null")
    assert there.count() and there.where(~S.pam_matches("NGG", S.extract_pam("before", "after", "strand"))).count() == 0
    assert {(r.spacer, r.target is None) for r in kept[0].select("spacer", "target").collect()} == mapped
