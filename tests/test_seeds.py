"""The stored index of seeds against a loop."""

import random

import pytest

from strandwise.operators import align, seeds

TURN = str.maketrans("ACGT", "TGCA")


@pytest.mark.parametrize("mismatches, length", [(0, 9), (2, 20), (3, 20), (3, 13)])
def test_index_equals_a_loop(spark, mismatches, length):
    r = random.Random(length)
    seqs = {1: ("".join(r.choice("ACGT") for _ in range(1500)), True), 2: ("".join(r.choice("ACGTN") for _ in range(400)), False), 3: ("ACGTACRT" * 20, True)}
    chrom = spark.createDataFrame([(c, s, len(s), ring) for c, (s, ring) in seqs.items()], "chr long, seq string, len int, circular boolean")
    s = seqs[1][0] * 2
    guides = {s[a : a + length] for a in (0, 700, 1490)} | {("ACGT" * 9)[:length]}
    for g in list(guides):
        changed = list(g)
        for k in r.sample(range(length), min(3, mismatches)):
            changed[k] = r.choice("ACGT")
        guides.add("".join(changed))
    expected = set()
    for c, (s, ring) in seqs.items():
        around = s * 3 if ring else "--" + s + "--"
        for at in range(len(s) if ring else len(s) - length + 1):
            k = at + (len(s) if ring else 2)
            w = around[k : k + length]
            for g in guides:
                for strand, read in (("F", g), ("R", g.translate(TURN)[::-1])):
                    nm = sum(x != y for x, y in zip(w, read))
                    if nm <= mismatches:
                        expected.add((g, c, at, strand, nm, w, around[k - 2 : k], around[k + length : k + length + 2]))
    table = spark.createDataFrame([(g,) for g in guides], "spacer string")
    index = seeds.build_index(chrom, length, mismatches, 2, 5)
    found = seeds.align_to_index(table, index)
    rows = [(x.spacer, x.chr, x.start, x.strand, x.nm, x.target, x.before, x.after) for x in found.collect()]
    iupac = str.maketrans(align.S.IUPAC, align.S.IUPAC_COMPLEMENT)
    assert len(rows) == len(expected)
    assert {(g, c, at, d, nm, w if d == "F" else w.translate(iupac)[::-1], b, a) for g, c, at, d, nm, w, b, a in expected} == set(rows)
    # used again, for fewer mismatches; guides come to the buckets, the index stays where it is
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = seeds.align_to_index(table, index, 0)
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == 1 and "Bucketed: true" in plan
        assert again.count() == sum(x[4] == 0 for x in expected)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    with pytest.raises(Exception, match="guides must have"):
        seeds.align_to_index(spark.createDataFrame([("N" * length,)], "spacer string"), index).collect()
    index.drop(spark)
    assert not spark.catalog.tableExists(index.table)


def test_bounds(spark):
    chrom = spark.createDataFrame([(1, "ACGT", 4, False)], "chr long, seq string, len int, circular boolean")
    for length, mismatches in ((64, 1), (4, 3), (0, 0)):
        with pytest.raises(ValueError):
            seeds.build_index(chrom, length, mismatches)
