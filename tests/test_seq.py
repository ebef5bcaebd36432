"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strandwise.functions import seq as S
from strandwise.operators import mismatch

ACGT = "ACGT" * 5
LIT = F.lit


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()[0]


def cases():
    return [
        (S.rev_comp(LIT("ACGTN")), "NACGT"),
        (S.rev_comp(LIT("TGCAacgtRY")), "YRtgcaTGCA"),
        (S.rev_comp_iupac(LIT("ACGTacgtRYKM")), "KMRYacgtACGT"),
        (S.safe_len(LIT(None).cast("string")), 0),
        (S.kmers(LIT("AAAT"), 2), ["AA", "AT"]),
        (S.kmers(LIT("A"), 2), []),
        (S.is_dna(LIT("")), True),
        (S.is_dna(LIT("ACGN")), False),
        (S.gc_content(LIT("GGAT")), 0.5),
        (S.gc_content(LIT("")), None),
        (S.diff(LIT("ACCA"), LIT("ACGT")), "G3C,T4A"),
        (S.diff(LIT("ACGT"), LIT("ACGT")), None),
        (S.diff(LIT("AC"), LIT("AGTT")), "G2C"),
        (S.coords(LIT(10), LIT(30), LIT(100)), "10..30"),
        (S.coords(LIT(-5), LIT(15), LIT(100)), "(95..100, 0..15)"),
        (S.coords(LIT(-20), LIT(0), LIT(100)), "80..100"),
        (S.normal_start(LIT(80), LIT(100), LIT(100)), -20),
        (S.normal_end(LIT(100), LIT(100)), 0),
        (S.normal_start(LIT(95), LIT(115), LIT(100)), -5),
        (S.offset(LIT("F"), LIT(10), LIT(30), LIT(5), LIT(100)), 5),
        (S.offset(LIT("R"), LIT(10), LIT(30), LIT(5), LIT(100)), 70),
        (S.overlap(LIT(10), LIT(30), LIT(25), LIT(40)), 5),
        (S.overlap(LIT(10), LIT(30), LIT(30), LIT(40)), 0),
        (S.pam_matches("NGG", LIT("AGG")), True),
        (S.pam_matches("NGG", LIT("AGA")), False),
        (S.pam_matches("NGG", LIT(None).cast("string")), False),
        (S.pam_matches("NGG", LIT("")), False),
        (S.pam_matches("NNN", LIT("XYZ")), True),
        (S.extract_pam(LIT("CCA"), LIT("TGG"), LIT("F")), "TGG"),
        (S.extract_pam(LIT("CCA"), LIT("TGG"), LIT("R")), "TGG"),
        (S.extract_pam(LIT("AAC"), LIT("TGG"), LIT("F"), "upstream"), "AAC"),
        (S.insertion_site(LIT("F"), LIT(40), LIT(60), LIT(100)), 9),
        (S.insertion_site(LIT("R"), LIT(10), LIT(30), LIT(100)), 61),
        (S.note(LIT(1), LIT(2), LIT(0)), "1 site, 2 genes"),
        (S.note(LIT(3), LIT(0), LIT(3)), "3 sites, 3 intergenic"),
        (S.note(LIT(0), LIT(0), LIT(0)), "non-targeting"),
        (S.note_count(LIT("3 sites, 2 genes"), "gene"), 2),
        (S.note_count(LIT("non-targeting"), "site"), 0),
        (S.gene_name(LIT(""), LIT("b1")), "b1"),
        (S.parse_strand(LIT(" Fwd ")), "F"),
        (S.strand_sign(LIT(None).cast("int")), "."),
        (S.flanked(LIT("AA"), LIT("C"), LIT(None).cast("string")), "AAC"),
        (S.hamming(LIT("ACGT"), LIT("AGGA")), 2),
    ]


def test_values(spark):
    columns, expected = zip(*cases(), strict=True)
    found = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    assert list(found) == list(expected)


@pytest.mark.parametrize(
    ("variant", "expected"),
    [("C" + ACGT[1:], 1.0647542525), (ACGT[:19] + "G", 0.3032736615), (ACGT, None), (ACGT[:5], None)],
)
def test_y_pred(value, variant, expected):
    found = value(S.y_pred(LIT(ACGT), LIT(variant), S.weights_map(mismatch.WEIGHTS)))
    assert found == (expected if expected is None else pytest.approx(expected))


def test_unknown_strand_and_weight_are_errors(value):
    with pytest.raises(Exception, match="unknown strand"):
        value(S.parse_strand(LIT("x")))
    with pytest.raises(Exception, match="no weight"):
        value(S.y_pred(LIT("N" + ACGT[1:]), LIT(ACGT), S.weights_map(mismatch.WEIGHTS)))


def test_series_takes_the_nearest_left(spark):
    rows = mismatch.series(spark.createDataFrame([(ACGT,)], "spacer string")).orderBy("nth").collect()
    said = [(r.change_description, round(r.y_pred, 4)) for r in rows]
    expected = "G19C .2197, T20A .2643, G19T .2746, T20G .3033, C18A .4104, G15A .4561, C18T .6009, A13C .7029, G3T .8000, A9C .9013, C2G 1.0107"
    assert said == [(x.split()[0], pytest.approx(float(x.split()[1]), abs=6e-5)) for x in expected.split(", ")]
