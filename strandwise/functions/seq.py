"""Functions from columns to columns over DNA text; positions are 0-based and half-open unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC alphabet.
IUPAC, IUPAC_COMPLEMENT = "ACGTURYKMBDHVSWNacgturykmbdhvswn", "TGCAAYRMKVHDBSWNtgcaayrmkvhdbswn"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rev_comp(s: Column | str) -> Column:
    """Reverse complement of upper-case bases and N; other characters stay (F1)."""
    return F.reverse(F.translate(_col(s), "ATCGN", "TAGCN"))


def rev_comp_iupac(s: Column | str) -> Column:
    """Reverse complement that knows all IUPAC codes in either case (F2)."""
    return F.reverse(F.translate(_col(s), IUPAC, IUPAC_COMPLEMENT))


def safe_len(s: Column | str) -> Column:
    """Length, null as 0."""
    return F.coalesce(F.length(_col(s)), F.lit(0))


def kmers(s: Column | str, k: int) -> Column:
    """Distinct k-mers as an array; none for shorter strings."""
    s = _col(s)
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def is_dna(s: Column | str) -> Column:
    """Whether all characters are G, A, T or C; true for an empty string."""
    return _col(s).rlike(r"\A[GATC]*\z")


def gc_content(s: Column | str) -> Column:
    """Share of G and C; null for an empty string."""
    s = _col(s)
    return F.try_divide((F.length(s) - F.length(F.translate(s, "GC", ""))).cast("double"), F.length(s).cast("double"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of places that differ, over the shorter length."""
    a, b = _col(a), _col(b)
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    differ = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(a == b, 0).otherwise(differ)


def diff(spacer: Column | str, target: Column | str) -> Column:
    """Differences as target base, 1-based place and spacer base, joined by commas; null if there are none."""
    spacer, target = _col(spacer), _col(target)
    at = lambda s, i: F.substring(s, i, F.lit(1))
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(spacer), F.length(target)), F.lit(1)))
    found = F.filter(places, lambda i: at(spacer, i) != at(target, i))
    text = F.array_join(F.transform(found, lambda i: F.concat(at(target, i), i.cast("string"), at(spacer, i))), ",")
    return F.when(F.length(text) > 0, text)


def coords(start: Column | str, end: Column | str, length: Column | str) -> Column:
    """``start..end``, or both parts in parentheses for a range across the origin (F8)."""
    start, end, length = _col(start), _col(end), _col(length)
    s, e = F.pmod(start, length), F.pmod(end, length)
    text = lambda x: x.cast("string")
    shown = F.when(e == 0, length).otherwise(e)
    wrapped = F.concat(F.lit("("), text(s), F.lit(".."), text(length), F.lit(", 0.."), text(e), F.lit(")"))
    return F.when(s > shown, wrapped).otherwise(F.concat(text(s), F.lit(".."), text(shown)))


def offset(direction, tar_start, tar_end, feature_start, feature_end) -> Column:
    """Distance from the feature's beginning in its direction F or R, else null."""
    forward = _col(tar_start) - _col(feature_start)
    return F.when(_col(direction) == "F", forward).when(_col(direction) == "R", _col(feature_end) - _col(tar_end))


def overlap(a_start, a_end, b_start, b_end) -> Column:
    """Common length of two ranges."""
    return F.greatest(F.lit(0), F.least(_col(a_end), _col(b_end)) - F.greatest(_col(a_start), _col(b_start)))


def pam_pattern(pam: str, any_base: str = ".") -> str:
    """Regular expression of a PAM, N standing for any base."""
    return pam.upper().replace("N", any_base)


def pam_matches(pam: str, found: Column | str, any_base: str = ".", anywhere: bool = False) -> Column:
    """Whether a PAM begins with the pattern (F11), or has it anywhere (F12); false for null and empty, true for a pattern of N
    alone."""
    found = _col(found)
    begin = "" if anywhere else r"\A"
    ok = F.lit(True) if set(pam.upper()) <= {"N"} else found.rlike(rf"{begin}(?:{pam_pattern(pam, any_base)})")
    return F.coalesce((F.length(found) > 0) & ok, F.lit(False))


def extract_pam(before, after, strand, direction: str = "downstream") -> Column:
    """PAM of a site on strand F or R from the bases before and after it on the forward strand."""
    before, after, forward = _col(before), _col(after), _col(strand) == "F"
    if direction == "upstream":
        before, after = after, before
    return F.when(forward, F.upper(after)).otherwise(rev_comp_iupac(F.upper(before)))


def oriented(s: Column | str, strand: Column | str) -> Column:
    """A forward-strand slice as read on its strand."""
    return F.when(_col(strand) == "R", rev_comp_iupac(s)).otherwise(_col(s))


def normal_start(start: Column | str, end: Column | str, length: Column | str) -> Column:
    """Start within the chromosome, negative for a range across the origin."""
    s, e = F.pmod(_col(start), _col(length)), F.pmod(_col(end), _col(length))
    return F.when(e < s, s - _col(length)).otherwise(s)


def normal_end(end: Column | str, length: Column | str) -> Column:
    """End within the chromosome; the chromosome's own end is 0."""
    return F.pmod(_col(end), _col(length))


def insertion_site(strand, tar_start, tar_end, length) -> Column:
    """Place of an insertion 49 bases on from a target."""
    ahead = F.pmod(_col(tar_end) + 49, _col(length))
    return F.when(_col(strand) == "F", ahead).otherwise(F.pmod(_col(tar_start) - 49, _col(length)))


def gene_name(gene: Column | str, locus_tag: Column | str) -> Column:
    """The gene, or the locus tag where the gene is null or empty."""
    return F.coalesce(F.nullif(_col(gene), F.lit("")), _col(locus_tag))


def note(sites: Column | str, genes: Column | str, intergenic: Column | str, place: str = "", idle: str = "non-targeting") -> Column:
    """Summary of a guide's targets."""
    said = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))
    sites, genes, intergenic = _col(sites), _col(genes), _col(intergenic)
    parts = [
        said(sites, "site"),
        F.when(genes > 0, F.concat(said(genes, "gene"), F.lit(place))),
        F.when(intergenic > 0, F.concat(intergenic.cast("string"), F.lit(" intergenic"))),
    ]
    return F.when(sites == 0, idle).otherwise(F.concat_ws(", ", *parts))


def note_count(text: Column | str, what: str) -> Column:
    """Number before site, gene or intergenic in a note, 0 if there is none."""
    return F.coalesce(F.regexp_extract(_col(text), rf"(\d+) {what}", 1).try_cast("int"), F.lit(0))


def strand_letter(strand: Column | str) -> Column:
    """F or R from 1 or -1, else null."""
    return F.when(_col(strand) == 1, "F").when(_col(strand) == -1, "R")


def strand_sign(strand: Column | str) -> Column:
    """+ or - from 1 or -1, else a dot."""
    return F.when(_col(strand) == 1, "+").when(_col(strand) == -1, "-").otherwise(".")


def parse_strand(strand: Column | str) -> Column:
    """F or R from the usual spellings; an error for any other."""
    s = F.lower(F.trim(_col(strand).cast("string")))
    forward, back = s.isin("+", "1", "+1", "fwd", "forward"), s.isin("-", "-1", "rev", "reverse")
    return F.when(forward, "F").when(back, "R").when(s.isNull(), None).otherwise(
        F.raise_error(F.concat(F.lit("unknown strand: "), s)).cast("string")
    )


def flanked(left: Column | str, barcode: Column | str, right: Column | str) -> Column:
    """A barcode between its flanks, null as empty (F32)."""
    return F.concat(*(F.coalesce(_col(x), F.lit("")) for x in (left, barcode, right)))


def desired_scores(low: float, high: float, step: float) -> list[float]:
    """Evenly spaced scores from low to below high + step."""
    import math

    return [low + i * step for i in range(max(0, math.ceil((high + step - low) / step)))]


def y_pred(original: Column | str, variant: Column | str, weights: Column) -> Column:
    """Predicted efficacy of a variant by a linear model over place, substitution and GC content.

    weights: a map from feature to weight. Null if either is null, both are equal or lengths differ; an error where a
    place or substitution has no weight.
    """
    a, b = _col(original), _col(variant)
    char = lambda s, i: F.substring(s, i + 1, F.lit(1))
    known = lambda k: F.coalesce(F.element_at(weights, k), F.raise_error(F.concat(F.lit("no weight: "), k)).cast("double"))

    def add(total: Column, i: Column) -> Column:
        x, y = char(a, i), char(b, i)
        return F.when(x != y, total + known(i.cast("string")) + known(F.concat(x, y))).otherwise(total)

    places = F.sequence(F.lit(0), F.greatest(F.length(a) - 1, F.lit(0)))
    total = F.aggregate(places, known(F.lit("intercept")), add) + known(F.lit("GC_content")) * gc_content(a)
    return F.when((a != b) & (F.length(a) == F.length(b)), total)


def weights_map(weights: dict[str, float]) -> Column:
    """Model weights as a map column."""
    return F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))




def four_decimals(value: str | Column) -> Column:
    """A number as text of four decimals, rounded from its exact binary value; null stays null.

    Spark's own formats round the shortest decimal form instead, which differs on some ties; batches go through Arrow.
    """

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else f"{x:.4f}")

    return shown(F.col(value) if isinstance(value, str) else value)
