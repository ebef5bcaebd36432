"""GenBank files as tables of chromosomes and features."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fastx import LARGE, from_files

SCHEMA = (
    "chr string, organism string, topology string, seq string, features "
    "array<struct<type string, locus_tag string, gene string, strand int, parts array<struct<start int, end int>>>>"
)
QUALIFIER = re.compile(r"/(\w+)(?:=(.*))?$")
SPAN = re.compile(r"<?(\d+)(?:(\.\.|\^)>?(\d+))?")
PIECE = re.compile(r"complement\(|\w*\(|\)|,|[^(),]+")


def location(text: str) -> tuple[int | None, list[tuple[int, int]]]:
    """Strand and 0-based half-open parts of a location; the strand is None if the parts lie on both.

    A place between two bases is an empty part; parts of other records have none here.
    """
    parts, strands, nested = [], set(), [1]
    for piece in PIECE.findall("".join(text.split())):
        if piece.endswith("("):
            nested.append(-nested[-1] if piece == "complement(" else nested[-1])
        elif piece == ")":
            nested.pop()
        elif found := SPAN.fullmatch(piece):
            first, between, last = found.groups()
            parts.append((int(first), int(first)) if between == "^" else (int(first) - 1, int(last or first)))
            strands.add(nested[-1])
    return strands.pop() if len(strands) == 1 else None, parts


def parse(source: Iterator[str]) -> Iterator[tuple]:
    """Rows of SCHEMA, one for each record."""
    for line in source:
        if line.startswith("LOCUS"):
            words = line.split()
            name, topology = words[1], "circular" if "circular" in words else "linear"
            organism, seq, features, state = "", [], [], ""
        elif line.startswith("VERSION") and len(line.split()) > 1:
            name = line.split()[1]
        elif line.startswith("  ORGANISM"):
            organism = line[12:].strip()
        elif line.startswith("FEATURES"):
            state = "features"
        elif line.startswith("ORIGIN"):
            state = "origin"
        elif line.startswith("//"):
            made = []
            for kind, place, notes in features:
                strand, parts = location(place)
                # the first of several qualifiers of one name counts
                found = {word: value.strip('"') for word, value in reversed(notes)}
                made.append((kind, found.get("locus_tag"), found.get("gene"), strand, parts))
            yield name, organism, topology, "".join(seq).upper(), made
        elif state == "origin":
            seq += line.split()[1:]
        elif state == "features" and line[5:6].strip():
            features.append([line[5:21].strip(), line[21:].strip(), []])
        elif state == "features" and features:
            text, notes = line[21:].strip(), features[-1][2]
            # within an open quotation a line never begins a qualifier; doubled quotes count as two
            quoted = notes and notes[-1][1].count('"') % 2
            if begun := None if quoted else QUALIFIER.match(text):
                notes.append([begun[1], begun[2] or ""])
            elif notes:
                notes[-1][1] += f" {text}"
            else:
                features[-1][1] += text


def read_genbank(spark: SparkSession, path: str, large: int = LARGE) -> DataFrame:
    """One row of SCHEMA for each record of the files under a path (S1, S2); gzip and zstd files are read too. Files of
    ``large`` bytes or more are streamed, a record at a time is held."""

    def rows(_: str, source: Iterator[str]) -> Iterator[tuple]:
        for chrom, organism, topology, seq, features in parse(source):
            named = [
                {"type": k, "locus_tag": t, "gene": g, "strand": s, "parts": [{"start": a, "end": b} for a, b in p]}
                for k, t, g, s, p in features
            ]
            yield chrom, organism, topology, seq, named

    return from_files(spark, path, rows, SCHEMA, ["chr", "organism", "topology", "seq", "features"], 1, large)


def chromosomes(records: DataFrame) -> DataFrame:
    """(chr, organism, seq, len, circular)."""
    return records.select("chr", "organism", "seq", F.length("seq").alias("len"), (F.col("topology") == "circular").alias("circular"))


def features(records: DataFrame, types: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(chr, locus_tag, gene, feature_start, feature_end, strand, type): one row for each part of a feature.

    Of a circle's feature with parts at its end and its beginning, these two are one range that ends beyond the length.
    """
    each = records.select("chr", (F.col("topology") == "circular").alias("ring"), F.length("seq").alias("len"), F.explode("features").alias("f"))
    each = each.where(F.col("f.type").isin(*types)).select("chr", "ring", "len", "f.*")
    ends = F.filter("parts", lambda p: p["end"] == F.col("len"))
    begins = F.filter("parts", lambda p: p["start"] == 0)
    across = F.col("ring") & (F.size("parts") > 1) & (F.size(ends) > 0) & (F.size(begins) > 0)
    whole = F.struct(F.element_at(ends, 1)["start"].alias("start"), (F.element_at(begins, 1)["end"] + F.col("len")).alias("end"))
    rest = F.filter("parts", lambda p: (p["end"] != F.col("len")) & (p["start"] != 0))
    joined = F.when(across, F.concat(rest, F.array(whole))).otherwise(F.col("parts"))
    out = each.select("chr", "locus_tag", "gene", F.explode(joined).alias("p"), "strand", "type")
    return out.select("chr", "locus_tag", "gene", F.col("p.start").alias("feature_start"), F.col("p.end").alias("feature_end"), "strand", "type")


def overhang(features: DataFrame, chrom: DataFrame, reach: int = 100_000) -> DataFrame:
    """Features, and on circles their copies one length further where these begin within the overhang."""
    rings = chrom.where("circular").select("chr", F.col("len").alias("_len"))
    again = features.join(rings, "chr").where(F.col("feature_start") < F.least(F.col("_len"), F.lit(reach)))
    shifted = again.withColumns({c: F.col(c) + F.col("_len") for c in ("feature_start", "feature_end")}).drop("_len")
    return features.unionByName(shifted.select(*features.columns))


def locus_names(features: DataFrame) -> DataFrame:
    """(locus_tag, gene): the first gene by place of each locus tag."""
    order = Window.partitionBy("locus_tag").orderBy("chr", "feature_start")
    return features.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("locus_tag", "gene")
