"""Scans of chromosomes for windows and guides.

Sequences are first cut into large and then into small tiles, each with the bases of the next that a window may reach;
large tiles are dealt out to all tasks, windows come from the small tiles.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .spacing import spaced, taken

LARGE, SMALL = 65_536, 1_024
DNA = np.frombuffer(b"ACGT", np.uint8)


def _padded(before: int, after: int) -> Column:
    """Sequence with ``before`` and ``after`` bases around it: its own on a circle (as often as it takes), dashes on a line."""
    seq = F.upper("seq")
    again = lambda n: F.repeat(seq, F.ceil(F.lit(n) / F.length(seq)).cast("int"))
    around = F.concat(F.right(again(before), F.lit(before)), seq, F.left(again(after), F.lit(after)))
    return F.when(F.col("circular"), around).otherwise(F.concat(F.lit("-" * before), seq, F.lit("-" * after)))


def tiled(chrom: DataFrame, least: int, longest: int, flank: int, sizes: tuple[int, ...] = (LARGE, SMALL)) -> DataFrame:
    """(chr, len, circular, _first, _bases, _ends): tiles as bytes, dealt out to all tasks, the place of each one's first
    window, and how many windows but one begin in it; windows of ``least`` bases or more begin in all of them. sizes: of the
    tiles, each of which is cut from one of the size before."""
    halo = longest + 2 * flank - 1
    last = F.when(F.col("circular"), F.col("len") - 1).otherwise(F.col("len") - least)
    # bytes: a piece of a string would be found by walking from its start
    long = chrom.where(F.col("len") >= least + flank).select(
        "chr", "len", "circular", last.alias("_last"), F.lit(0).alias("_first"), _padded(flank, halo - flank).cast("binary").alias("_bases")
    )
    for size in sizes:
        places = F.sequence(F.lit(0), F.greatest(F.octet_length("_bases") - 1 - halo, F.lit(0)), F.lit(size))
        piece = lambda at: F.struct(at.alias("at"), F.substring("_bases", at + 1, F.lit(size + halo)).alias("bases"))  # noqa: B023, E731
        tiles = long.select("chr", "len", "circular", "_last", "_first", F.explode(F.transform(places, piece)).alias("_t"))
        long = tiles.select("chr", "len", "circular", "_last", (F.col("_first") + F.col("_t.at")).alias("_first"), F.col("_t.bases").alias("_bases"))
        if size == LARGE:  # a chromosome's tiles are work for many tasks
            long = long.repartition(int(chrom.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chr", "_first")
    ends = F.least(F.octet_length("_bases") - 1 - halo, F.lit(sizes[-1] - 1), F.col("_last") - F.col("_first"))
    return long.select("chr", "len", "circular", "_first", "_bases", ends.alias("_ends")).where("_ends >= 0")


def windows(chrom: DataFrame, length: int | list[int], flank: int = 0) -> DataFrame:
    """(chr, len, circular, start, window, before, after): every window of a chromosome and the bases around it.

    chrom: (chr, seq, len, circular). length: one, or several, each of which gives windows of its own from the same tiles. Windows of
    a circle go on across its origin, those of a line end within it; bases before or after that lie off a line are
    dashes. A chromosome shorter than a window and its flanks has no windows.
    """
    sizes = [length] if isinstance(length, int) else sorted(set(length))
    long = tiled(chrom, sizes[0], sizes[-1], flank).withColumn("_at", F.explode(F.sequence(F.lit(0), "_ends")))
    slice_of = lambda first, n: F.substring("_bases", first, n).cast("string")
    start = (F.col("_first") + F.col("_at")).alias("start")
    if len(sizes) == 1:
        size = F.lit(sizes[0])
        out = long
    else:
        size = F.col("_size")
        out = long.withColumn("_size", F.explode(F.array(*map(F.lit, sizes))))
        out = out.where((F.col("len") >= size + flank) & (F.col("circular") | (F.col("_first") + F.col("_at") + size <= F.col("len"))))
    return out.select(
        "chr",
        "len",
        "circular",
        start,
        slice_of(F.col("_at") + flank + 1, size).alias("window"),
        slice_of(F.col("_at") + 1, F.lit(flank)).alias("before"),
        slice_of(F.col("_at") + flank + 1 + size, F.lit(flank)).alias("after"),
    )


def _has(first: Column, pattern: str) -> Column:
    """Whether the bytes of a tile from a place on have the bases of a pattern, N standing for any."""
    ok = F.lit(True)
    for run in re.finditer("[^N]+", pattern):
        ok = ok & (F.substring("_bases", first + run.start(), F.lit(len(run[0]))) == F.lit(run[0].encode()))
    return ok


def guide_sites(chrom: DataFrame, length: int, pam: str, direction: str = "downstream") -> DataFrame:
    """(chr, start, strand F or R, spacer, pam) of every place next to a PAM, overlaps included (G1).

    Upstream, the last len(pam) places of a linear strand aren't scanned. Spacers with other letters than G, A, T, C are
    left out.
    """
    k = len(pam)
    pams = F.array(
        F.struct(F.lit("F").alias("strand"), F.col("window").alias("spacer"), S.extract_pam("before", "after", F.lit("F"), direction).alias("pam")),
        F.struct(F.lit("R").alias("strand"), S.rev_comp("window").alias("spacer"), S.extract_pam("before", "after", F.lit("R"), direction).alias("pam")),
    )
    # the PAM's own bases, on either strand, are looked for among bytes before any text is cut
    tiles = tiled(chrom, length, length, k).withColumn("_at", F.explode(F.sequence(F.lit(0), "_ends")))
    reverse = "".join({"A": "T", "T": "A", "G": "C", "C": "G"}.get(b, "N") for b in reversed(pam.upper()))
    at_end, at_start = F.col("_at") + k + length + 1, F.col("_at") + 1
    ahead, back = (at_end, at_start) if direction == "downstream" else (at_start, at_end)
    near = _has(ahead, pam.upper()) | _has(back, reverse)
    slice_of = lambda first, n: F.substring("_bases", first, F.lit(n)).cast("string")
    found = tiles.where(near).select(
        "chr",
        "len",
        "circular",
        (F.col("_first") + F.col("_at")).alias("start"),
        slice_of(F.col("_at") + k + 1, length).alias("window"),
        slice_of(at_start, k).alias("before"),
        slice_of(at_end, k).alias("after"),
    )
    sites = found.where(S.is_dna("window")).select("chr", "len", "circular", "start", F.explode(pams).alias("s"))
    sites = sites.select("chr", "len", "circular", "start", "s.*").where(S.pam_matches(pam, "pam", "[ATGC]") & S.is_dna("pam"))
    if direction == "upstream":
        rest = F.when(F.col("strand") == "F", F.col("start") <= F.col("len") - length - k).otherwise(F.col("start") >= k)
        sites = sites.where(F.col("circular") | rest)
    return sites.select("chr", "start", "strand", "spacer", "pam")


def guides(chrom: DataFrame, length: int, pam: str, direction: str = "downstream") -> DataFrame:
    """Distinct spacers next to a PAM (AG7)."""
    return guide_sites(chrom, length, pam, direction).select("spacer").distinct()


def _chains(batches, length: int, pam: str):
    """From tiles of a strand that has ``length`` dashes before it: places of a PAM that don't overlap, and their spacers.

    Places closer than a PAM form chains, each of which is chosen from on its own. Of a chain that may go on in the tile before
    or behind, all places are given, with ``edge``.
    """
    k = len(pam)
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("chr", "strand", "len", "_first", "_bases", "_ends")]
        ends, text, named = [0], [], []
        for chr, strand, n, first, bases, last in zip(*columns, strict=True):
            raw = np.frombuffer(bases, np.uint8)
            ok = np.ones(last + 1, bool)
            for i, base in enumerate(pam):
                there = raw[length + i : length + i + last + 1]
                ok &= np.isin(there, DNA) if base == "N" else there == ord(base)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            begins = np.flatnonzero(np.diff(at, prepend=-k) >= k)
            edge = np.zeros(len(begins), bool)
            if first > 0:
                edge |= at[begins] < k
            if first + last < n - length - k:
                edge |= at[np.append(begins[1:], len(at)) - 1] > last - k
            chain = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
            kept = edge[chain]
            alone = np.diff(np.append(begins, len(at))) == 1
            kept[begins] = True
            for c in np.flatnonzero(~alone & ~edge):
                own = np.arange(begins[c], begins[c + 1] if c + 1 < len(begins) else len(at))
                kept[own[taken(at[own], int(at[own[0]]), k)]] = True
            edges, at = edge[chain][kept], at[kept]
            named.append((chr, strand, first + at, edges))
            short = np.minimum(first + at, length)
            cut = np.arange(length) >= length - short[:, None]
            text.append(raw[at[:, None] + np.arange(length)][cut])
            ends.extend((ends[-1] + np.cumsum(short)).tolist())
        whole = np.concatenate(text) if text else np.zeros(0, np.uint8)
        spacers = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.array(ends, np.int64)), pa.py_buffer(whole)).cast(pa.string())
        numbers = np.repeat(np.arange(len(named)), [len(x[2]) for x in named])
        many = lambda i, kind: pa.array([x[i] for x in named], kind).take(pa.array(numbers))  # noqa: B023, E731
        joined = lambda i, kind: np.concatenate([x[i] for x in named] or [np.zeros(0, kind)]).astype(kind)  # noqa: B023, E731
        made = [many(0, batch.schema.field("chr").type), many(1, pa.string()), pa.array(joined(2, np.int64)), pa.array(joined(3, bool)), spacers]
        yield pa.RecordBatch.from_arrays(made, ["chr", "strand", "at", "edge", "spacer"])


def pam_sites(chrom: DataFrame, length: int, pam: str) -> DataFrame:
    """(chr, spacer) in front of PAMs that don't overlap each other, from left to right on each strand; spacers at an end
    may be shorter, repeated ones stay (G2).

    Places and the spacers before them are found and chosen tile by tile; places at the edges of tiles, of which only long
    chromosomes have some, are chosen in stretches (see ``spaced``).
    """
    both = F.array(F.struct(F.lit("F").alias("strand"), F.upper("seq").alias("s")), F.struct(F.lit("R").alias("strand"), S.rev_comp(F.upper("seq")).alias("s")))
    k, size = len(pam), length + len(pam)
    kind = chrom.schema["chr"].dataType.simpleString()

    def found(chrom: DataFrame) -> DataFrame:
        strands = chrom.select("chr", F.explode(both).alias("x")).select("chr", "x.*")
        lines = strands.select(
            F.struct("chr", "strand").alias("chr"), F.concat(F.lit("-" * length), "s").alias("seq"), (F.length("s") + length).alias("len"), F.lit(False).alias("circular")
        )
        tiles = tiled(lines, size, size, 0, (LARGE,)).select("chr.chr", "chr.strand", "len", "_first", "_bases", "_ends")
        return tiles.mapInArrow(lambda batches: _chains(batches, length, pam.upper()), f"chr {kind}, strand string, at bigint, edge boolean, spacer string")

    edges = found(chrom.where(F.length("seq") + length > LARGE)).where("edge").select("chr", "strand", "at", "spacer")
    chosen = spaced(edges, ["chr", "strand"], k)
    return found(chrom).where("not edge").select("chr", "spacer").unionByName(chosen.select("chr", "spacer"))
