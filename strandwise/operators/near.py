"""Windows of chromosomes that may lie near a guide, found before anything is shuffled.

A text with v mismatches, cut into v + 5 blocks, equals its guide in all blocks but some v. For each choice of v blocks the
others are hashed to a key, and guides set a few bits for each of theirs in one word of a bitmap. The bitmap has a bounded size
and is broadcast; only windows of which some key's bits are set go on. None that matches is lost: a full bitmap, like a hash
that two texts share, only lets more of them through, and what goes on is compared with guides base by base.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import LARGE, tiled

#: Bits of a bitmap for each key, as a power of two; words of 64 bits that it has at least and at most, likewise (128 MB).
BITS, LEAST, MOST = 5, 8, 24
#: Places hashed at once, so that arrays stay in a core's cache, and rows of one Arrow batch of windows.
STEP, BATCH = 32_768, 50_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def spans_of(length: int, blocks: int) -> list[tuple[int, int]]:
    """Where the blocks of a text begin and end."""
    edges = [length * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def choices(length: int, mismatches: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """The blocks of a text, and the choices of blocks that may differ."""
    blocks = min(length, mismatches + 5) if mismatches else 1
    return spans_of(length, blocks), list(combinations(range(blocks), min(mismatches, blocks)))


def _fixed(i: int) -> np.uint64:
    """An odd number for each i, the same on all machines."""
    x = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return np.uint64((x ^ x >> 31) | 1)


def rolling(text: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` (1 or more) values from each place on, put together from hashes of doubling lengths."""
    out, done, each, n, power = None, 0, text, 1, BASE
    while True:
        if length & n:
            if out is None:
                out = each
            else:
                tail = each[done:]
                out = out[: len(tail)] * power + tail[: len(out)]
            done += n
        if done == length:
            return out
        each = each[:-n] * power + each[n:]
        n, power = 2 * n, power * power


def keys(text: np.ndarray, length: int, mismatches: int):
    """For each choice of blocks: the keys of the texts of ``length`` bytes that begin at each place."""
    spans, left_out = choices(length, mismatches)
    count = len(text) - length + 1
    with np.errstate(over="ignore"):
        values = text.astype(np.uint64)
        rolled = {n: rolling(values, n) for n in {b - a for a, b in spans}}
        terms = [rolled[b - a][a : a + count] * _fixed(i) for i, (a, b) in enumerate(spans)]
        total = sum(terms[1:], terms[0])
        for i, out in enumerate(left_out):
            key = total + _fixed(length * 4_096 + i)
            for block in out:
                key -= terms[block]
            key ^= key >> np.uint64(32)
            key *= MIX
            key ^= key >> np.uint64(29)
            yield key


def _bits(key: np.ndarray) -> np.ndarray:
    """The bits of a word that a key sets, six or fewer."""
    out = np.zeros(len(key), np.uint64)
    for shift in range(0, 36, 6):
        out |= np.uint64(1) << (key >> np.uint64(shift) & np.uint64(63))
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts one after another, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _strings(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix of bytes as texts."""
    n, width = matrix.shape
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix)))


def keyed(texts: DataFrame, column: str, mismatches: int, said=None) -> DataFrame:
    """Adds ``_block`` (the number of a choice of blocks) and ``_key``: a row for each choice. said: a broadcast bitmap, if only
    keys that have their bits set in it are wanted."""

    def each(batches):
        for batch in batches:
            raw, at = _texts(batch[column])
            sizes = np.diff(at)
            for n in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == n)
                own = batch.take(pa.array(rows))
                whole = raw[at[rows][:, None] + np.arange(n)].reshape(-1)
                for block, key in enumerate(keys(whole, int(n), mismatches)):
                    key, some = key[:: int(n)], own
                    if said is not None:
                        there = there_in(key, said.value)
                        key, some = key[there], own.take(pa.array(there))
                    made = [pa.array(np.full(len(key), block, np.int32)), pa.array(np.ascontiguousarray(key).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*some.columns, *made], [*own.schema.names, "_block", "_key"])

    fields = [*texts.schema.fields, T.StructField("_block", T.IntegerType()), T.StructField("_key", T.LongType())]
    return texts.mapInArrow(each, T.StructType(fields))


def bitmap(reads: DataFrame, mismatches: int, sizes: list[int]) -> np.ndarray:
    """Words of 64 bits, a power of two of them, with the bits of all keys of the column ``read``."""
    per = max(len(choices(n, mismatches)[1]) for n in sizes)
    power = min(MOST, max(LEAST, (reads.count() * per).bit_length() + BITS - 6))

    def words(batches):
        for batch in batches:
            key = batch["_key"].to_numpy(zero_copy_only=False).view(np.uint64)
            word = (key >> np.uint64(64 - power)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(_bits(key).view(np.int64))], ["word", "bits"])

    found = keyed(reads.select("read"), "read", mismatches).select("_key").mapInArrow(words, "word bigint, bits bigint")
    found = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << power, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def there_in(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where the keys are that have their bits set."""
    word = words[(key >> np.uint64(64 - (len(words).bit_length() - 1))).astype(np.int64)]
    at = np.flatnonzero(word >> (key & np.uint64(63)) & np.uint64(1))
    bits = _bits(key[at])
    return at[word[at] & bits == bits]


def near(raw: np.ndarray, length: int, mismatches: int, words: np.ndarray) -> np.ndarray:
    """Places of texts of ``length`` bytes of which some key has its bits set."""
    found = []
    for begin in range(0, len(raw) - length + 1, STEP):
        part = raw[begin : begin + STEP + length - 1]
        hit = np.zeros(len(part) - length + 1, bool)
        for key in keys(part, length, mismatches):
            hit[there_in(key, words)] = True
        found.append(np.flatnonzero(hit) + begin)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _reads_there(raw: np.ndarray, place: np.ndarray, pattern: str) -> np.ndarray:
    """Whether the bytes from each place on have the bases of a pattern, other letters than those of bases standing for any."""
    ok = np.ones(len(place), bool)
    for i, base in enumerate(pattern):
        if base in "ACGT":
            ok &= raw[place + i] == ord(base)
    return ok


def near_windows(
    chrom: DataFrame, reads: DataFrame, sizes: list[int], mismatches: int = 0, flank: int = 0, pam: str | None = None, direction: str = "downstream", said=None
) -> DataFrame:
    """(chr, len, start, window, before, after): of the windows of ``sizes`` bases, as ``scan.windows`` has them, all that lie
    within ``mismatches`` of a text of the column ``read``, and a few others. pam (``flank`` bases): only windows that have it on
    either strand. said: the broadcast bitmap of ``read``, if there is one already."""
    if pam is not None:
        if len(pam) != flank:
            raise ValueError(f"a PAM of {flank} bases is looked for: {pam}")
        ahead, back = pam.upper(), pam.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
    said = said or chrom.sparkSession.sparkContext.broadcast(bitmap(reads, mismatches, sizes))
    tiles = tiled(chrom, sizes[0], sizes[-1], flank, (LARGE,))

    def each(batches):
        words = said.value
        for batch in batches:
            raw, at = _texts(batch["_bases"])
            first, ends, lens = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_first", "_ends", "len"))
            ring = batch["circular"].to_numpy(zero_copy_only=False).astype(bool)
            for n in sizes:
                place = near(raw, n, mismatches, words)
                tile = np.searchsorted(at, place, "right") - 1
                within = place - at[tile] - flank
                start = first[tile] + within
                ok = (within >= 0) & (within <= ends[tile]) & (lens[tile] >= n + flank) & (ring[tile] | (start + n <= lens[tile]))
                if pam is not None:
                    at_end, at_start = (ahead, back) if direction == "downstream" else (back, ahead)
                    kept = np.flatnonzero(ok)
                    ok[kept] = _reads_there(raw, place[kept] + n, at_end) | _reads_there(raw, place[kept] - flank, at_start)
                place, tile, start = place[ok], tile[ok], start[ok].astype(np.int32)
                for i in range(0, len(place), BATCH):
                    p, own = place[i : i + BATCH, None], pa.array(tile[i : i + BATCH])
                    cut = lambda begin, size: _strings(raw[p + begin + np.arange(size)])  # noqa: B023, E731
                    columns = [batch["chr"].take(own), batch["len"].take(own), pa.array(start[i : i + BATCH]), cut(0, n), cut(-flank, flank), cut(n, flank)]
                    yield pa.RecordBatch.from_arrays(columns, ["chr", "len", "start", "window", "before", "after"])

    fields = [chrom.schema["chr"], chrom.schema["len"], *T.StructType.fromDDL("start int, window string, before string, after string")]
    return tiles.mapInArrow(each, T.StructType(fields))
