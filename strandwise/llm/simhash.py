"""SimHash near-duplicates, linked through tables of distances to reference fingerprints (pivots).

The distance of two fingerprints is at least the difference of their distances to any third one. Pivots drawn at
random can only thin out pairs, not find them, since nearly all distances between 64-bit fingerprints lie close to 32.
So most pivots here are built in families: a base pivot and, for each of ``blocks`` runs of bits, pivots that differ
from the base within this run alone. The difference of two such distances depends on one run only; two fingerprints
within ``radius`` bits leave at least ``blocks - radius`` runs alone and therefore have equal coordinates there. Equal
coordinates in that many runs are the keys of an equi-join; a pair from it is discarded if its coordinates for the
free pivots differ by more than the radius anywhere, and the rest is verified bit by bit. No pair is lost.
"""

from __future__ import annotations

from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hex64
from .components import connected_components

MASK = (1 << 64) - 1


def simhash(raw: bytes, width: int) -> int:
    """Fingerprint of a UTF-8 text: a bit is set if it is set in over half of the shingles' hashes."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of documents; fp holds the 64 bits as a signed long.

    Words are split at ASCII white space after lower-casing A-Z, shingles of ``width`` words are hashed by XXH64 with
    seed 42, repeats count. A text of fewer words is one shingle; without words (null, empty) the fingerprint is zero.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([simhash(x or b"", width) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _runs(blocks: int) -> list[int]:
    """Masks of the runs of bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)).cast("long"))).cast("long")


def pivot_table(fps: DataFrame, blocks: int = 7, per_block: int = 8, free: int = 8, seed: int = 7) -> DataFrame:
    """Distances of each fingerprint to the pivots: c0.. hold a run's coordinates, ``free`` those of free pivots.

    A run's coordinates, in five bits each, are differences of distances, so they depend on this run alone.
    """
    rng, fp = Random(seed), F.col("fp")
    base = rng.getrandbits(64)
    from_base = _distance(fp, base)
    columns = {}
    for k, run in enumerate(_runs(blocks)):
        near = [_distance(fp, base ^ (rng.getrandbits(64) & run)) - from_base + 16 for _ in range(per_block)]
        columns[f"c{k}"] = sum((F.shiftleft(x, 5 * i) for i, x in enumerate(near[1:], 1)), near[0])
    far = [_distance(fp, rng.getrandbits(64)) for _ in range(free)]
    columns["free"] = sum((F.shiftleft(x, 7 * i) for i, x in enumerate(far[1:], 1)), far[0])
    return fps.withColumns(columns)


def links(fps: DataFrame, radius: int = 4, blocks: int = 7, free: int = 8) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints of the column fp that differ in ``radius`` bits or fewer.

    ``blocks`` over ``radius``: more of them make more tables of more selective keys, for larger inputs. Every pair
    comes once, from the first table that has it. Rows of one key are joined by a sort-merge join, whose hot keys
    adaptive execution splits.
    """
    tables = list(combinations(range(blocks), blocks - radius))
    runs = _runs(blocks)
    table = pivot_table(fps.where("fp is not null").select("fp").distinct(), blocks, free=free)
    keys = F.array(*(F.xxhash64(F.lit(t), *(F.col(f"c{k}") for k in ks)) for t, ks in enumerate(tables)))
    keyed = table.select("fp", "free", F.posexplode(keys).alias("t", "key"))
    left, right = (keyed.select(*(F.col(c).alias(f"{c}_{side}") for c in keyed.columns)) for side in "ab")
    byte = lambda side, i: F.shiftrightunsigned(F.col(f"free_{side}"), 7 * i).bitwiseAND(F.lit(127))
    apart = F.greatest(*(F.abs(byte("a", i) - byte("b", i)) for i in range(free)))
    xor = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    alike = sum(
        (F.when(xor.bitwiseAND(F.lit(_signed(run)).cast("long")) == 0, 1 << k).otherwise(0) for k, run in enumerate(runs)),
        F.lit(0),
    )
    first = {m: next((t for t, ks in enumerate(tables) if all(m >> k & 1 for k in ks)), -1) for m in range(1 << blocks)}
    at = F.element_at(F.array(*(F.lit(first[m]) for m in range(1 << blocks))), alike + 1)
    on = (
        (F.col("key_a") == F.col("key_b"))
        & (F.col("t_a") == F.col("t_b"))
        & (F.col("fp_a") < F.col("fp_b"))
        & (apart <= radius)
        & (F.bit_count(xor) <= radius)
        & (at == F.col("t_a"))
    )
    # sorted, whatever Spark takes their size for: it leaves out that each fingerprint has a row for each table
    return left.hint("merge").join(right.hint("merge"), on).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def classes(vertices: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, root) from (fp, least) with one row for each fingerprint: root is the least vertex that fp can reach.

    A vertex is (none, least, fp): its least doc_id, those without any last. The least id is so carried through the
    contractions, and no join on a root, which may be a third of all rows', is left.
    """
    vertices = cut(vertices.select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("vertex")))
    ends = links(vertices, radius, blocks)
    for end in "ab":
        named = vertices.select(F.col("fp").alias(end), F.col("vertex").alias(f"vertex_{end}"))
        ends = ends.join(named.hint("merge"), end)
    roots = connected_components(ends.select(F.col("vertex_a").alias("a"), F.col("vertex_b").alias("b")))
    return cut(vertices.join(roots.hint("merge"), "vertex", "left").select("fp", F.coalesce("root", "vertex").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, blocks: int = 7) -> DataFrame:
    """(doc_id, fp, component_id) for each row of documents.

    component_id is the least doc_id that can be reached over links of ``radius`` bits or fewer, the document itself
    included. Texts without words share the fingerprint zero and link like any other. Rows of equal fingerprints
    meet in one vertex before any pair is made. Repeated rows come back as often as they came; a component of null
    ids only has a null id; other columns of the input are ignored; an empty table gives an empty table.
    """
    fps = cut(fingerprints(docs, width))
    vertices = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return fps.join(classes(vertices, radius, blocks).hint("merge"), "fp").select("doc_id", "fp", F.col("root.least").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4, blocks: int = 7) -> DataFrame:
    """The document of least doc_id of each component; columns as they came.

    Rows of one id are told apart by a digest of their text: of those in one component, the one of least fingerprint and
    digest stays, rows of other texts that aren't near it stay in their own components. Of rows equal in id and text, the
    one that is least in its other columns stays. Rows without id can't be told apart and all stay. An empty table gives
    an empty table.
    """
    known = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    known = known.withColumn("_digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    fps = cut(fingerprints(known.select(F.struct("doc_id", "_digest").alias("doc_id"), "text"), width))
    fps = fps.select("doc_id.*", "fp")
    roots = classes(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, blocks)
    own = fps.join(roots.hint("merge"), "fp").where(F.col("doc_id") == F.col("root.least")).groupBy("root")
    kept = own.agg(F.min(F.struct("doc_id", "fp", "_digest")).alias("kept")).select("kept.doc_id", "kept._digest")
    rows = known.join(kept.hint("merge"), ["doc_id", "_digest"], "left_semi").groupBy("doc_id", "_digest").agg(F.min("_row").alias("_row"))
    return rows.select("_row.*").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def op6_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """The query: fingerprints as hex digits and components of all documents."""
    return near_duplicates(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
