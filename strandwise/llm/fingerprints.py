"""SimHash fingerprints of documents in DataFrame functions only.

The terms of a text are its pairs of neighbouring words, letters in lower case, and its last word; a term weighs as much
as it occurs often. Each term's 64-bit hash votes with that weight for or against each bit. Votes are counted eight bits
at a time, in the bytes of a long, over slices short enough that no byte overflows.

Fingerprints within a radius are found by permuted block tables: 64 bits in ``radius + lead`` blocks, one table for each
choice of ``lead`` blocks, which a permutation brings to the front as the key. At most ``radius`` blocks hold a differing
bit, so some table has both fingerprints under one key, whatever bits differ.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hex64, text_of

SPACE = " \t\n\x0b\x0c\r"
#: Terms in a slice: the top byte of a long must stay below 128.
SLICE = 127
LANES = 0x0101010101010101
#: Most buckets of ids, whose bounds go through the driver.
MOST_BUCKETS = 4096


def bind(value: Column, use) -> Column:
    """``use(value)`` where the value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def terms(text: Column) -> Column:
    """Hashes of the terms of a text that has words."""
    words = F.split(F.lower(F.btrim(text, F.lit(SPACE))), r"[\x20\x09-\x0D]+")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bind(hashes, lambda h: F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b)))


def majority(hashes: Column) -> Column:
    """The bits that more than half of the hashes have, as a long."""

    def lanes(part: Column) -> Column:
        def lane(shift: int) -> Column:
            bits = lambda h: F.shiftrightunsigned(h, shift) if shift else h
            return F.aggregate(part, F.lit(0).cast("long"), lambda a, h: a + bits(h).bitwiseAND(F.lit(LANES)))

        return F.array(*map(lane, range(8)))

    def votes(packed: Column, bit: int) -> Column:
        count = lambda a, p: a + F.shiftrightunsigned(p[bit % 8], bit - bit % 8).bitwiseAND(F.lit(255))
        return F.aggregate(packed, F.lit(0).cast("long"), count)

    def vote(h: Column) -> Column:
        slices = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / SLICE))
        packed = F.transform(slices, lambda k: bind(F.slice(h, (k * SLICE + 1).cast("int"), SLICE), lanes))

        def fingerprint(p: Column) -> Column:
            out = F.lit(0).cast("long")
            for bit in range(64):
                one = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")
                out = out.bitwiseOR(F.when(2 * votes(p, bit) > F.size(h), one).otherwise(F.lit(0).cast("long")))
            return out

        return bind(packed, fingerprint)

    return bind(hashes, vote)


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text; zero for a text without words (null, empty, white space)."""
    blank = F.btrim(text, F.lit(SPACE)) == ""
    return F.when(text.isNull() | blank, F.lit(0).cast("long")).otherwise(majority(terms(text)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def masks(radius: int, lead: int) -> list[int]:
    """Bits of the leading blocks of each table, as signed longs."""
    n = radius + lead
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(blocks[k] for k in some) for some in combinations(range(n), lead)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def tables(fps: DataFrame, column: str, radius: int, lead: int) -> DataFrame:
    """Each fingerprint with the number and key of each table."""
    keys = F.array(*(F.col(column).bitwiseAND(F.lit(m).cast("long")) for m in masks(radius, lead)))
    return fps.select(*fps.columns, F.posexplode(keys).alias("table", "key"))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, lead: int = 3) -> DataFrame:
    """All pairs (query, found) of distinct non-null fingerprints, columns ``fp``, that differ in ``radius`` bits or
    fewer, equal ones included. Each pair comes once, from the first table that has both. More ``lead`` blocks make more
    tables with longer keys, for larger inputs. Hot keys are split by adaptive execution."""
    a = tables(queries.where("fp is not null").select(F.col("fp").alias("query")).distinct(), "query", radius, lead)
    b = tables(fps.where("fp is not null").select(F.col("fp").alias("found")).distinct(), "found", radius, lead)
    pairs = a.join(b, ["table", "key"])
    differ = F.col("query").bitwiseXOR(F.col("found"))
    first = F.coalesce(
        *(F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, t) for t, m in enumerate(masks(radius, lead)))
    )
    return pairs.where((F.bit_count(differ) <= radius) & (first == F.col("table"))).select("query", "found")


def bucket_of(docs: DataFrame, column: str = "doc_id", buckets: int | None = None) -> Column:
    """The place of a row's id among bounds that cut the rows into buckets of about equal size; -1 for null.

    The bounds, at most MOST_BUCKETS numbers, are approximate quantiles over all rows.
    """
    if buckets is None:
        buckets = min(MOST_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    found = docs.agg(F.percentile_approx(column, shares, 10 * buckets)).first()[0] or []
    bounds = sorted(set(found))
    groups = [bounds[i : i + 64] for i in range(0, len(bounds), 64)] or [[]]
    whole = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(column)))
    if len(groups) == 1:
        place = below(whole(groups[0]))
    else:
        coarse = below(whole([g[0] for g in groups[1:]]))
        place = bind(coarse, lambda i: 64 * i + below(F.element_at(F.array(*map(whole, groups)), i + 1)))
    return F.when(F.col(column).isNull(), -1).otherwise(place)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) of each row.

    The edited text is the text whose last floor(n / 2) characters are replaced by the first as many of the next
    document's (or all, if it has fewer). Documents go by descending doc_id, null last, repeated ids by text; the last
    is followed by the first, a document alone by itself. A null text counts as empty. Other columns are ignored, an
    empty table gives an empty table. Rows are cut into buckets of neighbouring ids; only each bucket's first document
    is brought to the bucket before.
    """
    rows = docs.select("doc_id", text_of("text").alias("text"))
    rows = rows.withColumn("bucket", bucket_of(docs))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    heads = rows.join(F.broadcast(tops.withColumnRenamed("bucket", "b")), (F.col("b") == F.col("bucket")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("bucket").agg(F.max("text").alias("text"))
    ring = Window.orderBy(F.col("bucket").desc())
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follower = F.coalesce(F.lead("text").over(ring), F.first("text").over(everything))
    heads = heads.select("bucket", follower.alias("head"))
    rows = rows.withColumn("fp", fingerprint(F.col("text"))).repartition("bucket")
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "fp")))
    rows = rows.join(heads, "bucket", "left")
    last = F.col("next_text").isNull()
    rows = rows.select(
        "doc_id",
        "text",
        "fp",
        F.length("text").cast("long").alias("n_chars"),
        F.coalesce("next_text", "head").alias("next_text"),
        F.when(last, fingerprint(F.col("head"))).otherwise(F.col("next_fp")).alias("next_fp"),
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fp",
        fingerprint(F.col("edited")).alias("edited_fp"),
        "next_fp",
    )


def op1_document_fingerprints(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """The query: fingerprints of all texts and edited texts, and their likeness.

    near_docs is the number of other documents within the radius, for documents whose id is divisible by ``every``.
    """
    rows = cut(fingerprint_edits(docs))
    out = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex64(F.col("fp")).alias("fingerprint"),
        hex64(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "fp",
    )
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    held = rows.groupBy("fp").agg(F.count("*").alias("n"))
    pairs = within_radius(rows.where(asks), held, radius)
    near = pairs.join(held, F.col("found") == F.col("fp")).groupBy("query").agg((F.sum("n") - 1).alias("near_docs"))
    asked = out.where(asks).join(near, F.col("fp") == F.col("query")).drop("fp", "query")
    rest = out.where(~asks).drop("fp").withColumn("near_docs", F.lit(None).cast("long"))
    return asked.unionByName(rest)
