"""Mixing sources to target weights under a curriculum that changes with time.

Each source has a share of the words of the whole mix and a schedule, its weight over training time 0 to 1. Integrated,
the schedule says how many of the source's words are due at any time; inverted, when a word at a given place of the
source's order is due. A document's first word so gets a time, and the words that all sources are due until then are its
training position. Documents are sorted by position in ranges.

A source's order is that of the documents' digests. Places in it come from sums over ``BUCKETS`` ranges of digests and
running sums within each, so that a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

#: Shares of the sources in their order, taken again and again, and of the schedules (weight at times 0 and 1).
WEIGHTS = (5, 2, 1)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE, CAP = 1.5, 2.0
BUCKETS = 4096


def words_in(text: str | Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, kind, target) from (source, source_size): one row for each source.

    Sources by code point, null last, weigh ``weights`` again and again and share ``share`` times all words. A target
    stops at ``cap`` times its source's size; what is over is shared by weight until no target is above. In closed form:
    in order of size by weight, a source is full if the words left for it and the rest, by weight, would fill it; the
    rate of the first that is not full holds for all that follow (their own are lower, since it took more than its share).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("kind") + 1)
    table = sizes.withColumn("kind", kind).withColumn("weight", weight)
    table = table.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("most") / F.col("weight"))
    fill = Window.orderBy("level", F.col("source").asc_nulls_last())
    earlier, later = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(min(share, cap))
    left = total - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    table = table.withColumn("rate", left / F.sum("weight").over(later))
    table = table.withColumn("full", F.col("level") <= F.col("rate"))
    rate = F.max(F.when(~F.col("full"), F.col("rate"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * rate)
    return table.select("source", "source_size", "kind", target.alias("target"))


def due(kind: Column, fraction: Column, schedules) -> Column:
    """Time at which a fraction of a source's words is due: its integrated schedule, inverted."""
    out = F.lit(None).cast("double")
    for k, (a, b) in enumerate(schedules):
        mean = (a + b) / 2
        if a == b:
            time = fraction
        else:
            time = (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * mean * fraction)) - a) / (b - a)
        out = F.when(kind == k, time).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def plan(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    share: float = SHARE,
    cap: float = CAP,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``columns`` of each row with size, source_size, target, copies, taken and positions.

    size counts the words of the whole text (null: none), source_size those of the source, target the words that the
    mix should take from it, copies how often the mix takes the document, taken = copies * size, positions where its
    copies stand in the training order (words that come before). Each document is taken ``floor(target / source_size)``
    times; those first in the source's order once more until the target is met to within one document. Null sources
    are a source of their own, repeated rows are documents of their own, an empty source or table takes nothing, other
    columns are ignored. Reruns agree, but for rows alike in id and size.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    size = words_in("text").alias("_size")
    kept = F.struct(*(F.col(c) for c in columns)).alias("_doc")  # apart from all other names
    rows = docs.select(kept, F.col("source").alias("_source"), size, digest.alias("_digest"))
    if not {*columns} - {"doc_id", "source"}:
        rows = cut(rows)
    bucket = F.conv(F.substring("_digest", 1, 6), 16, 10).cast("int") % buckets
    rows = rows.withColumn("_bucket", bucket)
    sums = cut(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")))
    sizes = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size"))
    by_source = targets(sizes, weights, share, cap)
    starts = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(starts), F.lit(0)).alias("_start"))
    by_source = by_source.withColumnRenamed("source", "_of")
    rates = [F.sum(F.when(F.col("kind") == k, F.col("target"))) for k in range(len(weights))]
    demand = by_source.agg(*(F.coalesce(r, F.lit(0.0)).alias(f"_d{k}") for k, r in enumerate(rates)))
    places = sums.join(by_source, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of").crossJoin(demand)
    places = places.withColumnsRenamed({"_source": "_s", "_bucket": "_b"})
    within = Window.partitionBy("_source", "_bucket").orderBy("_digest", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    rows = rows.join(places, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    before = F.col("_start") + F.col("_before")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    full = F.floor(ratio + F.lit(1e-12)).cast("long")
    over = F.col("target") - full * F.col("source_size")
    copies = full + F.when(2 * before + F.col("_size") < 2 * over, 1).otherwise(0)

    def position(copy: Column) -> Column:
        time = due(F.col("kind"), F.least(F.lit(1.0), (before + copy * F.col("source_size")) / F.col("target")), schedules)
        total = F.lit(0.0)
        for k in range(len(weights)):
            a, b = schedules[k % len(schedules)]
            total = total + F.col(f"_d{k}") * (a * time + (b - a) * time * time / 2) / ((a + b) / 2)
        return total

    rows = rows.withColumn("copies", copies)
    positions = F.when(
        (F.col("copies") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)
    ).otherwise(F.array().cast("array<double>"))
    return rows.select(
        *(F.col("_doc")[c].alias(c) for c in columns),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
        positions.alias("positions"),
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents in training order, each as often as the mix takes it; columns as they came.

    Partitions are ranges of positions. See ``plan`` for the settings and for odd rows; texts without words stand
    before their successors in the source's order.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    taken = plan(packed, ("doc_id", "row"), **how).select("doc_id", "row", F.explode("positions").alias("position"))
    return in_order(taken, "position", "doc_id").select(*(F.col("row")[c].alias(c) for c in docs.columns))


#: SQL of the quotas: each document's size, its source's size and target, and how often it is taken.
QUOTAS = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(CAST(doc_id AS VARCHAR)) AS digest FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
l AS (SELECT *, 2.0 * source_size AS most, 2.0 * source_size / weight AS level FROM s),
r AS (
  SELECT *, (sum(source_size) OVER () * 1.5
      - coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM l),
t AS (
  SELECT source, kind, CAST(source_size AS BIGINT) AS source_size, CAST(CASE WHEN level <= rate THEN most
    ELSE weight * max(CASE WHEN level > rate THEN rate END) OVER () END AS DOUBLE) AS target FROM r),
p AS (
  SELECT d.*, t.kind, t.source_size, t.target, floor(coalesce(t.target / nullif(t.source_size, 0), 0) + 1e-12) AS times,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(digest, 1, 6) AS BIGINT) % 4096, digest, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(times + CASE WHEN 2 * before + size < 2 * (target - times * source_size) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM p),
w AS (
  SELECT coalesce(sum(CASE WHEN kind = 0 THEN target END), 0) AS d0, coalesce(sum(CASE WHEN kind = 1 THEN target END), 0) AS d1,
    coalesce(sum(CASE WHEN kind = 2 THEN target END), 0) AS d2
  FROM t)"""

#: SQL of a fraction's time and of a time's position: the three schedules, integrated and inverted.
TIME = """least(1.0, greatest(0.0, CASE kind WHEN 0 THEN 1.5 - sqrt(greatest(0.0, 2.25 - 2.0 * fraction))
    WHEN 1 THEN fraction ELSE sqrt(0.25 + 2.0 * fraction) - 0.5 END)) AS time"""
PLACE = "round(d0 * (1.5 * time - time * time / 2) + d1 * time + d2 * (0.5 * time + time * time / 2), 3) AS position"

ORACLE_SQL = f"""{QUOTAS},
e AS (
  SELECT doc_id, size, source_size, target, copies, kind,
    CASE WHEN copies > 0 AND target > 0 THEN least(1.0, before / target) END AS fraction
  FROM c),
f AS (SELECT *, CASE WHEN fraction IS NOT NULL THEN {TIME.removesuffix(" AS time")} END AS time FROM e)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, {PLACE} FROM f, w
"""

#: SQL of the training order: each copy's place in the schedule.
POSITIONS_SQL = f"""{QUOTAS},
e AS (
  SELECT doc_id, kind, copy, least(1.0, (before + copy * source_size) / target) AS fraction
  FROM (SELECT *, unnest(range(copies)) AS copy FROM c WHERE target > 0)),
f AS (SELECT doc_id, copy, {TIME} FROM e)
SELECT doc_id, CAST(copy AS BIGINT) AS copy, {PLACE} FROM f, w
"""


def in_order(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows by the columns: partitions are ranges of them, sorted within."""
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)


def op3_mix_sources(docs: DataFrame) -> DataFrame:
    """The query: what the mix takes of each document, in training order of the first copy.

    position says where the first copy stands, in words that come before; it is null for a document that isn't taken,
    and such documents come last. Rows come as often as they came, also those without id or source (the null source is the
    last one); null and empty texts have size 0; very long texts are counted whole; other columns are left out; an empty
    table gives an empty table.
    """
    place = F.try_element_at("positions", F.lit(1)).alias("position")
    rows = plan(docs).select("doc_id", "size", "source_size", "target", "taken", place)
    rows = in_order(rows, F.col("position").asc_nulls_last(), F.col("doc_id"))
    return rows.withColumn("position", F.round("position", 3))


def op3_training_positions(docs: DataFrame) -> DataFrame:
    """The query: every copy that the mix takes and its training position, the words that come before, in this order. Of
    odd rows as ``op3_mix_sources``; documents that aren't taken have no row."""
    copies = plan(docs).select("doc_id", F.posexplode("positions").alias("copy", "position"))
    rows = in_order(copies, "position", "doc_id")
    return rows.select("doc_id", F.col("copy").cast("long").alias("copy"), F.round("position", 3).alias("position"))
