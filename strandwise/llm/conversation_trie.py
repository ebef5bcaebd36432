"""Prefix trie of conversations as a table of nodes, keyed by hashes of their turns.

A turn's hash holds its place, and the exclusive or of a conversation's first d hashes names its node of depth d. Node
tables are partial tries: each partition combines its own rows by key before the shuffle (Spark's partial aggregation),
and tables of different parts of a corpus merge by the same sums. Lists of the conversations that end in a node are merged
as sorted pieces of text. For the rollup each node belongs to the member that a hash puts first. The nodes of one
member are a path down to its end; a path hangs on a node of another, and few paths hang on each other (as many as a
random order has records: the logarithm of the members). So totals climb path by path, and running sums along each path
give what lies below every node.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .common import cut, text_of, written

#: Turns that a rebuilt conversation may take from another one, conversations of which the first lends them.
MOST, FAMILY = 5, 100
KEY = ("depth", "k1", "k2")
#: Ids in one piece of a list.
PIECE = 4_096


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, chars): the turns of each conversation from 1, in order of turn (null first).

    Null roles and texts are empty. Turns that tie come in order of their digest (SHA-256 of the role's length, a colon, the
    role and the text). Rows without conv_id belong to no conversation and are left out, as are all other columns.
    """
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    return running(own, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("digest")], {"i": F.lit(1)}).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of numbered turns: (conv_id, size) of each rebuilt conversation, and its turns (conv_id, d, size, digest, chars).

    A conversation's first h turns give way to as many of the first conversation of its hundred (all of them if it has
    fewer, none if there is no such conversation); h is CRC-32 of the id as text modulo 6.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)).alias("h")
    convs = own.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    lent = own.select(F.col("conv_id").alias("base"), F.col("n").alias("_of"))
    convs = convs.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("_of", F.lit(0))))
    convs = written(convs.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("_of"))
    heads = turns.where(F.col("i") <= MOST).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").where("i <= h").select("conv_id", F.col("i").alias("d"), "size", "digest", "chars")
    rest = turns.join(convs, "conv_id").where("i > h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("d"), "size", "digest", "chars")
    return convs.select("conv_id", "size"), first.unionByName(rest)


def keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, size, chars, depth, k1, k2, p1, p2): the node of each turn and its parent's hashes."""
    hashes = {"k1": F.xxhash64("d", "digest"), "k2": F.xxhash64(F.lit("k2"), "digest", "d")}
    own = turns.select("conv_id", "size", "chars", F.col("d").alias("depth"), *(x.alias(f"x{c[1]}") for c, x in hashes.items()))
    along = running(own, ["conv_id"], ["depth"], xors={"k1": F.col("x1"), "k2": F.col("x2")})
    return along.select("conv_id", "size", "chars", *KEY, *(F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in "12"))


def partial_trie(members: DataFrame) -> DataFrame:
    """A node table from rows of members, one for each conversation and depth."""
    of = members.withColumns({"n_convs": F.lit(1).cast("bigint"), "owner": F.struct(F.xxhash64("conv_id").alias("at"), F.col("conv_id").alias("id"))})
    return merge(of.select("conv_id", "n_convs", "chars", "owner", "p1", "p2", *KEY))


def merge(*tables: DataFrame) -> DataFrame:
    """One node table of several: members add up; of disjoint sets of conversations, in any order and grouping."""
    values = [F.min("conv_id"), F.sum("n_convs"), F.max("chars"), F.min("owner"), F.max("p1"), F.max("p2")]
    names = ("conv_id", "n_convs", "chars", "owner", "p1", "p2")
    return reduce(DataFrame.unionByName, tables).groupBy(*KEY).agg(*(v.alias(n) for v, n in zip(values, names, strict=True)))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from rows (depth, k1, k2, conv_id): the digest of each node's ids, ascending.

    Ids are sorted in ranges, so those of one node may fill many, and become pieces of text there; a node's digest
    streams over its pieces, which are few.
    """

    def pieces(batches):
        held: list[int] = []
        key = None
        for batch in batches:
            made = []
            for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if held and (now != key or len(held) == PIECE):
                    made.append((*key, held[0], ",".join(map(str, held))))
                    held = []
                key = now
                held.append(conv)
            yield batch_of(made)
        if held:
            yield batch_of([(*key, held[0], ",".join(map(str, held)))])

    names = [*KEY, "first", "ids"]

    def batch_of(rows):
        kinds = [pa.int64()] * 4 + [pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def digests(batches):
        key, said = None, None
        for batch in batches:
            made = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if now == key:
                    said.update(b",")
                else:
                    if key is not None:
                        made.append((*key, said.hexdigest()))
                    key, said = now, sha256()
                said.update(ids.encode())
            yield digest_batch(made)
        if key is not None:
            yield digest_batch([(*key, said.hexdigest())])

    def digest_batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*KEY, "ends_sha256"])

    keys = ", ".join(f"{c} bigint" for c in KEY)
    ranges = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    cut_up = ranges.mapInArrow(pieces, f"{keys}, first bigint, ids string")
    return cut_up.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, f"{keys}, ends_sha256 string")


def rollup(nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of a node table with its root."""
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("owner.id").alias("above")
    )
    # a node of very many children is a skewed key here, which adaptive execution splits
    own = nodes.withColumn("owner", F.col("owner.id")).join(parents, ["depth", "p1", "p2"], "left").join(children, list(KEY), "left").fillna(0, "n_children")
    value = {"saved_tokens": (F.col("n_convs") - 1) * F.col("chars"), "n_leaves": (F.col("n_children") == 0).cast("bigint")}
    own = written(own.withColumns(value))
    sums = lambda: [F.sum(c).alias(c) for c in value]
    tops = own.where("above is null or above != owner").select("owner", "above", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    # what each path holds goes to the path above, and from there on, until all has arrived at the root's
    moved = cut(own.groupBy("owner").agg(*sums()))
    seen = [moved]
    while True:
        moved = cut(moved.join(tops.where("above is not null").select("owner", "above"), "owner").groupBy(F.col("above").alias("owner")).agg(*sums()))
        if moved.isEmpty():
            break
        seen.append(moved)
    totals = reduce(DataFrame.unionByName, seen).groupBy("owner").agg(*sums())
    hanging = totals.join(tops.where("above is not null"), "owner").groupBy(*KEY).agg(*(F.sum(c).alias(f"_{c}") for c in value))
    each = own.join(hanging, list(KEY), "left")
    each = each.select("owner", *KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in value))
    return running(each, ["owner"], [F.desc("depth")], {c: F.col(c) for c in value}).drop("owner")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node: the query.

    Conversations are rebuilt first. Rows without conv_id are left out, null roles and texts are empty, repeated rows are
    turns of their own, a conversation of no turns is a member of the root and ends there. The text of a turn never
    leaves its task. Without any conversation there is no root and no row.
    """
    convs, turns = rebuilt(written(numbered_turns(conversations)))
    members = written(keyed(turns))
    blank = {c: F.lit(0).cast("bigint") for c in (*KEY, "p1", "p2", "chars")}
    nodes = written(partial_trie(members.drop("size").unionByName(convs.select("conv_id").withColumns(blank))))
    ended = members.where("depth = size").select(*KEY, "conv_id")
    ends = ended.unionByName(convs.where("size = 0").select("conv_id").withColumns({c: blank[c] for c in KEY}))
    rows = rollup(nodes).join(ends_digests(ends), list(KEY), "left").fillna(sha256(b"").hexdigest(), "ends_sha256")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of the id's decimal digits, a bit at a time.
CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b:
  list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"""

ORACLE_SQL = f"""WITH turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i, digest, chars FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL) t),
convs AS (SELECT *, least(h, coalesce(b.n, 0)) AS taken FROM (SELECT conv_id, n, conv_id - conv_id % {FAMILY} AS base, {CRC} % {MOST + 1} AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) c) c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM turns GROUP BY 1) b USING (base)),
rebuilt AS (
  SELECT c.conv_id, t.i AS d, digest, chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i - c.h + c.taken, digest, chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
paths AS MATERIALIZED (
  SELECT conv_id, d, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS key, max(d) OVER (PARTITION BY conv_id) AS size FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(d) FROM rebuilt r WHERE r.conv_id = c.conv_id), 0) FROM convs c),
nodes AS MATERIALIZED (SELECT key, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = size), '') AS ends FROM paths GROUP BY key),
kids AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT p.key, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN nodes u ON n.depth > 0 AND u.key = left(n.key, 64 * (n.depth - 1))"""
