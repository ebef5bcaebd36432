"""The trie of conversations against a dictionary of prefixes and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from strandwise.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def by_dictionary(rows):
    """The contract, read turn by turn."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(len(x) == len(m) + 1 and x[:-1] == m for x in below) for m in below)
        saved = sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below)
        said = ",".join(map(str, ends.get(node, [])))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def found(table):
    return sorted(map(tuple, conversation_trie.conversation_trie(table).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed, monkeypatch):
    """Few words, so that prefixes are shared; lost turns, nulls, ties and repeated rows."""
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    r = random.Random(seed)
    rows = []
    for c in [*range(-3, 40), *range(100, 130), 250, 251, 10**12, 10**12 + 7, *range(700, 730)]:
        for t in range(r.randrange(1, 9)):
            rows.append((c, r.choice([t, t, t, 3, None]), r.choice(["user", "assistant", None]), r.choice(["a", "bé", "", None, "ccc"])))
    rows += rows[:20] + [(None, 1, "user", "nobody")] + [(c, t, "user", "same") for c in range(700, 720) for t in range(3)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == by_dictionary(rows)


def test_one_long_conversation_and_one_of_many(spark):
    """A conversation of very many turns, and very many of one text."""
    rows = [(5, t, "user", f"t{t % 7}") for t in range(300)] + [(c, 0, "user", "hello") for c in range(1000, 1400)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_dictionary(rows)


def test_odd_tables(spark):
    table = spark.createDataFrame([(7, 0, "user", "x" * 100_000), (None, 0, "user", "a")], SCHEMA)
    clashing = table.withColumns({c: F.lit("z") for c in ("i", "digest", "chars", "n", "h", "depth", "k1", "owner", "size")})
    assert found(clashing) == by_dictionary([tuple(x) for x in table.collect()])
    assert found(table.limit(0)) == [] and found(table.where("conv_id is null")) == []


def test_tries_merge(spark):
    """The tables of two halves merge to that of the whole."""
    table = spark.createDataFrame([(c, t, "user", f"{t}{c % 3}") for c in range(60) for t in range(3)], SCHEMA)
    members = conversation_trie.keyed(conversation_trie.rebuilt(conversation_trie.numbered_turns(table))[1])
    halves = [conversation_trie.partial_trie(members.where(f"conv_id % 2 = {k}")) for k in (0, 1)]
    whole = conversation_trie.partial_trie(members)
    assert sorted(map(str, conversation_trie.merge(*halves).collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_agrees_with_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{path}/conversations.parquet'")
    expected = con.sql(conversation_trie.ORACLE_SQL)
    rows = queries.op13_conversation_trie(spark, path)
    assert sorted(expected.fetchall(), key=str) == sorted(map(tuple, rows.select(*expected.columns).collect()), key=str)
