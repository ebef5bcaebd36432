"""How two tokenizers' tokens of one text lie on each other: a byte-level BPE (A) and a sentencepiece model (B).

Texts of an Arrow batch are cut into units where both tokenizers always cut: before a single space or line feed between
two characters that aren't white space. A unit that repeats is worked once, as long as a worker keeps it. Tokens of the units become
interval tables in DuckDB: two ASOF joins, by starts, with a range condition give the tokens that overlap, window sums
over common ends give the groups. A partition sends its documents' links, and partial counts of how many documents hold
each pair of ids, which Spark merges; the counts come back to the documents in rounds of a bounded number of pairs.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary, load
from .common import written

#: Bytes of text that are worked at once (a longer text whole), pairs that a task counts before it sends them on, pairs in
#: one row of partial counts, pairs that are broadcast in one round.
SLICE, HELD, ROW, ROUND = 3 << 20, 1_000_000, 65_536, 2_000_000
#: Bits of an id in a pair, units that a worker keeps.
BITS, KEPT = 20, 250_000
FIGURES = ("n_a", "n_b", "n_groups", "n_links")

#: What may stand behind an id in the text of groups.
SIGNS = (",", "|", ";")
LINKS = f"""SELECT ta.u, (ta.id << {BITS}) | tb.id AS pair FROM ta ASOF JOIN tb ON ta.s >= tb.s
UNION ALL SELECT tb.u, (ta.id << {BITS}) | tb.id FROM tb ASOF JOIN ta ON tb.s > ta.s WHERE ta.e > tb.s"""

#: The group of each token: how many common ends there are before its own.
GROUPS = """SELECT x.u, x.id, CAST(sum((y.e IS NOT NULL)::INT) OVER (ORDER BY x.s ROWS UNBOUNDED PRECEDING) - (y.e IS NOT NULL)::INT AS BIGINT) AS g
FROM {0} x LEFT JOIN {1} y ON x.e = y.e ORDER BY x.s"""


def solid(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to characters that surely aren't white space (letters beyond ASCII count as such only in
    blocks that hold none)."""
    plain = np.zeros(256, bool)
    for first, end in ((0x21, 0x7F), (0xC3, 0xE0), (0xE4, 0xEE), (0xF0, 0xF5)):
        plain[first:end] = True
    ok, follows = plain[data], (data & 0xC0) == 0x80
    for _ in range(3):
        ok[1:] |= follows[1:] & ok[:-1]
    return ok


def cuts(raw: bytes) -> np.ndarray:
    """Places where both tokenizers cut: at a space or line feed between two characters that surely aren't white space.
    U+2581, which is B's space, counts as a letter here: a text that has one gets no tokens, wherever it is cut."""
    data = np.frombuffer(raw, np.uint8)
    ok, inner = solid(data), data[1:-1]
    return np.flatnonzero(((inner == 0x20) | (inner == 0x0A)) & ok[:-2] & ok[2:]) + 1


class Pair:
    """Both tokenizers and the bytes of their tokens, on a worker."""

    _made: dict[tuple, Pair] = {}

    def __init__(self, vocabulary: Vocabulary, model: bytes):
        import sentencepiece
        import tiktoken

        if (np.diff(vocabulary.merged) <= 0).any():
            raise ValueError("a vocabulary's merges must be in the order of their ids")
        special = set(vocabulary.special.values())
        ranks = {token: i for i, token in enumerate(vocabulary.tokens) if token and i not in special}
        self.a = tiktoken.Encoding(vocabulary.key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.b.get_piece_size())
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        tables = vocabulary.tokens, [piece(i) for i in ids]
        if max(map(len, tables)) > 1 << BITS:
            raise ValueError(f"a vocabulary may have {1 << BITS} ids at most")
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in tables]
        self.b_bytes = pa.array(tables[1], pa.large_binary())
        self.bytes_b = lambda ids: (self.b_bytes.take(pa.array(ids)).buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        self.words = pa.array([f"{i}{sign}" for i in range(max(map(len, tables))) for sign in SIGNS], pa.large_string())

    @classmethod
    def of(cls, vocabulary, model) -> Pair:
        """The worker's tokenizers for two broadcasts."""
        key = (vocabulary.value.key, sha256(model.value).digest())
        if key not in cls._made:
            cls._made[key] = cls(vocabulary.value, model.value)
        return cls._made[key]

    def encode_a(self, raws: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit and id of A's tokens. Units between places where A always cuts are encoded as one text, others singly."""
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raws), np.uint8)
        ok, first, last = solid(data), ends - sizes, ends - 1
        second = np.minimum(first + 1, last)
        whole = (sizes > 1) & ok[second] & ok[last] & ((data[first] == 0x20) | (data[first] == 0x0A))
        own = np.flatnonzero(whole)
        ids = self.a.encode_to_numpy(b"".join([raws[i] for i in own]).decode()).astype(np.int64)
        unit = own[np.searchsorted(np.cumsum(sizes[own]), np.cumsum(self.sizes[0][ids]) - 1, "right")]
        rest = np.flatnonzero(~whole)
        if len(rest):
            single = [self.a.encode_ordinary(raws[i].decode()) for i in rest]
            unit = np.concatenate([unit, np.repeat(rest, list(map(len, single)))])
            order = np.argsort(unit, kind="stable")
            unit, ids = unit[order], np.concatenate([ids, np.fromiter(chain.from_iterable(single), np.int64)])[order]
        return unit, ids

    def encode_b(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit and id of B's tokens. B adds a space to a text, which is that of a unit that begins with one; before a unit
        that begins with a line feed, which no piece holds, it stands by itself and is taken off again."""
        spaced = [u[0] == 0x20 for u in raws]
        found = self.b.encode([(u[1:] if s else u).decode() for u, s in zip(raws, spaced, strict=True)], num_threads=1)
        found = [ids if s else ids[1:] for ids, s in zip(found, spaced, strict=True)]
        return np.repeat(np.arange(len(raws)), list(map(len, found))), np.fromiter(chain.from_iterable(found), np.int64)


def intervals(pair: Pair, raws: list[bytes]) -> tuple[list[pa.Table], np.ndarray]:
    """Interval tables (u, s, e, id) of the tokens of units by A and B, and which units B gives back (A gives back all)."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    found, good = [pair.encode_a(raws, sizes), pair.encode_b(raws)], np.ones(len(raws), bool)
    unit, ids = found[1]
    if (np.bincount(unit, pair.sizes[1][ids], len(raws)) != sizes).any() or pair.bytes_b(ids) != b"".join(raws):
        edges = np.searchsorted(unit, np.arange(len(raws) + 1))
        good = np.fromiter((pair.bytes_b(ids[a:b]) == r for r, a, b in zip(raws, edges, edges[1:], strict=False)), bool, len(raws))
    tables = []
    for (unit, ids), size in zip(found, pair.sizes, strict=True):
        kept = good[unit]
        unit, ids = unit[kept], ids[kept]
        ends = np.cumsum(size[ids])
        tables.append(pa.table({"u": unit, "s": ends - size[ids], "e": ends, "id": ids}))
    return tables, good


def group_texts(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: pa.Array, n: int) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3;`` of each of n units from (u, id, g) of the tokens of A and of B, both in order; words: each
    id's decimal with each of the signs behind it."""
    (ua, ida, ga), (ub, idb, gb) = sides
    place_a = np.arange(len(ga)) + np.searchsorted(gb, ga, "left")
    place_b = np.arange(len(gb)) + np.searchsorted(ga, gb, "right")
    ids, unit, code = (np.empty(len(ga) + len(gb), np.int64) for _ in range(3))
    for place, u, i, g, side in ((place_a, ua, ida, ga, 0), (place_b, ub, idb, gb, 1)):
        ids[place], unit[place], code[place] = i, u, 2 * g + side
    # the sign behind a token: a comma within a side, a bar between sides, a semicolon between groups
    sign = np.append(np.where(np.diff(code) == 0, 0, np.where(np.diff(code) + code[:-1] % 2 == 1, 1, 2)), 2) if len(code) else code
    said = words.take(pa.array(len(SIGNS) * ids + sign))
    offsets = np.frombuffer(said.buffers()[1], np.int64, len(said) + 1)[np.searchsorted(unit, np.arange(n + 1))]
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), said.buffers()[2]])


def overlaps(con, words: pa.Array, tables: list[pa.Table], n: int) -> tuple[dict[str, np.ndarray], pa.Array, np.ndarray, np.ndarray]:
    """Of n units: figures, groups as text; first link of each unit (and one end), and the links."""
    for name, table in zip(("ta", "tb"), tables, strict=True):
        con.register(name, table)
    links = con.sql(LINKS).to_arrow_table()
    sides = [tuple(c.to_numpy() for c in con.sql(GROUPS.format(*x)).to_arrow_table().columns) for x in (("ta", "tb"), ("tb", "ta"))]
    unit, ua, ga = links["u"].to_numpy(), sides[0][0], sides[0][2]
    figures = {
        "n_a": np.bincount(ua, minlength=n),
        "n_b": np.bincount(sides[1][0], minlength=n),
        "n_groups": np.bincount(ua[np.flatnonzero(np.diff(ga, prepend=-1))], minlength=n),
        "n_links": np.bincount(unit, minlength=n),
    }
    order = np.argsort(unit, kind="stable")
    first = np.concatenate([[0], np.cumsum(figures["n_links"])])
    return figures, group_texts(sides, words, n), first, links["pair"].to_numpy()[order]


class Store:
    """What a worker keeps of the units it has met: a bounded store that only saves time."""

    def __init__(self, pair: Pair, con):
        self.pair, self.con = pair, con
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.good, self.said = np.empty(0, bool), pa.array([], pa.large_string())
        self.figures = {k: np.empty(0, np.int64) for k in FIGURES}
        self.first, self.pairs = np.zeros(1, np.int64), np.empty(0, np.int64)

    def places(self, units: list[bytes]) -> np.ndarray:
        """Where each of these distinct units stands in the store; new ones are worked and added."""
        new = [u for u in units if u not in self.ids]
        if len(self.ids) + len(new) > KEPT:
            self.clear()
            new = units
        if new:
            tables, good = intervals(self.pair, new)
            figures, said, first, pairs = overlaps(self.con, self.pair.words, tables, len(new))
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.good = np.concatenate([self.good, good])
            self.said = pa.concat_arrays([self.said, said])
            self.figures = {k: np.concatenate([self.figures[k], figures[k]]) for k in FIGURES}
            self.first = np.concatenate([self.first, first[1:] + self.first[-1]])
            self.pairs = np.concatenate([self.pairs, pairs])
        return np.fromiter(map(self.ids.__getitem__, units), np.int64, len(units))


def runs(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin in a sorted array, and its end."""
    return np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key))


def align_texts(store: Store, texts: list[bytes]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: figures and digest of its groups; where its links begin (and one end), each pair once with its times."""
    n = len(texts)
    raws = [b" " + t for t in texts]
    raw = b"".join(raws)
    ends = np.cumsum([len(r) for r in raws])
    begins = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts(raw)] = edge[begins] = edge[-1] = True
    at = np.flatnonzero(edge)
    array = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
    coded = array.dictionary_encode()
    index = store.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    edges = np.append(np.searchsorted(at, begins), len(index))
    doc = np.repeat(np.arange(n), np.diff(edges))
    bad = np.fromiter(map(len, texts), np.int64, n) == 0
    bad[doc[~store.good[index]]] = True
    sums = {k: np.where(bad, 0, np.add.reduceat(v[index], edges[:-1])) for k, v in store.figures.items()}
    laid = store.said.take(pa.array(index))
    place, data = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[edges].tolist(), memoryview(laid.buffers()[2] or b"")
    digests = ["" if b else sha256(data[x : y - 1]).hexdigest() for b, x, y in zip(bad, place, place[1:], strict=False)]
    # each document's units once, with their links
    size = len(store.ids)
    key = np.sort((doc * size + index)[~bad[doc]])
    edges = runs(key)
    key, often = key[edges[:-1]], np.diff(edges)
    unit = key % size
    many = store.first[unit + 1] - store.first[unit]
    row = np.repeat(np.arange(len(key)), many)
    link = np.arange(len(row)) + np.repeat(store.first[unit] - np.cumsum(many) + many, many)
    key = (key // size)[row] << 2 * BITS | store.pairs[link]
    order = np.argsort(key)
    key, weight = key[order], often[row][order]
    edges = runs(key)
    key, weight = key[edges[:-1]], np.add.reduceat(weight, edges[:-1]) if len(key) else weight
    return sums, digests, np.searchsorted(key >> 2 * BITS, np.arange(n + 1)), key & (1 << 2 * BITS) - 1, weight


def slices(column: pa.Array, most: int = SLICE):
    """Parts of a string column of about ``most`` bytes each, as UTF-8; null counts as empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *edges], [*edges, len(column)], strict=True):
        yield [x or b"" for x in column.slice(a, b - a).cast(pa.binary()).to_pylist()]


def aligned(docs: DataFrame, vocabulary_path: str, model_path: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links array<struct<pair, times>>): a row for each document
    with its links, and rows of partial counts, whose row is null: links are pairs and how many documents hold them.

    pair holds both ids, B's in the lower ``BITS`` bits. row numbers the rows as they are worked and lasts only if the table is
    written. Null and empty texts, and those that a tokenizer doesn't give back, have zeros and no links; repeated rows
    and rows without id have rows of their own; other columns are left out; an empty table gives an empty table. A text is
    worked whole, in about fifty times its bytes.
    """
    from pyspark import TaskContext

    session = docs.sparkSession
    vocabulary = load(session, vocabulary_path)
    with open(model_path, "rb") as file:
        model = session.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("pair", pa.int64()), ("times", pa.int64())])

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        store = Store(Pair.of(vocabulary, model), con)
        at, held = TaskContext.get().partitionId() << 33, []
        as_links = lambda offsets, pairs, times: pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], fields=list(item))
        )
        names = ["row", "doc_id", *FIGURES, "groups_sha256", "links"]

        def counts():
            pairs, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            offsets = np.append(np.arange(0, len(pairs), ROW), len(pairs))
            blank = [pa.nulls(len(offsets) - 1, t) for t in (pa.int64(), id_type, *[pa.int64()] * len(FIGURES), pa.string())]
            return pa.RecordBatch.from_arrays([*blank, as_links(offsets, pairs, times)], names)

        id_type = None
        for batch in batches:
            id_type, done = batch.schema.field("doc_id").type, 0
            for part in slices(batch.column("text")) if len(batch) else ():
                figures, digests, begin, pairs, times = align_texts(store, part)
                columns = [pa.array(np.arange(at, at + len(part))), batch.column("doc_id").slice(done, len(part))]
                columns += [pa.array(figures[k], pa.int64()) for k in FIGURES]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), as_links(begin, pairs, times)], names)
                at, done = at + len(part), done + len(part)
                held.append(pairs)
                if sum(map(len, held)) > HELD:
                    yield counts()
        if held:
            yield counts()

    figures = ", ".join(f"{k} bigint" for k in FIGURES)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"row bigint, doc_id {kind}, {figures}, groups_sha256 string, links array<struct<pair: bigint, times: bigint>>"
    )


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair of ids, and whether no other pair of its A id is held by more."""
    partial = table.where("row is null").select(F.inline("links"))
    merged = partial.groupBy("pair").agg(F.sum("times").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", BITS))  # at most as many rows as B has ids
    return merged.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("int"))


def align_tokenizers(docs: DataFrame, vocabulary_path: str, model_path: str, most: int = ROUND) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, as ``aligned`` gives them.

    n_best: links whose pair is held by as many documents as any pair of its A id; count_sum: these counts, over all links.
    The pairs are broadcast in as many rounds of about ``most`` as it takes; each round reads the documents' links once.
    """
    table = written(aligned(docs, vocabulary_path, model_path))
    counts = written(pair_counts(table))
    rounds = 1 + counts.count() // most
    links = table.where("row is not null").select("row", F.inline("links"))
    sums = []
    for part in range(rounds):
        own = counts.where(F.pmod(F.hash(F.shiftright("pair", BITS)), F.lit(rounds)) == part)
        met = links.join(F.broadcast(own), "pair").select("row", (F.col("times") * F.col("best")).alias("b"), (F.col("times") * F.col("n")).alias("c"))
        sums.append(met.groupBy("row").agg(F.sum("b").alias("n_best"), F.sum("c").alias("count_sum")))
    total = reduce(DataFrame.unionByName, sums)
    if rounds > 1:
        total = total.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    rows = table.where("row is not null").drop("links").join(total, "row", "left").fillna(0, ["n_best", "count_sum"])
    return rows.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")
