"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs at each place of a word, ordered by (rank, place); the root is the leftmost pair
of lowest rank. A merge changes three leaves and their logarithmically many ancestors. The trees of many words are
rows of one numpy array and take their merges in step; a word leaves when its root has no mergeable pair.

Text is cut where the pattern of the vocabulary always cuts: around a single space or line feed between two characters
that aren't white space. Such pieces repeat, so a worker keeps the ids of those it has met (a bounded store that only
saves time).
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 60
KEPT = 600_000
#: Fewer words than this are merged one by one.
FEW = 32
#: A bound between pieces.
BOUND = re.compile(r"(?<=\S)(?=[ \n]\S)")


def byte_of_char() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a ``tokenizers`` file of the byte-level BPE kind; it is sent to executors."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.key, said = sha256(raw).hexdigest(), json.loads(raw)
        of, ids = byte_of_char(), said["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for char, b in of.items():
            self.byte_ids[b] = ids[char]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in said["model"]["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        # padded by a key above all others, so that a search never ends behind the last
        self.rank_of = np.append(np.argsort(keys, kind="stable"), 0)
        self.keys = np.append(np.sort(keys), np.iinfo(np.int64).max)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where a pair doesn't merge."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)


class MergeTrees:
    """Segment trees over the adjacent pairs of words of at most ``width`` (a power of two) bytes, a row for each."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes], width: int):
        self.v, self.width, n = vocabulary, width, len(words)
        self.levels = width.bit_length() - 1
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        self.ids = vocabulary.byte_ids[raw]
        place = np.arange(width)
        self.alive = place < size[:, None]
        self.next = np.where(place + 1 < size[:, None], place + 1, -1)
        self.before = np.broadcast_to(place - 1, (n, width)).copy()
        leaves = np.full((n, width), NONE)
        if width > 1:
            found = vocabulary.ranks(self.ids[:, :-1], self.ids[:, 1:])
            mergeable = (found < NONE) & self.alive[:, 1:]
            leaves[:, :-1] = np.where(mergeable, found * width + place[:-1], NONE)
        self.tree = np.full((n, 2 * width), NONE)
        self.tree[:, width:] = leaves
        for level in range(self.levels - 1, -1, -1):
            a = 1 << level
            below = self.tree[:, 2 * a : 4 * a].reshape(n, a, 2)
            self.tree[:, a : 2 * a] = below.min(axis=2)

    def _put(self, row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Point update of a leaf in each row, up to the root."""
        tree, at = self.tree, leaf + self.width
        tree[row, at] = value
        for _ in range(self.levels):
            at = at >> 1
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

    def _rank(self, row, left, right) -> np.ndarray:
        """Values of the leaves at ``left`` if their right neighbours are at ``right`` (-1: none)."""
        found = self.v.ranks(self.ids[row, left], self.ids[row, right])
        return np.where((found < NONE) & (right >= 0), found * self.width + left, NONE)

    def run(self) -> list[bytes]:
        """Merges until no root has a pair; the little-endian ids of each word."""
        row = np.arange(len(self.ids))
        while True:
            root = self.tree[row, 1]
            more = root < NONE
            if not more.all():
                row, root = row[more], root[more]
            if not len(row):
                break
            at, rank = root % self.width, root // self.width
            gone = self.next[row, at]
            after = self.next[row, gone]
            self.ids[row, at] = self.v.merged[rank]
            self.alive[row, gone] = False
            self.next[row, at] = after
            has = after >= 0
            self.before[row[has], after[has]] = at[has]
            self._put(row, gone, np.full(len(row), NONE))
            self._put(row, at, self._rank(row, at, after))
            left = self.before[row, at]
            has = left >= 0
            if has.any():
                r, p = row[has], left[has]
                self._put(r, p, self._rank(r, p, at[has]))
        flat = self.ids[self.alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(self.alive.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_one(ranks: dict[int, int], merged: list[int], ids: list[int]) -> list[int]:
    """Ids of one word after its merges: the same tree as in MergeTrees, for a word on its own."""
    n = len(ids)
    width = 1 << (n - 1).bit_length()
    top = width << 32  # above any leaf
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]

    def leaf(i: int) -> int:
        rank = ranks.get(ids[i] << 32 | ids[after[i]]) if after[i] >= 0 else None
        return top if rank is None else rank * width + i

    tree = [top] * width + [leaf(i) for i in range(n)] + [top] * (width - n)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while tree[1] < top:
        rank, i = divmod(tree[1], width)
        gone = after[i]
        ids[i], after[i] = merged[rank], after[gone]
        if after[i] >= 0:
            before[after[i]] = i
        tree[width + gone], ids[gone] = top, -1
        for k in (gone, i, before[i]):
            if k >= 0:
                if k != gone:
                    tree[width + k] = leaf(k)
                k = (width + k) >> 1
                while k:
                    tree[k] = min(tree[2 * k], tree[2 * k + 1])
                    k >>= 1
    return [x for x in ids if x >= 0]


class Bpe:
    """Encoder and decoder of one vocabulary; holds a worker's store of pieces."""

    _made: dict[str, Bpe] = {}

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = regex.compile(PATTERN)
        self.odd = re.compile(r"\s\s|^\s|\s\Z")
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pieces: dict[str, bytes] = {}
        self.ranks: dict[int, int] | None = None
        self.table = np.array(vocabulary.tokens, object)

    @classmethod
    def of(cls, broadcast) -> Bpe:
        """The worker's encoder for a broadcast vocabulary."""
        vocabulary = broadcast.value
        if vocabulary.key not in cls._made:
            cls._made[vocabulary.key] = cls(vocabulary)
        return cls._made[vocabulary.key]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word by the segment trees; words of like lengths share an array."""
        if len(words) < FEW:
            if self.ranks is None:
                self.ranks = dict(zip(self.v.keys.tolist()[:-1], self.v.rank_of.tolist()[:-1], strict=True))
                self.merged, self.byte_ids = self.v.merged.tolist(), self.v.byte_ids.tolist()
            one = (merge_one(self.ranks, self.merged, [self.byte_ids[b] for b in w]) if w else [] for w in words)
            return [np.array(ids, "<u4").tobytes() for ids in one]
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            classes.setdefault(max(2, 1 << (len(word) - 1).bit_length()) if word else 0, []).append(i)
        for width, members in classes.items():
            if width:
                step = max(1, (1 << 19) // width)
                for k in range(0, len(members), step):
                    part = members[k : k + step]
                    for i, ids in zip(part, MergeTrees(self.v, [words[i] for i in part], width).run(), strict=True):
                        out[i] = ids
        return out

    def _encode_pieces(self, pieces: list[str]) -> None:
        """Adds the ids of pieces to the store."""
        cut = [self._words(p) for p in pieces]
        known = list(dict.fromkeys(w for words in cut for w in words if isinstance(w, str)))
        ids = {i: np.uint32(i).tobytes() for i in self.v.special.values()}
        ids |= dict(zip(known, self.merge_all([w.encode() for w in known]), strict=True))
        for piece, words in zip(pieces, cut, strict=True):
            self.pieces[piece] = b"".join([ids[w] for w in words])

    def _words(self, piece: str) -> list[str | int]:
        """Words of a piece, special tokens as ids."""
        if self.cut is None or not self.cut.search(piece):
            return self.pattern.findall(piece)
        parts = (x for x in self.cut.split(piece) if x)
        return [y for x in parts for y in ([self.v.special[x]] if x in self.v.special else self.pattern.findall(x))]

    def cut_pieces(self, text: str) -> list[str]:
        """Pieces of a text: it is cut before each single space or line feed between two that aren't white space."""
        if self.odd.search(text):
            return BOUND.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if "\0" not in text else BOUND.split(text)

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """Pieces of each text; the store holds the ids of them all. Null counts as empty."""
        laid, known = [self.cut_pieces(text or "") for text in texts], self.pieces
        new = {p: None for part in laid for p in part if p not in known}
        if len(known) + len(new) > KEPT:
            known.clear()
            new = dict.fromkeys(p for part in laid for p in part)
        self._encode_pieces(list(new))
        return laid

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text."""
        get = self.pieces.__getitem__
        return [b"".join(map(get, part)) for part in self.prepare(texts)]

    def pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that end where the pattern always cuts; the store keeps what prepare() has put there."""
        known = self.pieces
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            self._encode_pieces(new)
        return [known[p] for p in pieces]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.table[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


def load(spark, path: str):
    """Broadcast of a vocabulary file, whose size doesn't depend on the data; it is read on the driver."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def slices(column: pa.Array, most: int = 1 << 22):
    """Lists of values of a string column, of about ``most`` bytes each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *ends], [*ends, len(column)], strict=True):
        yield column.slice(a, b - a).to_pylist()


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>), the ids of each row's whole text, and ``lossless``, whether they decode to it again.

    Null and empty texts have no ids; repeated rows are repeated; columns of these names are replaced, others kept; an empty
    table gives an empty table. A very long text is encoded whole.
    """
    vocabulary, made = load(docs.sparkSession, path), ("ids", "lossless")

    def run(batches):
        bpe = Bpe.of(vocabulary)
        for batch in batches:
            parts, same = [], []
            for part in slices(batch.column(text)):
                parts += (encoded := bpe.encode(part))
                same += [bpe.decode(ids) == (x or "") for ids, x in zip(encoded, part, strict=True)]
            at = np.cumsum([0, *map(len, parts)]) // 4
            values = pa.array(np.frombuffer(b"".join(parts), "<u4").view("<i4"))
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            names = [n for n in batch.schema.names if n not in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, pa.array(same, pa.bool_())], [*names, *made])

    kept = docs.drop(*made)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "ids array<int>, lossless boolean"]))


def decode(docs: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """Adds the text of ``ids`` to each row: null and empty ids give an empty text, bytes that are no UTF-8 replacement
    characters. Repeated rows are repeated, a column of this name is replaced, others are kept, very long rows are decoded
    whole, an empty table gives an empty table."""
    vocabulary = load(docs.sparkSession, path)

    def run(batches):
        bpe = Bpe.of(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column("ids").to_pylist()]
            rest = [(n, batch.column(n)) for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in rest] + [pa.array(texts, pa.string())], [n for n, _ in rest] + [name]
            )

    kept = docs.drop(name)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"{name} string"]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: its text encoded, and the ids decoded again.

    Null and empty texts have no tokens; repeated rows come as often; other columns are ignored. The ids are digested
    where they are made, so only digests leave a task.
    """
    vocabulary = load(docs.sparkSession, path)

    def run(batches):
        bpe = Bpe.of(vocabulary)
        for batch in batches:
            counts, first, second = [], [], []
            for part in slices(batch.column("text")):
                for ids in bpe.encode(part):
                    counts.append(len(ids) // 4)
                    first.append(sha256(ids).hexdigest())
                    second.append(sha256(bpe.decode(ids).encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
