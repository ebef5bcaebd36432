"""Edit-aware token counts: a segment tree of pre-tokens for each document.

The pre-tokens of a text are gathered in leaves of a few pieces; pieces end where the vocabulary's pattern always cuts
(before a single space or line feed between two characters that aren't white space). Each node of the tree holds the
characters and the tokens below it. An edit is located by descending along the characters; the leaves that it touches
are cut and counted anew, together with their neighbours if the edit comes within a character of their bounds, since
such a bound may cease to be one. Sums change along the paths from these leaves only.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Bpe, load, slices

#: Pieces in a leaf.
LEAF = 16
#: An edit (start, end, new): the characters from start to end are replaced by new.
Edit = tuple[int, int, str]


class CountTree:
    """Counts of one document's tokens that follow its edits."""

    def __init__(self, bpe: Bpe, text: str, pieces: list[str] | None = None):
        """``pieces``: those of the text as Bpe.prepare() has just returned them."""
        self.bpe, self.recounted = bpe, 0
        self._build(text, pieces)

    def _build(self, text: str, pieces: list[str] | None = None) -> None:
        if pieces is None:
            pieces = self.bpe.prepare([text])[0]
        self.pieces = n = len(pieces)
        chars = np.fromiter(map(len, pieces), np.int64, n)
        tokens = np.fromiter(map(len, map(self.bpe.pieces.__getitem__, pieces)), np.int64, n) >> 2
        at = np.arange(0, n, LEAF)
        chars = np.add.reduceat(chars, at)
        ends = np.cumsum(chars).tolist()
        self.leaves = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.width = 1 << (len(at) - 1).bit_length()
        levels = [np.zeros((self.width, 2), np.int64)]
        levels[0][: len(at), 0] = chars
        levels[0][: len(at), 1] = np.add.reduceat(tokens, at)
        while len(levels[-1]) > 1:
            levels.append(levels[-1][::2] + levels[-1][1::2])
        self.chars, self.tokens = np.concatenate([np.zeros((1, 2), np.int64), *levels[::-1]]).T.tolist()

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character and the number of characters before the leaf; the last leaf at the end."""
        node, before = 1, 0
        while node < self.width:
            left = self.chars[2 * node]
            node *= 2
            if place >= before + left and self.chars[node + 1]:
                before += left
                node += 1
        return node - self.width, before

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node >>= 1

    def edit(self, start: int, end: int, new: str) -> int:
        """Applies an edit and returns the new number of tokens."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        # a bound depends on the characters on both of its sides
        first, before = self._find(max(start - 2, 0))
        last, _ = self._find(min(end + 2, self.n_chars))
        held = "".join(self.leaves[first : last + 1])
        held = held[: start - before] + new + held[end - before :]
        pieces = self.bpe.cut_pieces(held)
        self.recounted += len(pieces)
        if len(pieces) > 64 * LEAF * (1 + last - first):
            self.leaves[first : last + 1] = [held]
            self._build(self.text)
            return self.n_tokens
        self.leaves[first] = held
        self._put(first, len(held), sum(map(len, self.bpe.pieces_ids(pieces))) >> 2)
        for leaf in range(first + 1, last + 1):
            self.leaves[leaf] = ""
            self._put(leaf, 0, 0)
        return self.n_tokens


def standard_edits(text: str) -> list[Edit]:
    """Three edits that depend on the text alone: a word comes in after a third, a span goes in the middle, and
    characters near the end are written anew. Places hold for the text as the edits before have left it."""
    n = len(text)
    return [(n // 3, n // 3, " inserted"), (n // 2, n // 2 + min(n // 10, 64), ""), (2 * n // 3, 2 * n // 3 + 5, "Edit's ")]


def count_edits(docs: DataFrame, path: str, edits=standard_edits) -> DataFrame:
    """(doc_id, n_tokens, n_pieces, edited_sha256, edited_tokens, recounted_pieces) of each row.

    ``edits`` gives the edits of a whole text; edited_tokens is the count after all of them, recounted_pieces how many
    pieces had to be counted for it. A null text counts as empty, edits beyond its end are moved to the end; repeated
    rows come as often as they came; other columns are ignored; an empty table gives an empty table.
    """
    vocabulary = load(docs.sparkSession, path)
    types = {
        "n_tokens": pa.int64(),
        "n_pieces": pa.int64(),
        "edited_sha256": pa.string(),
        "edited_tokens": pa.int64(),
        "recounted_pieces": pa.int64(),
    }

    def run(batches):
        bpe = Bpe.of(vocabulary)
        for batch in batches:
            rows = []
            for part in slices(batch.column("text")):
                for text, cut in zip(part, bpe.prepare(part), strict=True):
                    text = text or ""
                    tree = CountTree(bpe, text, cut)
                    at_first, pieces = tree.n_tokens, tree.pieces
                    for edit in edits(text):
                        tree.edit(*edit)
                    digest = sha256(tree.text.encode()).hexdigest()
                    rows.append((at_first, pieces, digest, tree.n_tokens, tree.recounted))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *types])

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in types.items())
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {names}")
