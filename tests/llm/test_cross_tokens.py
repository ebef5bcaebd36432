"""Alignment of two tokenizers against loops over whole texts as the libraries encode them."""

import hashlib
import random
from bisect import bisect, bisect_left
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.llm import cross_tokens, queries
from strandwise.llm.common import read_table

ALPHABET = [*"abcdeT '’sréß.,!\n\n  \t\r\x1c\x85\xa0 　  中文²½9\x00", "<|endoftext|>", "<s>", "<0x41>", "'re", " the", " word", "\nOn", "\n\n", "Привет ", "한국 "]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    from strandwise.llm.bpe import Vocabulary

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), Vocabulary(P.path("byte_bpe_50k.json")).tokens


def by_loop(texts, libraries):
    """The contract's columns of each text, and nothing of units."""
    a_lib, b_lib, a_bytes = libraries
    piece = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    rows, holds = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = a_lib.encode(raw.decode(), add_special_tokens=False).ids, b_lib.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(map(piece, b)) != raw:
            rows.append((0, 0, 0, [], ""))
            continue
        ends = []
        for ids, size in ((a, lambda i: len(a_bytes[i])), (b, lambda i: len(piece(i)))):
            at, own = 0, []
            for i in ids:
                own.append((at, at + size(i), i))
                at += size(i)
            ends.append(own)
        starts = [s for s, _, _ in ends[1]]
        links = [(x[2], y[2]) for x in ends[0] for y in ends[1][max(0, bisect(starts, x[0]) - 1) : bisect(starts, x[1])] if x[0] < y[1] and y[0] < x[1]]
        common, parts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]}), []
        for low, high in zip([0, *common], common, strict=False):
            parts.append("|".join(",".join(str(i) for s, _, i in own[bisect_left(own, (low,)) :][: high - low] if s < high) for own in ends))
        holds.update(set(links))
        rows.append((len(a), len(b), len(common), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    top = Counter()
    for (a, _), n in holds.items():
        top[a] = max(top[a], n)
    return [(na, nb, g, len(k), sum(holds[x] == top[x[0]] for x in k), sum(holds[x] for x in k), sha) for na, nb, g, k, sha in rows]


@pytest.mark.parametrize("most", [cross_tokens.ROUND, 50])
def test_random_texts(spark, libraries, monkeypatch, most):
    r = random.Random(5)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += [None, "", " ", "\n", " a", "a ▁b", "one two", "one two", "x" * 3000, "a b " * 2000]
    monkeypatch.setattr(cross_tokens, "HELD", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {row[0]: tuple(row[1:]) for row in cross_tokens.align_tokenizers(docs, *queries.tokenizer_paths(), most).collect()}
    assert [found[i] for i in range(len(texts))] == by_loop(texts, libraries)


def test_documents(spark, sf, libraries):
    rows = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    found = {row.doc_id: tuple(row)[1:] for row in queries.op12_cross_tokenizer(spark, sf).collect()}
    assert found == dict(zip([x.doc_id for x in rows], by_loop([x.text for x in rows], libraries), strict=True))


def test_odd_tables(spark, libraries):
    """Rows without id, repeated rows, clashing columns and no rows."""
    docs = spark.createDataFrame([(None, "one"), (1, None), (2, "one"), (2, "one"), (3, "")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "pair", "times", "n", "links", "n_a", "best")})
    found = sorted(map(tuple, cross_tokens.align_tokenizers(docs, *queries.tokenizer_paths()).collect()), key=str)
    empty, one = (0, 0, 0, 0, 0, 0, ""), by_loop(["one"] * 3, libraries)[0]
    assert found == [(1, *empty), (2, *one), (2, *one), (3, *empty), (None, *one)] and one[5] == 3
    assert cross_tokens.align_tokenizers(docs.limit(0), *queries.tokenizer_paths()).count() == 0
