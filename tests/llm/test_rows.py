"""Every operator on odd tables: nulls, empty and long texts, repeated rows, no rows, extra columns of clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandwise.llm import bpe, chat, fingerprints, media, mixing, passages, pii, queries, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "bucket fp text_ ids lossless score size target taken copies kind _size _digest _found _doc _map key n_entities component_id".split()
ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "one two three four five six", "en", "b", 27),
    (4, "one two three four five six", "en", "b", 27),
    (None, "seven eight nine", "en", "b", 16),
    (5, "word " * 30_000, "en", None, 150_000),
    (6, " \t\n ", "en", "c", 4),
    (7, "é中文😀<|endoftext|> mail a.b@c.example.com", "zh", "c", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.withColumns({c: F.lit(c) for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def path():
    return queries.vocabulary_path()


def same_columns(docs):
    return [c for c in docs.columns if c not in ("ids", "lossless", "score", "n_entities")]


OPERATORS = {
    "fingerprints": (fingerprints.op1_document_fingerprints, len(ROWS)),
    "passages": (passages.near_passages, 0),
    "plan": (mixing.op3_mix_sources, len(ROWS)),
    "counts": (lambda d: token_counts.count_edits(d, path()), len(ROWS)),
    "simhash": (simhash.op6_simhash_near_dedup, len(ROWS)),
    "round trip": (lambda d: bpe.round_trip(d, path()), len(ROWS)),
    "surrogates": (pii.replace, len(ROWS)),
    "encode": (lambda d: bpe.encode(d, path()), len(ROWS)),
    "score": (lambda d: toxicity.score(d, toxicity.Network()), len(ROWS)),
    "media": (lambda d: media.features(media.store(d)), len(ROWS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, none, name):
    operator, n = OPERATORS[name]
    assert operator(odd).count() == n
    assert operator(none).count() == 0


@pytest.mark.parametrize("name", ["encode", "score", "surrogates"])
def test_columns_stay(odd, name):
    out = OPERATORS[name][0](odd)
    kept = same_columns(odd)
    assert set(kept) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert out.where("bucket != 'bucket' or key != 'key'").count() == 0


def test_mix_keeps_columns(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and mixing.mix(none).count() == 0
    assert out.where("target != 'target' or _doc != '_doc'").count() == 0


def test_keep_one(odd, none):
    kept = [r.doc_id for r in simhash.keep_one(odd).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 5, 7] and kept.count(None) == 1
    assert simhash.keep_one(none).count() == 0


def test_equal_texts_have_equal_media_and_round_trips(odd):
    rows = {r.doc_id: r for r in media.features(media.store(odd)).collect()}
    assert rows[1].media_sha256 == rows[4].media_sha256 and rows[1].feature == rows[4].feature
    payload = ROWS[0][1].encode().ljust(192)
    assert rows[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[2].payload_bytes == 192
    trips = {r.doc_id: r for r in bpe.round_trip(odd, path()).collect()}
    assert trips[7].decoded_sha256 == hashlib.sha256(ROWS[8][1].encode()).hexdigest() and trips[3].n_tokens == 0


def test_chat_rows(spark):
    rows = [
        (1, 1, "assistant", "x <|im_end|> y <\\|z"),
        (1, 0, "user", None),
        (1, 1, "assistant", "x <|im_end|> y <\\|z"),
        (2, None, None, ""),
        (None, 3, "assi\nstant%", "中文" * 5000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    found = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    said = ("user\n\n" + "assistant\nx <|im_end|> y <\\|z\n" * 2).encode()
    assert found[1].n_turns == 3 and found[1].turns_sha256 == hashlib.sha256(said).hexdigest()
    assert found[1].loss_sha256 == hashlib.sha256(("x <|im_end|> y <\\|z" * 2).encode()).hexdigest()
    assert found[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and found[2].loss_chars == 0
    assert found[None].turns_sha256 == hashlib.sha256(("assi\nstant%\n" + "中文" * 5000 + "\n").encode()).hexdigest()
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0
    for text in (b"<|", b"<\\|", b"<\\\\|<||", b"a<b|c"):
        assert chat.unescape(chat.escape(text)) == text and b"<|" not in chat.escape(text)


def test_a_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        turns = spark.range(100).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
        found = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
        text = "".join(str(i) for i in range(0, 100, 2))
        assert found[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and found[0].n_turns == 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
