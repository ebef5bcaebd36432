"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, conversation_trie, cross_tokens, fingerprints, media, mixing, passages, pii, quality, simhash, token_counts, toxicity
from .common import read_table


def vocabulary_path() -> str:
    """Where the public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_paths() -> tuple[str, str]:
    """Where the vocabularies of the two tokenizers lie that are held against each other."""
    import public_tokenizers

    return vocabulary_path(), public_tokenizers.path("piece_bpe_32k.model")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.op1_document_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that nearly repeat one of another document."""
    return passages.near_passages(read_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.op3_mix_sources(read_table(spark, sf_dir, "documents"))


def op3_training_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training position of every copy that the mix takes."""
    return mixing.op3_training_positions(read_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one of control strings."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chat(turns.unionByName(chat.control_conversation(spark))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits."""
    return token_counts.count_edits(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.op6_simhash_near_dedup(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data."""
    return pii.replace(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.op9_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as WAV, read back and fingerprinted."""
    return media.features(media.store(read_table(spark, sf_dir, "documents")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.op11_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie on each other in every document."""
    return cross_tokens.align_tokenizers(read_table(spark, sf_dir, "documents"), *tokenizer_paths())


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_substring_dedup,
        op3_mix_sources,
        op3_training_positions,
        op4_chat_format,
        op5_token_counts,
        op6_simhash_near_dedup,
        op7_bpe,
        op8_pii,
        op9_toxicity,
        op10_media,
        op11_quality,
        op12_cross_tokenizer,
        op13_conversation_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": mixing.ORACLE_SQL,
    "op3_training_positions": mixing.POSITIONS_SQL,
    "op4_chat_format": chat.ORACLE_SQL,
    "op13_conversation_trie": conversation_trie.ORACLE_SQL,
}
