"""A training corpus from documents: five stages, each of which keeps the columns of documents but for the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import bpe, mixing, pii, simhash, toxicity
from strandwise.llm.common import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. The network learns from the labels of documents that came in.

    Null and empty texts are scored as empty ones, rows without id and repeated rows stay or go by their text, all windows
    of very long texts are read, columns stay as they came, an empty table stays empty."""
    net = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, as ``simhash.keep_one`` chooses it. Null, empty and wordless texts
    form one group, repeated rows another of their text; columns stay as they came, an empty table stays empty."""
    return simhash.keep_one(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows, and is null for a null text, which stays null. Rows come as
    often as they came, very long texts are searched whole, other columns stay, an empty table stays empty."""
    renewed = pii.replace(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return renewed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it; columns as they came. Texts without words have size 0
    and stand before their successors, the null source is one of its own, an empty table stays empty."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, whether they decode to its text again, and its place in the training order.

    The stage before wrote the documents in this order: ``part`` is the number of a row's file, ``row`` its place within
    it; order by both. They are null where the documents don't come from files. Null and empty texts have no ids, repeated
    rows are encoded again, very long texts whole; an empty table gives an empty table.
    """
    try:
        place = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        place = docs.withColumns({"_file": F.lit(None).cast("string"), "row": F.lit(None).cast("bigint")})
    part = F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("int").alias("part")
    tokens = bpe.encode(place, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "lossless", part, "row")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", replace_private),
    ("mixing sources", mix_sources),
    ("bpe", encode_texts),
]

#: Fingerprints, a trained network and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each result written to the shared folder before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
