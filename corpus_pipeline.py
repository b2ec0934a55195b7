"""The corpus pipeline: documents pass the stages in order, each stored before the next.

Every stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns
doc_id, source, n_tokens and ids. Documents that the toxicity model rejects go; of lines found in ten
documents only the first stays, so of equal documents the smallest doc_id keeps its text, less lines that stand earlier, also in
itself (the others become empty, and stay until the mix); of each group of near copies the smallest doc_id stays; sources are
mixed to their targets, so a document may come up to three times, the last time cut; what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from linewise.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LINES = line_dedup.LineRule(least_chars=1, least_documents=10, keep_first=True)
NEAR = ngram_join.JoinRule(words=5, percent=80)
MIX = mixing.MixRule()
VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    return toxicity.keep_harmless(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    aside = {name: f"__own_{name}" for name in line_dedup.COUNTERS if name in docs.columns}
    kept = line_dedup.drop_repeated_lines(docs.withColumnsRenamed(aside), LINES).drop(*line_dedup.COUNTERS)
    kept = kept.withColumnsRenamed({own: name for name, own in aside.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encode(docs.select("doc_id", "source", "text"), *VOCABULARY).drop("text")
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None  # learned scores and token ids have no SQL form; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
