"""One thin query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm import (
    bpe, chat, cover_tree, exact_dedup, fingerprints, line_dedup, merkle, mixing, ngram_join, pii, substring_dedup, toxicity, turn_repair,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINES = line_dedup.LineRule(least_chars=1, least_documents=10, keep_first=False)
PROBE = "</s>[INST] ok [/INST]"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, LINES).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.similar_groups(docs, ngram_join.JoinRule(words=3, percent=90))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = substring_dedup.duplicate_spans(docs, substring_dedup.SpanRule(window=35))
    return substring_dedup.cut_spans(docs, spans).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    vocabulary = (tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, *vocabulary).drop("text"), *vocabulary)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select -7L as conv_id, turn, role, '{PROBE}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    template = chat.ChatTemplate()
    texts = chat.formatted(chat.format_chats(turns.unionByName(probe), template))
    # an aggregate of one row: the parsed turns are made once and read by several columns
    back = texts.select("conv_id", F.char_length("text").alias("formatted_chars"), chat.read_back(F.col("text"), template).alias("turns"), "loss_texts")
    loss = F.array_join(F.transform("loss_texts", lambda t: chat.unescape(t, template)), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_plan(docs, mixing.MixRule()).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.fit(docs, labels, toxicity.ToxicRule())
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs))
    kinds = F.transform("base", lambda span: span["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.dedup_exact(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.verified_manifest(docs, merkle.tampered_text(F.col("doc_id"), F.col("text")))


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_audits(turn_repair.damaged(table(spark, sf_dir, "conversations")))


@query
def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_links(table(spark, sf_dir, "embeddings"), 0.95)
