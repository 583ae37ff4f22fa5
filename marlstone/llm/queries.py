"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat import format_conversations, read_back
from ..sources.storage import table
from .decontaminate import find_contamination
from .idstore import scan_store, write_store
from .near_dups import find_near_dups
from .packing import pack_documents
from .quality import score_documents
from .recompression import remove_repeated_words
from .spelling import counted_words, group_spellings
from .suffix_dedup import remove_repeats
from .syncmers import fingerprint_edits
from .token_counts import count_tokens
from .urls import judge_urls
from .whitening import whiten, whole_numbers

#: The rules of query 10.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_dups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    scores = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held_out)
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_store(spark, write_store(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding"), 64, 1_000_000).alias("x"))
    return whiten(vectors)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(counted_words(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_syncmers": op2_syncmers,
        "op3_recompression": op3_recompression,
        "op4_near_dups": op4_near_dups,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_token_ids": op7_token_ids,
        "op8_chat": op8_chat,
        "op9_decontamination": op9_decontamination,
        "op10_urls": op10_urls,
        "op11_token_counts": op11_token_counts,
        "op12_whitening": op12_whitening,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    """None for op2 (its hashes), op5, op7 and op11 (the tokenizer), op6 (the classifier) and op12 (eigenvectors): tests hold
    them against brute force, an exact round trip, the library and held-out labels."""
    return {
        "op1_suffix_dedup": oracles.OP1,
        "op3_recompression": oracles.OP3,
        "op4_near_dups": oracles.OP4,
        "op8_chat": oracles.OP8,
        "op9_decontamination": oracles.OP9,
        "op10_urls": oracles.OP10,
        "op13_spelling": oracles.OP13,
    }
