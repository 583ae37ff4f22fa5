"""A corpus pipeline over ``documents``: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet and reads it again as
the next stage's docs.  All but the last return the columns of documents.  Quality and leaks are decided where a row
lies, without a shuffle; decisions on groups go back to rows by doc_id and the text's hash, null-safe, so that
repeated and null ids need no special case:

* a null text is scored, packed and compared like an empty one and stays null;
* rows that agree in doc_id and text are one document: near-dedup keeps one of them;
* an empty table passes through every stage;
* columns beside doc_id, text and n_chars pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.decontaminate import without_contaminated
from marlstone.llm.near_dups import find_near_dups
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality import accepted_documents
from marlstone.llm.queries import tokenizer
from marlstone.llm.suffix_dedup import without_repeats
from marlstone.sources.storage import scratch, stored, table

#: Documents scored below this are rejected: label 1 must not be the less likely one.
LEAST_SCORE = 0.5
#: Similarity in per cent, and words of a shingle, of near-duplicates.
SIMILARITY, SHINGLE = 80, 5
#: Bytes of a passage that counts as repeated; fifty words of any of the languages are longer.
PASSAGE_BYTES = 200
#: Chunks whose ids a Python worker remembers: few, as it keeps them beside the other stages' needs.
CACHE_ENTRIES = 400_000


def _same_row() -> list[Column]:
    """Decisions (k) at the documents (d) they were made for."""
    return [F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")), F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("k.rhash")]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, doesn't reject."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id (null last)."""
    with scratch(spark):
        stays = find_near_dups(docs, shingle=SHINGLE, similarity=SIMILARITY).filter("stays")
        kept = stored(stays.groupBy("doc_id", "rhash").agg(F.count("*").alias("copies")), "kept", keep=True)
    rows = lambda which: docs.alias("d").join(kept.filter(which).alias("k"), _same_row(), "left_semi")
    if kept.filter("copies > 1").isEmpty():
        return rows("true")
    # Rows that agree in id and text are one document.
    return rows("copies = 1").unionByName(rows("copies > 1").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the byte strings that also occur elsewhere."""
    return without_repeats(docs, min_bytes=PASSAGE_BYTES, chars_col="n_chars" if "n_chars" in docs.columns else None)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), cache_entries=CACHE_ENTRIES)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage stored for itself is deleted once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
