"""Operator 13 against comparing all words with each other."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, spelling

from . import brute


def grouped(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.group_spellings(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters, size", [("ab", 5), ("aab", 9), ("abcéÿ\U0001f600", 4), ("abcdefghijklmnopqrstuvwxyz", 2)])
def test_dense_words(spark, letters, size):
    """Few letters: nearly every word has partners, at every depth and of every kind."""
    rng = random.Random(size)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, size))): rng.choice([1, 1, 2, 3, 5, 8, 20]) for _ in range(260)}
    assert grouped(spark, words) == sorted(brute.spellings(words))


def test_prefixes_of_each_other_and_long_words(spark):
    words = {"a" * k: 3 ** (k % 4) for k in range(1, 40)} | {"x" * 30000: 4, "x" * 29999: 1, "x" * 12000 + "y" + "x" * 17999: 2, "x" * 29998 + "yy": 9}
    assert grouped(spark, words) == sorted(brute.spellings(words))


def test_long_chain_of_forms(spark):
    words = {"b" * k + "a" * (40 - k): 2**k for k in range(41)}
    got = grouped(spark, words)
    assert got == sorted(brute.spellings(words)) and {r[2] for r in got} == {"b" * 40}


def test_words_of_documents(spark, odd_rows, odd_docs, no_docs):
    rows = [(d, f"{t or ''} {'éÀÈß×÷Z' * 3} Paßwort paßwort PASSWORT") if d is not None and d % 3 == 0 else (d, t) for d, t in odd_rows]
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    for deletes in (97, 2, 0):
        want = brute.spelt_words(rows, deletes=deletes)
        assert {r["word"]: r["n"] for r in spelling.counted_words(docs, deletes=deletes).collect()} == want
    assert len(want) > 20
    assert spelling.group_spellings(spelling.counted_words(no_docs)).count() == 0
    assert spelling.counted_words(spark.createDataFrame([(None, None), (1, ""), (2, "ab cd")], "doc_id long, text string")).count() == 0


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_spelling(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == sorted(brute.spellings(brute.spelt_words(docs)))


def test_light_edges_are_few(spark):
    """At most log2(words) light edges a word, so at most four times as many entries, however dense the words are."""
    words = spark.range(4096).select(F.translate(F.lpad(F.bin("id"), 12, "0"), "01", "ab").alias("word"), F.lit(1).alias("n"))
    words = words.withColumn("wid", F.monotonically_increasing_id())
    assert spelling.light_edges(words).agg(F.max(F.size("edges"))).first()[0] <= 12
    assert spelling.entries(words).count() <= 4 * 12 * 4096 // 2
