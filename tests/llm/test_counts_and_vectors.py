"""Operators 11 and 12 against the tokenizer library and plain linear algebra."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import queries, token_counts, whitening

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = list("abcdeLRVMST'''!?-.,<|> \n\t0123éÉßñÀ中日İΣσẹ́가ᅡᆨােⅣK\U0001F600‍\xa0\x1c\x85ﬁ१") + ["'ll", "'re", "'ve", "<|endoftext|>", "<|startoftext|>", "<|endoftex", "<|ENDOFTEXT|>", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda s: len(tok.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounts(PATH)


def test_every_prefix(library, counter):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    for text, steps in zip(texts, counter.steps(texts), strict=True):
        want = [library(text[:p]) for p in range(len(text) + 1)]
        assert counter.counts(text) == want
        assert [0, *np.cumsum(steps, dtype=int)] == want


def test_letters_in_blocks(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 100)
    monkeypatch.setattr(token_counts, "PAIRS", 1 << 21)
    rng = random.Random(3)
    words = ["".join(rng.choice("aaeinstthrouéüñßÀÖZQ") for _ in range(rng.randint(1, 48))) for _ in range(700)]
    for word, steps in zip(words, counter.words.steps(words), strict=True):
        assert np.cumsum(np.frombuffer(steps, np.int8)).tolist() == [library(word[: p + 1]) for p in range(len(word))]


def test_long_unspaced_texts(library, counter):
    rng = random.Random(4)
    for text in ("a" * 5000, "".join(rng.choice("abé中1'") for _ in range(4000)), "é" * 600, "x" + "̣́" * 300):
        counts = counter.counts(text)
        assert counts[-1] == library(text) and len(counts) == len(text) + 1
        for p in rng.sample(range(len(text)), 20):
            assert counts[p] == library(text[:p])


def test_steps_wider_than_a_byte(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "packed_steps", lambda counts: np.diff(counts).astype("<i4").tobytes())
    counter = token_counts.PrefixCounts(PATH)
    got = counter.steps(["12 can't 中中 x", "", " 1"])
    assert [s.sum() for s in got] == [counter.counts(t)[-1] for t in ("12 can't 中中 x", "", " 1")]


def test_rows_and_budgets(spark, odd_docs, odd_rows, no_docs, library):
    counts = token_counts.count_tokens(odd_docs, PATH, limit=40, with_steps=True)
    got = sorted((tuple(r) for r in counts.drop("steps").collect()), key=str)
    want = [(d, len((t or "").encode()), len(t or ""), library(t or ""), library(t or "") > 40) for d, t in odd_rows]
    assert got == sorted(want, key=str)
    texts = {d: t or "" for d, t in odd_rows if d is not None and d not in (3, 4)}
    for r in token_counts.cut_to(counts, [0, 7, 100]).collect():
        if r["doc_id"] in texts and len(texts[r["doc_id"]]) < 600:
            t = texts[r["doc_id"]]
            fits = [p for p in range(len(t) + 1) if library(t[:p]) <= r["budget"]]
            assert (r["n_chars"], r["n_tokens"]) == (max(fits), library(t[: max(fits)]))
    assert token_counts.count_tokens(no_docs, PATH).count() == 0
    assert token_counts.cut_to(token_counts.count_tokens(no_docs, PATH, with_steps=True), [3]).count() == 0


def test_counts_of_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op11_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = library(r["text"] or "")
        assert got[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 2048)


def check_whitened(rows, vectors, k):
    """Rows of the operator against eigenvectors of the exact covariance of ``vectors`` ((id, whole numbers))."""
    x = np.array([v for _, v in vectors], object)
    n, d = x.shape
    sums = x.sum(axis=0)
    off = x * n - sums
    cov = (off.T.dot(off)).astype(np.float64) / n**3
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == n * min(k, d)
    white = {}
    for r in rows:
        assert r["n"] == n and math.isclose(r["explained"], values[r["component"] - 1] / np.trace(cov), rel_tol=1e-6, abs_tol=1e-12)
        assert r["identity_error"] <= 1e-7
        white.setdefault(r["vec_id"], {})[r["component"]] = (r["whitened"], r["deviation"])
    for c in range(1, min(k, d) + 1):
        if values[c - 1] <= 1e-9 * values[0]:
            assert all(w[c][0] is None for w in white.values())
            continue
        want = (off.astype(np.float64) / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([white[i][c][0] for i, _ in vectors])
        assert np.allclose(got, want, atol=1e-6) or np.allclose(got, -want, atol=1e-6)
        assert [white[i][c][1] for i, _ in vectors] == (off * off).sum(axis=1).tolist()


def test_whitening_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_whitening(spark, sf).collect()
    vectors = [(r["vec_id"], [math.floor(64 * float(c)) + 1_000_000 for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitened(rows, vectors, 32)


def test_whitening_of_odd_vectors(spark):
    rng = random.Random(5)
    base = [(i, [rng.gauss(0, 3) for _ in range(5)]) for i in range(300)]
    base = [(i, [a, b, c, d, a + b]) for i, (a, b, c, d, e) in base[:200]] + [(i, [50.0, 50.0, 1.0, 2.0, 100.0]) for i, _ in base[200:]]
    odd = [(1000, None), (1001, [1.0, None, 2.0, 3.0, 4.0]), (1002, [float("nan")] * 5), (1003, [float("inf")] + [0.0] * 4), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in base + odd], "vec_id long, embedding array<double>, n int, whitened string").repartition(7)
    numbers = df.withColumn("x", whitening.whole_numbers(F.col("embedding"), 64, 1_000_000))
    rows = whitening.whiten(numbers).collect()
    check_whitened(rows, [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in base], 32)
    assert whitening.whiten(numbers.limit(0)).count() == 0
    assert whitening.whiten(numbers.filter("vec_id = 1004")).count() == 0
    one = whitening.whiten(numbers.filter("vec_id = 3")).collect()
    assert len(one) == 5 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in one)


def test_numbers_beyond_64_bits(spark):
    big = [(i, [(i % 7) << 58, i]) for i in range(40)] + [(None, [3 << 60, 5]), (None, [3 << 60, 5])]
    rows = whitening.whiten(spark.createDataFrame(big, "vec_id long, x array<bigint>"), components=1).collect()
    assert len(rows) == 42 and all(r["deviation"] is None for r in rows) and rows[0]["identity_error"] < 1e-9
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, v array<double>").select("vec_id", whitening.whole_numbers(F.col("v"), 64, 5).alias("x"))
    assert [r["x"] for r in huge.orderBy("vec_id").collect()] == [[(1 << 62) + 5, 5], [5 - (1 << 62), 69]]


def test_states_merge_as_one():
    rng = np.random.default_rng(6)
    small = rng.integers(-1000, 1000, (500, 4))
    x = small + 10**12
    parts = [whitening.state_of(p) for p in np.array_split(x, 9)]
    out = whitening.pair_up(iter(parts))
    whole = (small - small.mean(axis=0)).T @ (small - small.mean(axis=0))
    assert out.n == 500 and (out.sums == x.sum(axis=0)).all() and np.allclose(out.scatter, whole, rtol=1e-12)
