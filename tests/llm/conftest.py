import random

import pytest


def texts(seed=5, n=120, words=60):
    """Random texts with shared passages, copies, near copies and odd cases."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéABx") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    say = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(k))
    passages = [say(50) for _ in range(3)]
    rows = []
    for i in range(n):
        t = say(rng.randint(0, 80))
        if rng.random() < 0.5:
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice(passages) + t[k:]
        if rows and rng.random() < 0.25:
            t = rng.choice(rows)[1] or ""
            if rng.random() < 0.5 and t.split():
                w = t.split()
                w[rng.randrange(len(w))] = rng.choice(vocab)
                t = " ".join(w)
        rows.append((i, t))
    odd = [(1000, None), (1001, ""), (1002, " \n\t "), (None, say(50)), (None, rows[3][1]), (3, rows[3][1]), (4, "another text of id four"), (1003, "x " * 200), (1004, "ab" * 300), (1005, passages[0] * 3), (1006, say(3000)), (1007, "one two"), (1008, "\0 nul \0")]
    return rows + odd


@pytest.fixture(scope="session")
def odd_rows():
    return texts()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The texts with columns whose names clash with the operators' own."""
    rows = [(d, t, "k", 1, 2.0, None) for d, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, rid int, runs double, rhash string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
