"""Near signatures, arrays of them, and signatures of matrices against brute force."""

import random
import statistics
from math import cos, pi

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dedup, graph, signatures
from marlstone.plans import catalog


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def walked(rng, n, steps=4):
    out = [rng.getrandbits(64)]
    while len(out) < n:
        base = rng.getrandbits(64) if rng.random() < 0.2 else rng.choice(out)
        for _ in range(rng.randint(0, steps)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return out


@pytest.mark.parametrize(("threshold", "most"), [(0, 512), (1, 512), (6, 512), (6, 1), (7, 3), (12, 512), (20, 512), (63, 512)])
def test_near_classes(spark, threshold, most):
    """Every pair once, whether keys are narrowed (``most``) or not."""
    own = list(enumerate(dict.fromkeys(walked(random.Random(threshold), 150))))
    df = spark.createDataFrame([(i, signed(s), 1) for i, s in own], "id long, s long, n long")
    want = sorted((a, b, (x ^ y).bit_count()) for a, x in own for b, y in own if a < b and (x ^ y).bit_count() <= threshold)
    assert sorted(map(tuple, signatures.near_classes(df, threshold, most).collect())) == want


@pytest.mark.parametrize("order", range(3))
def test_keys_of_a_cut(order):
    """Each key's bands are whole, any two signatures within the threshold share one, and one key is their first."""
    rng = random.Random(order)
    masks, skipped = signatures.cut(6, order)
    assert len(masks) == 84 and all(m.bit_count() in range(20, 25) for m in masks)
    for _ in range(300):
        x = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6)))
        first = [i for i, m in enumerate(masks) if not x & m and all(x & s for s in skipped[i])]
        assert len(first) == 1


@pytest.mark.parametrize(("threshold", "most"), [(6, 512), (5, 2), (1, 512)])
def test_near_arrays(spark, threshold, most):
    rng = random.Random(threshold)
    own = {}
    pool = walked(rng, 30, 12)
    for i in range(110):
        a = [rng.choice(pool) for _ in range(rng.randint(1, 4))] if i % 3 == 0 or not own else list(rng.choice(list(own.values())))
        if rng.random() < 0.5:
            a = a + [a[-1]] * rng.randint(0, 2) if rng.random() < 0.7 else a[: rng.randint(1, len(a))]
        for k in range(len(a)):
            for _ in range(rng.choice([0, 3, 8])):
                a[k] ^= 1 << rng.randrange(64)
        own[i] = a
    distinct = {tuple(a): i for i, a in reversed(own.items())}

    def distance(a, b):
        n = max(len(a), len(b))
        a, b = (list(x) + [x[-1]] * (n - len(x)) for x in (a, b))
        return round(sum((x ^ y).bit_count() for x, y in zip(a, b)) / n)

    want = sorted((i, j, distance(x, y)) for x, i in distinct.items() for y, j in distinct.items() if i < j and distance(x, y) <= threshold)
    assert len(want) > 5
    rows = spark.createDataFrame([(i, [signed(x) for x in a]) for i, a in own.items()] + [(500, []), (501, None)], "id long, s array<bigint>")
    classes = signatures.classes_of(rows, "id", "s")
    assert sorted(map(tuple, signatures.near_arrays(classes, threshold, most).collect())) == want
    assert {r["id"]: r["class_id"] for r in signatures.members(rows, "id", "s").collect()} == {i: distinct[tuple(a)] for i, a in own.items()} | {500: 500}


def test_candidates_of_word_signatures_are_few(spark):
    """Pairs of rows that share a key, at six bits, against the pairs that are near."""
    sigs = catalog.document_signatures(spark, "/root/testdata/sf0.01")
    classes = signatures.classes_of(sigs, "doc_id", "sig")
    found = signatures.near_classes(classes, 6).count()
    rows = signatures.keyed(classes, 6, 0)
    same = (F.col("l.c0") == F.col("r.c0")) & (F.col("l.v0") == F.col("r.v0")) & (F.col("l.id") < F.col("r.id"))
    candidates = rows.alias("l").join(rows.alias("r"), same).select("l.id", "r.id").toDF("a", "b").distinct().count()
    assert 50 < found <= candidates <= 20 * found


def test_matrix_signatures(spark):
    rng = random.Random(1)
    own = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(20)] + [(90, None), (91, [1.0]), (92, [None] * 64), (93, [0.5] * 64)]
    df = spark.createDataFrame(own, "id long, v array<double>")
    got = {r["id"]: r["sig"] for r in df.select("id", signatures.matrix_signature(F.col("v")).alias("sig")).collect()}
    assert got[90] is None and got[91] is None and got[92] is None and len(got[93]) == 16
    for i, v in own[:20]:
        f = [
            sum(v[y * 8 + x] * 4 * cos(pi * (2 * y + 1) * u / 16) * cos(pi * (2 * x + 1) * w / 16) for y in range(8) for x in range(8)) for u in range(4) for w in range(4)
        ]
        m = statistics.median(f)
        assert got[i] == "".join("1" if x > m else "0" for x in f)


def skew_ready(df):
    """Whether a shuffled join of the plan has an exchange without an aggregate above it on both sides."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Join" in plan and "Aggregate" not in plan


def test_hub_of_many_edges(spark):
    """A vertex with most edges: the aggregates are tables, so the joins on it have plain exchanges on both sides."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(50)]
    roots = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["u"]: r["root"] for r in roots.collect()} == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(51)}
    df = spark.createDataFrame([(i, "same" if i % 3 else str(i)) for i in range(300)], "id long, digest string")
    plan = dedup.keep_delete(df, "digest", "id", [])
    assert plan.count() == 199 and skew_ready(plan)


def test_rows_have_few_keys_and_stay_out_of_the_driver(spark):
    """Spark takes a table for as small as it is before its rows get their keys, and would broadcast all of these."""
    df = spark.createDataFrame([(i, i * 7919, 1) for i in range(50)], "id long, s long, n long")
    plan = signatures.near_classes(df, 6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert signatures.keyed(df, 6, 1).count() == 50 * 7
    assert signatures.keyed(df, 6, 0, bands=signatures.PLACE_BANDS).count() == 50 * 28


def test_word_signatures_of_long_items(spark):
    """Counts that share a number don't run into each other."""
    words = spark.range(70_000).selectExpr("id % 2 as k", "if(id % 5 < 3, 'x', concat('y', id % 3)) as word")
    got = {r["k"]: r["sig"] for r in signatures.word_signatures(words, ["k"]).collect()}
    import hashlib

    x = int.from_bytes(hashlib.md5(b"x").digest()[:8], "big")
    assert got == {0: signed(x), 1: signed(x)}


def test_first_keys_are_compiled(spark):
    """What a pair is asked under each key that it shares is arithmetic, not a function over arrays that is interpreted."""
    df = spark.createDataFrame([(i, i * 7919, 1) for i in range(50)], "id long, s long, n long")
    assert "forall" not in signatures.near_classes(df, 6)._jdf.queryExecution().executedPlan().toString().lower()
