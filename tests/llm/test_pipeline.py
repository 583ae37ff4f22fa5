"""The pipeline's stages against brute force, on a fixture and on odd rows."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from marlstone.llm import queries
from tests.oracle import compare

from . import brute

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def own(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_keeps_clean(spark, docs):
    kept = STAGES["quality classifier"](spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {d for d, _ in own(kept)}
    right = [(d in ids) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.97 * len(right)


def test_near_duplicates(spark, docs):
    kept = STAGES["MinHash near-dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = {d for d, _, _, k in brute.near_dups(own(docs), 5) if k}
    assert sorted(d for d, _ in own(kept)) == sorted(want)


def test_repeated_passages(spark, docs):
    cut = STAGES["suffix-array dedup"](spark, docs, SF)
    assert cut.dtypes == docs.dtypes
    want = {d: h for d, _, _, _, h in brute.suffix_dedup(own(docs), pipeline.PASSAGE_BYTES)}
    whole = [(d, t) for d, t in own(cut) if t.isascii()]
    assert all(brute.sha(t) == want[d] for d, t in whole) and len(whole) > 50
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())


def test_decontamination(spark, docs):
    kept = STAGES["benchmark decontamination"](spark, docs, SF)
    assert kept.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(d for d, _ in own(kept)) == sorted(x[0] for x in brute.contamination(own(docs), items) if not x[5])


def test_odd_rows_pass_every_stage(spark, odd_docs, odd_rows, no_docs):
    odd = odd_docs.selectExpr("*", "length(text) as n_chars", "'d' as kept", "1 as predicted")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.count() <= len(odd_rows), name
        empty = stage(spark, no_docs, SF)
        assert empty.columns == no_docs.columns and empty.count() == 0
    assert STAGES["packing"](spark, no_docs, SF).count() == 0


def test_run_against_brute_force(spark, docs):
    """The whole pipeline: what quality keeps goes through brute-force stages, and every piece holds the ids that a
    tokenizer of its own gives the documents left."""
    rows = own(STAGES["quality classifier"](spark, docs, SF))
    stay = {d for d, _, _, k in brute.near_dups(rows, 5) if k}
    rows = [r for r in rows if r[0] in stay]
    bodies = [(t or "").encode() for _, t in rows]
    flags = brute.covered(bodies, pipeline.PASSAGE_BYTES)
    rows = [(d, bytes(b for b, x in zip(s, f, strict=True) if not x).decode("utf-8", "ignore")) for (d, _), s, f in zip(rows, bodies, flags, strict=True)]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r, x in zip(rows, brute.contamination(rows, items), strict=True) if not x[5]]
    assert len(clean) < len(rows) < docs.count() and any(map(any, flags))
    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = {d: tok.encode(t, add_special_tokens=False).ids + [0] for d, t in clean}
    found = {}
    for r in pipeline.run(spark, SF).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert found.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(found[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_one_of_each_group_stays(spark):
    """Near copies that all have null ids, or share the least id."""
    words = [f"w{i}" for i in range(120)]
    near = lambda tag, i: " ".join([*(tag + w for w in words), f"end{i}"])
    own = [(None, near("a", i)) for i in range(3)] + [(5, near("b", 0)), (5, near("b", 1)), (6, near("b", 2)), (None, near("c", 0)), (7, near("c", 1)), (8, ""), (9, None), (10, "alone")]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(own, "doc_id long, text string"), "").collect()
    assert sorted(str(r["doc_id"]) + (r["text"] or " ")[:1] for r in kept) == ["10a", "5b", "7c", "8 ", "9 ", "Nonea"]
