"""Operator 6: quality classifier.

Statistics of a document's whole text (lengths, character classes, word shapes, repetition of words and lines) are
standardised and mapped by random Fourier features, whose inner products approximate a Gaussian kernel.  Partitions
sum the normal equations; the driver solves the ridge system, of the features' size, and fits an isotonic
calibration over score bins.  The score is the calibrated probability of label 1.

Edge cases: a null or empty text has statistics zero and a score; rows without an id are scored, never learnt from;
repeated rows are scored row by row, equal label rows count once and all texts with their id are learnt from; without
labels of both kinds every score is the share of label 1 (a half without labels); an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch, stored
from .windows import mixed, tidied, unit_names

#: Labelled rows to learn from, at most about so many (an even hash sample of the ids beyond it).
MAX_LABELLED = 200_000
#: Random features, kernel width in standard deviations of a statistic, ridge strength, calibration bins.
N_FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 6.0, 1.0, 512, 20240607
#: Bytes of text a task holds as arrays at once.
BLOCK = 1 << 20

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
CLASSES = np.stack(
    [np.isin(np.arange(256), [ord(c) for c in chars]) for chars in (
        "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "\n", " ", "#$%&*+-/<=>@\\^_|~", "()[]{}\"'`:;",
    )] + [np.arange(256) >= 128]
)
N_STATS = len(CLASSES) + 14


def _per_doc(values: np.ndarray, bounds: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    """``reduce`` of values[bounds[i]:bounds[i+1]] for each i; 0 where empty."""
    out = np.zeros(len(bounds) - 1, np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = reduce.reduceat(values, bounds[full])
    return out


def _distinct_share(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document, distinct hashes and the count of its most frequent one."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    most = np.zeros(n_docs)
    np.maximum.at(most, d[at], size)
    return np.bincount(d[at], minlength=n_docs).astype(float), most


def _pieces(data: np.ndarray, inside: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside``, cut at document starts: start, length, document, hash of the bytes."""
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = mixed(unit_names(data, start, end)[0])
    return start, end - start, np.searchsorted(doc_starts, start, "right") - 1, hashes


def statistics(texts: list[bytes]) -> np.ndarray:
    """The statistics of each text, ``N_STATS`` columns.  Texts are laid out in one array, a blank after each."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    total = np.maximum(sizes, 1).astype(float)
    out = np.zeros((n, N_STATS))
    out[:, 0] = np.log1p(sizes)
    for k, of in enumerate(CLASSES):
        out[:, k + 1] = (np.add.reduceat(of[data].astype(np.int32), starts[:-1]) - of[10]) / total
    at = len(CLASSES) + 1
    blank = SPACE[data]
    start, length, doc, hashes = _pieces(data, ~blank, starts)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    mean = _per_doc(length, bounds, np.add) / some
    out[:, at] = np.log1p(words)
    out[:, at + 1] = np.log1p(mean)
    out[:, at + 2] = np.sqrt(np.maximum(_per_doc(length.astype(float) ** 2, bounds, np.add) / some - mean**2, 0)) / (1 + mean)
    out[:, at + 3] = np.log1p(_per_doc(length, bounds, np.maximum))
    distinct, most = _distinct_share(hashes, doc, n)
    out[:, at + 4], out[:, at + 5] = distinct / some, most / some
    letters = CLASSES[0] | CLASSES[1] | CLASSES[-1]
    odd_end = ~letters[data[start + length - 1]]
    out[:, at + 6] = _per_doc(odd_end, bounds, np.add) / some
    out[:, at + 7] = _per_doc(length > 2, bounds, np.add) / some
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out[:, at + 8] = _per_doc(same, bounds, np.add) / some
    start, length, doc, hashes = _pieces(data, data != 10, starts)
    lines = np.bincount(doc, minlength=n).astype(float)
    distinct, most = _distinct_share(hashes, doc, n)
    some = np.maximum(lines, 1)
    out[:, at + 9], out[:, at + 10], out[:, at + 11] = np.log1p(lines), distinct / some, most / some
    mid = data[:-1]
    twin = np.concatenate((mid == data[1:], [False])) & ~blank
    out[:, at + 12] = np.add.reduceat(twin.astype(np.int32), starts[:-1]) / total
    return out


def batch_statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of a batch of whole texts, ``BLOCK`` bytes of them at once."""
    rows, block, size = [], [], 0
    for t in texts.cast(pa.binary()).to_pylist():
        block.append(t or b"")
        size += len(block[-1])
        if size >= BLOCK:
            rows.append(statistics(block))
            block, size = [], 0
    if block:
        rows.append(statistics(block))
    return np.concatenate(rows) if rows else np.zeros((0, N_STATS))


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stats, label) of the documents that the bounded ``labels`` (doc_id, label) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch_statistics(batch.column(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * N_STATS, pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([lists.cast(pa.list_(pa.float64())), batch.column(1)], names=["stats", "label"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(labels), "doc_id").select("text", "label").mapInArrow(tidied(run), "stats array<double>, label double")


@dataclass
class Model:
    """Everything a score needs; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    rates: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w, b = rng.normal(0, 1 / WIDTH, (N_STATS, N_FEATURES)), rng.uniform(0, 2 * np.pi, N_FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack((np.sqrt(2 / N_FEATURES) * np.cos(z @ w + b), np.ones((len(stats), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.rates)


def _summed(df: DataFrame, length: int, per_batch) -> np.ndarray:
    """The sum over all rows of the vector ``per_batch(stats, labels)``: one partial sum a task, added in two rounds."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                stats = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
                total += per_batch(stats, b.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = df.select("stats", "label").mapInArrow(part, "part binary").repartition(4).mapInArrow(add, "part binary")
    return np.sum([np.zeros(length), *(np.frombuffer(r.part) for r in parts.collect())], axis=0)


def pooled(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the non-decreasing rates nearest to ones/counts."""
    blocks: list[list[float]] = []
    for c, o in zip(counts, ones, strict=True):
        blocks.append([c, o, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, o2, k = blocks.pop()
            blocks[-1][0] += c2
            blocks[-1][1] += o2
            blocks[-1][2] += k
    return np.concatenate([np.full(int(k), o / c) for c, o, k in blocks])


def fit(labelled: DataFrame) -> Model:
    """``labelled``: stats, label (0 or 1).  All sums are taken by Spark; the driver holds 257 x 257 numbers."""
    first = _summed(labelled, 2 * N_STATS + 2, lambda x, y: np.concatenate((x.sum(0), (x**2).sum(0), [len(y), y.sum()])))
    n, ones = first[-2:]
    flat = Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(N_FEATURES + 1), np.array([0.0, 1.0]), np.full(2, ones / n if n else 0.5))
    if not 0 < ones < n:
        return flat
    mean = first[:N_STATS] / n
    scale = np.sqrt(np.maximum(first[N_STATS:-2] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), flat.weights, flat.edges, flat.rates)
    d = N_FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = _summed(labelled, d * d + d, normal)
    ridge = np.diag(np.append(np.full(N_FEATURES, RIDGE), 1e-9))
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + ridge, sums[d * d :])
    low, high = -0.5, 1.5
    bins = _summed(labelled, 3 * BINS, lambda x, y: _binned(model.raw(x), y, low, high)).reshape(3, BINS)
    full = bins[0] > 0
    counts, ones, sums = bins[:, full]
    model.edges, model.rates = sums / counts, pooled(counts, ones)
    return model


def _binned(raw: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    k = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
    return np.concatenate([np.bincount(k, w, BINS) for w in (np.ones(len(y)), y, raw)])


def learnt(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, learn_from):
    """The model, broadcast.  Only the texts that the label rows taken name are read for it, and their statistics kept."""
    own = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).filter("label in (0, 1)")
    own = (own if learn_from is None else own.filter(learn_from)).distinct()
    n = own.count()
    if n > MAX_LABELLED:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(1_000_000_000 * MAX_LABELLED / n))
    with scratch(docs.sparkSession):
        model = fit(stored(labelled_statistics(docs, own, id_col, text_col), "labelled"))
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality",
    learn_from=None, threshold: float = 0.7,
) -> DataFrame:
    """(doc_id, score, predicted), in one pass.  ``learn_from``: condition on ``doc_id`` that label rows must meet.
    A label other than 0 and 1 is ignored."""
    blob = learnt(docs, labels, id_col, text_col, label_id_col, label_col, learn_from)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(blob.value)
        for b in batches:
            scores = model.score(batch_statistics(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, score double, predicted int")


def accepted_documents(
    docs: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", learn_from=None,
) -> DataFrame:
    """The documents, all columns, that are scored ``threshold`` or more: each row is judged where it lies."""
    blob = learnt(docs, labels, id_col, text_col, label_id_col, label_col, learn_from)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(blob.value)
        for b in batches:
            yield b.filter(pa.array(model.score(batch_statistics(b.column(place))) >= threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
