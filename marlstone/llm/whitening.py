"""Operator 12: whitening of embeddings.

Each task reduces its vectors to a count, their sum (so their mean) and the scatter about that mean.  Two such states
merge by the pairwise formula: the scatters add up, and the outer product of the means' difference, weighted by
``n_a * n_b / n``, is added.  Nothing is ever squared before it is centred, so vectors far from the origin lose no
digits.  ``treeReduce`` merges the states on the executors, in rounds of a few; a state has as many numbers as the
covariance, however many rows it stands for.  The driver decomposes the one matrix that is left, a second pass whitens
all rows and reduces them in the same way, and the distance of their covariance from the identity is the error reported.

Vectors are whole numbers, so that sums and deviations are exact: blocks whose products can't pass 64 bits are added up in
these, others in Python's numbers.

Edge cases: a vector that is null or holds a null is left out, and so is one whose length is not the most frequent one
(the longer of two as frequent); null and repeated ids are rows like any others; a deviation that doesn't fit a long is
null; a component without variance (under ``LEAST`` of the largest) is null for every row, explains what it explains, and
stays out of the error; without rows, or with vectors of no entries, there are no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a row, and the part of the largest variance under which a component has none.
COMPONENTS, LEAST = 32, 1e-12
#: Rows reduced, and rows written, at a time.
BLOCK, WRITTEN = 4096, 1024
LONG = (1 << 63) - 1


@dataclass
class State:
    """Vectors reduced: their number, exact sum, and scatter about their mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray


def apart(a: State, b: State) -> np.ndarray:
    """The difference of two means, from the exact sums."""
    if a.sums.dtype == object:
        return ((b.sums * a.n - a.sums * b.n) / (a.n * b.n)).astype(np.float64)
    return b.sums / b.n - a.sums / a.n


def merged(a: State, b: State) -> State:
    """Of two sets of vectors together."""
    n, off = a.n + b.n, apart(a, b)
    return State(n, a.sums + b.sums, a.scatter + b.scatter + np.outer(off, off) * (a.n / n * b.n))


def exact(x: np.ndarray, factor: int) -> np.ndarray:
    """``x`` in numbers of a kind that ``factor`` times its entries can't overflow."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x if most * factor <= LONG else x.astype(object)


def state_of(x: np.ndarray) -> State:
    """Of the rows of whole numbers ``x``."""
    n = len(x)
    sums = exact(x, n).sum(axis=0).astype(object)
    # Whole parts of the mean are taken off exactly, what is left of it in doubles.
    x, mean = exact(x, 2), np.array([s // n for s in sums], np.int64)
    off = (x - mean.astype(x.dtype)).astype(np.float64) - np.array([s % n / n for s in sums])
    return State(n, sums, off.T @ off)


def float_state(y: np.ndarray) -> State:
    mean = y.mean(axis=0)
    return State(len(y), mean * len(y), (y - mean).T @ (y - mean))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of lists of one length as rows of numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def reduced(states: RDD) -> State | None:
    """All states merged on the executors: so many rounds that a task or the driver meets about eight at a time."""
    parts = states.getNumPartitions()
    if not parts:
        return None
    depth = max(2, math.ceil(math.log(parts, 8)) if parts > 1 else 0)
    return states.treeReduce(lambda a, b: merged(a, b) if a and b else a or b, depth)


def pair_up(states: Iterator[State]) -> State | None:
    """A task's states merged two by two, as the formula is most exact for sets of like size."""
    stack: list[tuple[int, State]] = []
    for s in states:
        level = 0
        while stack and stack[-1][0] == level:
            s, level = merged(stack.pop()[1], s), level + 1
        stack.append((level, s))
    out = None
    while stack:
        out = merged(stack.pop()[1], out) if out else stack.pop()[1]
    return out


def whole_numbers(vector: Column, scale: float, offset: int) -> Column:
    """``floor(scale * entry) + offset`` of every entry as a long, or null where the vector or an entry is null or not
    finite.  Entries whose multiple passes 2**62 count as 2**62."""
    most = float(1 << 62)
    number = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(most)), F.lit(-most))) + F.lit(offset)
    finite = F.forall(vector, lambda c: F.coalesce(c.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    return F.when(finite, F.transform(vector, number))


@dataclass
class Whitening:
    """What the rows are whitened by: ``axes`` has a column for each component, of length one, by falling variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.variances > LEAST * self.variances[0]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        sums = np.array(self.sums, object)
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if 2 * self.n * max(most, 1) <= LONG and max(map(abs, self.sums)) <= LONG // 2:
            return x * self.n - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def of(self, off: np.ndarray) -> np.ndarray:
        """The whitened rows of exact deviations; components without variance are nan."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, (off.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.variances), np.nan)


def squares(off: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None beyond a long."""
    most = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0))))
    if most * most * max(1, off.shape[1]) <= LONG:
        return (off * off).sum(axis=1).tolist()
    off = off.astype(object)
    return [int(v) if v <= LONG else None for v in (off * off).sum(axis=1)]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has no null and the most frequent length."""
    rows = rows.filter(F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull()) & (F.size(vector) > 0))
    lengths = rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    best = lengths.agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    return rows.filter(F.size(vector) == F.lit(best or 0))


def fit(rows: DataFrame, vector: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """From all rows of ``usable`` whole-number vectors; None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pair_up(state_of(matrix(b.column(0).slice(i, BLOCK), np.int64)) for b in batches for i in range(0, b.num_rows, BLOCK))
        if out:
            yield packed(out)

    s = reduced(unpacked(rows.select(vector).mapInArrow(part, STATE)))
    if s is None:
        return None
    cov = s.scatter / s.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(s.n, [int(v) for v in s.sums], vectors[:, order], np.maximum(values[order], 0.0), float(np.trace(cov)))


STATE = "n long, sums array<string>, scatter binary"


def packed(s: State) -> pa.RecordBatch:
    """A state as a row; sums as text, as they may pass 64 bits."""
    sums = [str(v) if s.sums.dtype == object else float(v).hex() for v in s.sums]
    return pa.RecordBatch.from_arrays([pa.array([s.n]), pa.array([sums], pa.list_(pa.string())), pa.array([s.scatter.tobytes()], pa.binary())], names=["n", "sums", "scatter"])


def unpacked(rows: DataFrame) -> RDD:
    def state(r) -> State:
        real = any("x" in v for v in r["sums"])
        sums = np.array([float.fromhex(v) for v in r["sums"]]) if real else np.array([int(v) for v in r["sums"]], object)
        return State(r["n"], sums, np.frombuffer(bytes(r["scatter"])).reshape(len(sums), -1))

    # A task without rows has no state, and an empty table no task with one.
    return rows.rdd.mapPartitions(lambda part: iter([pair_up(state(r) for r in part)]))


def identity_error(rows: DataFrame, model: Whitening, vector: str = "x") -> float | None:
    """The largest entry, without sign, of the whitened rows' covariance minus the identity: a second pass over all rows."""
    live = np.flatnonzero(model.live)
    if not len(live) or model.variances[0] <= 0:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (matrix(b.column(0).slice(i, BLOCK), np.int64) for b in batches for i in range(0, b.num_rows, BLOCK))
        out = pair_up(float_state(model.of(model.deviations(x))[:, live]) for x in blocks)
        if out:
            yield packed(out)

    s = reduced(unpacked(rows.select(vector).mapInArrow(part, STATE)))
    return float(np.abs(s.scatter / s.n - np.eye(len(live))).max())


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "x", components: int = COMPONENTS) -> DataFrame:
    """``ROWS``: a row for each vector of whole numbers and component."""
    rows = usable(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("x")), "x")
    model = fit(rows, "x", components)
    if model is None:
        return rows.sparkSession.createDataFrame([], ROWS)
    k, error = len(model.variances), identity_error(rows, model)
    explained = model.variances / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, WRITTEN):
                part = b.slice(i, WRITTEN)
                m = part.num_rows
                off = model.deviations(matrix(part.column(1), np.int64))
                white = model.of(off).ravel()
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(squares(off), pa.int64()).take(again),
                    pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(run, ROWS)
