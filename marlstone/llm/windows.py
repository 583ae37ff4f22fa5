"""Repeated windows, for the two substring operators.

A window is ``w`` consecutive units (bytes or words).  Every window has an anchor, a place inside it that depends on
the window's content alone, and a 64-bit key of the text around the anchor: equal windows have equal keys at equal
distances.  Consecutive windows with one anchor form a segment.  So:

1. keys that occur once are set aside (counts with map-side combine; nothing is gathered);
2. what remains is grouped by the segment's content: copies collapse to one row with a count, however many they are;
3. a segment that occurs twice consists of repeated windows;
4. segments that occur once but share their key with others are decided by the operator's own method;
5. the windows' runs go back to the documents they lie in.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

MULT = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(1 << 63)
ANCHORS = "rid long, rhash long, at int, n int, d int, key long, a long, b long"


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, rhash, text).  Spans depend on the text alone, so rows of one id are told apart by their text's hash, and
    null ids share a stand-in."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text).alias("rhash"), text.alias("text"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(32))


def twisted(h: np.ndarray) -> np.ndarray:
    """Another bijective mix, independent of :func:`mixed`."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


#: Bytes of a word that are hashed for all words at once; longer words go through the library's 128-bit hash.
SHORT = 32


def unit_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each slice of bytes.  Eight bytes are mixed in a step, so no sum of powers is
    left in which differences could cancel, whatever the multiplier."""
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    x, y = mixed(size.astype(np.uint64) + np.uint64(1)), twisted(size.astype(np.uint64) + np.uint64(2))
    live = np.arange(len(size))
    for k in range(0, SHORT, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        left = np.minimum(size[live] - k, 8).astype(np.uint64)
        part = eight[start[live] + k] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        x[live], y[live] = mixed(x[live] ^ part), twisted(y[live] ^ part)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        view = memoryview(padded)
        name = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        x[long], y[long] = np.frombuffer(name, "<u8").reshape(-1, 2).T
    return x, y


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(mult: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and mult**-i modulo 2**64 for i up to n.  A worker keeps the longest tables it needed, up to 2**21."""
    key = int(mult)
    up, down = _powers.get(key, ((), ()))
    if len(up) <= n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            up, down = np.full(size, mult, np.uint64), np.full(size, pow(key, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
        if size <= 1 << 21:
            _powers[key] = up, down
    return up[: n + 1], down[: n + 1]


class Rolling:
    """Hashes of any slices of a sequence of 64-bit units, from one prefix sum."""

    def __init__(self, units: np.ndarray, mult: np.uint64 = MULT):
        n = len(units)
        up, self.down = powers(mult, n)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum((units + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, k: int) -> np.ndarray:
        """Of every slice of length k."""
        with np.errstate(over="ignore"):
            return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    span, v = 1, v.copy()
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def runs_of(anchor: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of equal ``anchor`` where ``ok``."""
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:] - 1
    keep = ok[start]
    return start[keep], end[keep]


def whole(ends: np.ndarray, n: int, first: int, w: int) -> np.ndarray:
    """Whether the window of w units from ``first + i`` ends before the next of the (sorted) document ends."""
    edge = np.zeros(n + 1, np.int32)
    near = ends[(ends > first) & (ends < first + n + w)] - first
    np.add.at(edge, np.clip(near - w + 1, 0, n), 1)
    np.add.at(edge, np.clip(near, 0, n), -1)
    return np.cumsum(edge[:-1]) == 0


def trimmed() -> None:
    """Gives memory that arrays have freed back to the system, where the C library can: a Python worker serves many tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task, after which what it has freed goes back to the system."""

    def whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()

    return whole_task


def batch_of(columns: list[np.ndarray | pa.Array], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in ddl.split(", ")])


Extract = Callable[[pa.RecordBatch, bool], Iterator[pa.RecordBatch]]


def hot_anchors(texts: DataFrame, extract: Extract) -> DataFrame:
    """The anchors, ``ANCHORS``, whose key occurs more than once.  ``extract(batch, keys_only)`` yields (key) or
    ``ANCHORS`` batches of a batch of (rid, rhash, text)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from extract(b, True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from extract(b, False)

    # A table, so that adaptive execution can split a key with very many anchors over tasks.
    hot = stored(texts.mapInArrow(tidied(keys), "key long").groupBy("key").count().filter("count > 1").select("key"), "hot")
    return stored(texts.mapInArrow(tidied(rows), ANCHORS).join(hot, "key"), "anchors")


def segments(anchors: DataFrame) -> DataFrame:
    """Distinct segments (key, a, b) with their count c and one occurrence (rid, rhash, at, n, d)."""
    one = [F.first(c).alias(c) for c in ("rid", "rhash", "at", "n", "d")]
    return stored(anchors.groupBy("key", "a", "b").agg(F.count("*").alias("c"), *one), "segments")


def open_segments(segs: DataFrame) -> DataFrame:
    """Segments whose key has several, one at least that occurs once, with the key's number n_segs.  Both sides of the
    join are tables, so that adaptive execution splits a key with very many segments over tasks."""
    per_key = segs.groupBy("key").agg(F.count("*").alias("n_segs"), F.count_if(F.col("c") > 1).alias("n_multi"))
    per_key = stored(per_key.filter("n_segs > 1 and n_multi < n_segs").select("key", "n_segs"), "keys")
    return stored(segs.join(per_key, "key"), "open")


def open_texts(texts: DataFrame, segs: DataFrame, cols: list[str]) -> DataFrame:
    """(text, segs): the text of every document that open segments were taken from, once however often the row repeats,
    with all of these as an array of ``cols``."""
    wanted = segs.groupBy("rid", "rhash").agg(F.collect_list(F.struct(*cols)).alias("segs"))
    return texts.join(wanted.hint("shuffle_hash"), ["rid", "rhash"]).dropDuplicates(["rid", "rhash"]).select("text", "segs")


RUNS = "key long, a long, b long, runs array<struct<lo:int,hi:int>>"


def full_runs(segs: DataFrame) -> DataFrame:
    """``RUNS`` of the segments that occur more than once: all their windows."""
    return segs.filter("c > 1").selectExpr("key", "a", "b", "array(named_struct('lo', 0, 'hi', n - 1)) as runs")


def document_spans(anchors: DataFrame, runs: DataFrame, w: int) -> DataFrame:
    """(rid, rhash, spans): the units that repeated windows cover, as possibly overlapping (start, end).  Rows of one id and
    text have the same spans, each of which is listed once however many rows there are."""
    hits = anchors.select("rid", "rhash", "at", "key", "a", "b").join(runs, ["key", "a", "b"])
    spans = hits.selectExpr("rid", "rhash", f"inline(transform(runs, r -> named_struct('start', at + r.lo, 'end', at + r.hi + {w})))")
    spans = spans.distinct()
    return spans.groupBy("rid", "rhash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def union_of(spans: list[dict] | None, limit: int) -> list[tuple[int, int]]:
    """Maximal disjoint runs of (start, end) spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], min(x["end"], limit)) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def bool_runs(flags: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
