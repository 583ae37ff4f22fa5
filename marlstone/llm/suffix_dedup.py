"""Operator 1: suffix-array removal of repeated byte strings.

Repeated windows of ``min_bytes`` bytes are found as in :mod:`.windows`; the anchor of a window is its least hashed
k-gram.  Segments that occur once but share a key are decided by threshold-bounded interval expansion: groups of
segments are laid out in blocks of bounded size, a suffix array gives the block's Burrows-Wheeler transform, and
intervals are extended backward breadth-first, so that common prefixes are set by increasing value.  Expansion stops
at ``min_bytes``: rows whose common prefix is still not set have one at least that long.

A key with more than ``MAX_SEGMENTS`` distinct segments (a passage in very many contexts) is split: windows are dealt
to narrower bands of their distance from the anchor, keyed by the bytes all windows of a band share, until groups
are small; a band of one distance is the window itself, whose copies collapse.

Edge cases: a null or empty text has no bytes and nothing is removed; texts shorter than ``min_bytes`` are kept;
repeated rows are documents whose texts repeat; null ids are rows of their own; texts of any length are read whole in
overlapping blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch, stored
from .windows import (
    ANCHORS, NO_ID, RUNS, Rolling, batch_of, bool_runs, document_spans, full_runs, hot_anchors, mixed, open_segments, open_texts, runs_of, segments,
    sliding_min, texts_of, trimmed, union_of, whole,
)

MIN_BYTES = 400
#: Window starts handled at once; at most 2**22 less a window.
BLOCK = 1 << 19
#: Distinct segments of a key in one block, and bytes of a block's groups.
MAX_SEGMENTS, BLOCK_BYTES = 1024, 1 << 19
PLACE = np.uint64((1 << 22) - 1)


def anchor_extract(w: int):
    """The ``extract`` of :func:`.windows.hot_anchors`: over all texts of a batch at once, laid end to end."""
    k = max(2, w // 6)

    def extract(batch: pa.RecordBatch, keys_only: bool) -> Iterator[pa.RecordBatch]:
        col = batch.column(2).cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        buf = col.buffers()[2]
        if not len(col) or buf is None or offs[-1] - offs[0] < w:
            return
        view = memoryview(buf)
        data = np.frombuffer(buf, np.uint8)
        for x in range(int(offs[0]), int(offs[-1]) - w + 1, BLOCK):
            block = data[x : min(x + BLOCK + w - 1, int(offs[-1]))]
            hashes = mixed(Rolling(block.astype(np.uint64)).all(k))
            least = sliding_min((hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), w - k + 1)
            place = (least & PLACE).astype(np.int64)
            start, end = runs_of(place, whole(offs[1:], len(place), x, w))
            p = place[start]
            key = hashes[p].view(np.int64)
            if keys_only:
                yield batch_of([key], "key long")
                continue
            doc = np.searchsorted(offs, start + x, "right") - 1
            name = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip((start + x).tolist(), (end + x + w).tolist(), strict=True)])
            ab = np.frombuffer(name, "<i8").reshape(-1, 2)
            rid, rhash = (batch.column(i).to_numpy()[doc] for i in (0, 1))
            places = [v.astype(np.int32) for v in (start + x - offs[doc], end - start + 1, p - start)]
            yield batch_of([rid, rhash, *places, key, ab[:, 0], ab[:, 1]], ANCHORS)

    return extract


def suffix_order(units: np.ndarray, short: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` units at least, by prefix doubling.  ``units``: bytes + 1, 0 for a
    separator; ``short``: units up to and with the next separator.  Separators differ from each other, by position."""
    n, step = len(units), 7
    key = np.zeros(n, np.uint64)
    padded = np.concatenate((units, np.zeros(step, units.dtype))).astype(np.uint64)
    alive = np.ones(n, bool)
    for i in range(step):
        key = (key << np.uint64(9)) | np.where(alive, padded[i : i + n], 0).astype(np.uint64)
        alive &= padded[i : i + n] != 0
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    while True:
        new = np.ones(n, bool)
        k = key[order]
        new[1:] = (k[1:] != k[:-1]) | (short[order][1:] <= step)
        del k
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        if step >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank.astype(np.int64) * n
        if step < n:
            key[: n - step] += rank[step:]
        # Only suffixes that still share their rank move.
        tied = np.flatnonzero(np.concatenate((~new, [False]))[1:] | ~new)
        rows = order[tied]
        order[tied] = rows[np.argsort(key[rows], kind="stable")]
        step *= 2


def long_prefixes(units: np.ndarray, names: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each row of the suffix array and one past the last, whether its common prefix with the row before is at
    least ``limit``: breadth-first interval expansion over the Burrows-Wheeler transform.  ``names``: the units with
    every separator a symbol of its own."""
    n = len(order)
    bwt = names[order - 1]  # the unit before the first is the last separator
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int32)  # LF: the row of the suffix one unit longer
    step[by_symbol] = np.arange(n)
    symbol = bwt[by_symbol]
    same = symbol[1:] == symbol[:-1]
    prev, follow = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # rows with the same symbol next above and below
    prev[by_symbol[1:][same]] = by_symbol[:-1][same]
    follow[by_symbol[:-1][same]] = by_symbol[1:][same]
    del bwt, by_symbol, symbol, same
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(limit):
        size = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        first, last = rows[prev[rows] < np.repeat(lo, size)], rows[follow[rows] >= np.repeat(hi, size)]
        start, end = np.sort(step[first]), np.sort(step[last]) + 1
        fresh = unset[end]
        lo, hi = start[fresh], end[fresh]
        if not len(lo):
            break
        unset[hi] = False
    return unset


def repeated_starts(texts: list[bytes], w: int) -> list[np.ndarray]:
    """For each text, for each window start, whether its w bytes also start elsewhere among the texts."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    units = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int32) + 1
    units[ends] = 0
    short = np.repeat(ends, sizes + 1).astype(np.int32) - np.arange(len(units), dtype=np.int32) + 1
    order = suffix_order(units, short, w)
    del short
    names = units + len(texts)
    names[ends] = np.arange(len(texts))
    long = long_prefixes(units, names, order, w)
    repeated = np.zeros(len(units), bool)
    repeated[order] = long[:-1] | long[1:]
    starts = ends - sizes
    return [repeated[s : s + max(0, n - w + 1)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def decide_blocks(rows: DataFrame, w: int) -> DataFrame:
    """``RUNS`` of the segments (key, a, b, c, body) with c = 1, by expansion over blocks of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], tuple[int, bytes]] = {}
        block: list[tuple] = []
        size, at = 0, None

        def decide() -> pa.RecordBatch:
            found = repeated_starts([x[4] for x in block], w)
            out = [(k, a, b, bool_runs(f)) for (k, a, b, c, _), f in zip(block, found, strict=True) if c == 1 and f.any()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            return batch_of([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], "key long, a long, b long, runs x")

        for batch in batches:
            for key, a, b, c, body in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if key != at:
                    block += [(at, *ab, *cb) for ab, cb in group.items()]
                    size += sum(len(x[1]) for x in group.values())
                    group, at = {}, key
                    if size >= BLOCK_BYTES:
                        yield decide()
                        block, size = [], 0
                group[a, b] = (c, body)
        block += [(at, *ab, *cb) for ab, cb in group.items()]
        if block:
            yield decide()
        trimmed()

    ordered = rows.select("key", "a", "b", "c", "body").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, RUNS)


def band_rows(rows: DataFrame, w: int, width: int) -> DataFrame:
    """Segments (key, a, b, c, n, d, body) cut to bands of ``width`` distances from the anchor: the parent segment, the
    band's offset ``lo`` in it, and the band as a segment of its own."""
    farthest = w - max(2, w // 6)
    ddl = "pkey long, pa long, pb long, lo int, c long, n int, d int, key long, a long, b long, body binary"
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 3 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, a, b, c, n, d, body in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                # Window i starts d - i before the anchor; bands are counted from the farthest.
                first = farthest - d
                for band in range(first // width, (first + n - 1) // width + 1):
                    lo, hi = max(0, band * width - first), min(n, (band + 1) * width - first)
                    core = body[(band + 1) * width - 1 - first : band * width - first + w] if band * width - first + w > 0 else b""
                    cut = body[lo : hi + w - 1]
                    name = np.frombuffer(xxhash.xxh3_128_digest(cut), "<i8").tolist()
                    new_key = np.frombuffer(xxhash.xxh3_64_digest(core + band.to_bytes(4, "little") + width.to_bytes(4, "little")), "<i8").tolist()[0]
                    out.append((key, a, b, lo, c, hi - lo, d - lo, new_key, *name, cut))
            yield batch_of([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ddl)

    return rows.select("key", "a", "b", "c", "n", "d", "body").mapInArrow(run, ddl)


def decide(rows: DataFrame, w: int, width: int, max_segments: int) -> DataFrame:
    """``RUNS`` of the segments that occur once, from open segments (key, a, b, c, n, d, body, n_segs)."""
    found = decide_blocks(rows.filter(F.col("n_segs") <= max_segments), w)
    many = rows.filter(F.col("n_segs") > max_segments)
    if width == 0 or many.isEmpty():
        return found
    bands = stored(band_rows(many, w, width), "bands")
    one = [F.first(x).alias(x) for x in ("n", "d", "body")]
    segs = stored(bands.groupBy("key", "a", "b").agg(F.sum("c").alias("c"), *one), "segments")
    runs = full_runs(segs).unionByName(decide(open_segments(segs), w, 0 if width == 1 else max(1, width // 4), max_segments))
    back = bands.select("pkey", "pa", "pb", "lo", "key", "a", "b").join(runs, ["key", "a", "b"])
    parts = back.selectExpr("pkey as key", "pa as a", "pb as b", "transform(runs, r -> named_struct('lo', r.lo + lo, 'hi', r.hi + lo)) as runs")
    # One row for each segment again, as every anchor of the segment meets it; a segment has at most w runs.
    return found.unionByName(parts.groupBy("key", "a", "b").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def repeated_spans(texts: DataFrame, w: int, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(rid, rhash, spans) of the texts with repeated windows."""
    with scratch(texts.sparkSession):
        anchors = hot_anchors(texts, anchor_extract(w))
        segs = segments(anchors)
        body = F.substring(F.col("text").cast("binary"), F.col("at") + 1, F.col("n") + (w - 1))
        rows = open_texts(texts, open_segments(segs), ["key", "a", "b", "c", "at", "n", "d", "n_segs"]).select("text", F.inline("segs"))
        rows = rows.select("key", "a", "b", "c", "n", "d", body.alias("body"), "n_segs")
        runs = full_runs(segs).unionByName(decide(stored(rows, "bodies"), w, max(1, w // 5), max_segments))
        return stored(document_spans(anchors, runs, w), "spans", keep=True)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, with_text: bool = False,
    max_segments: int = MAX_SEGMENTS,
) -> DataFrame:
    """One row per document, ``DIGEST`` (and ``kept`` as text on request: a character cut in two is dropped)."""
    texts = texts_of(docs, id_col, text_col)
    spans = repeated_spans(texts, min_bytes, max_segments)
    ddl = DIGEST + (", rhash long, kept string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = batch.set_column(2, "text", batch.column(2).cast(pa.binary())).columns
            for rid, rhash, body, found in zip(*(c.to_pylist() for c in columns), strict=True):
                cut = union_of(found, len(body))
                kept = without(body, cut)
                row = (None if rid == NO_ID else rid, len(body), len(body) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                out.append((*row, rhash, kept.decode("utf-8", "ignore")) if with_text else row)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string()]
            yield batch_of([pa.array([x[i] for x in out], kinds[i]) for i in range(7 if with_text else 5)], ddl)

    return texts.join(spans.hint("shuffle_hash"), ["rid", "rhash"], "left").select("rid", "rhash", "text", "spans").mapInArrow(run, ddl)


def without(body: bytes, cut: list[tuple[int, int]]) -> bytes:
    """The bytes outside the disjoint runs ``cut``."""
    return body if not cut else b"".join(body[s:e] for s, e in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(body)], strict=True))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, chars_col: str | None = None,
) -> DataFrame:
    """The documents, all columns, their texts without the repeated bytes (a character cut in two is dropped); a null
    text stays null.  ``chars_col``: a column that holds the text's number of characters, set anew where that changes."""
    spans = repeated_spans(texts_of(docs, id_col, text_col), min_bytes)
    name = "spans"
    while name in docs.columns:
        name += "_"
    rid = F.coalesce(F.col(f"d.`{id_col}`").cast("long"), F.lit(NO_ID))
    same = (rid == F.col("s.rid")) & (F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))) == F.col("s.rhash"))
    joined = docs.alias("d").join(spans.hint("shuffle_hash").alias("s"), same, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("s.spans").alias(name))
    place, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts, counts = columns[place].to_pylist(), columns[chars].to_pylist() if chars_col else []
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if found:
                    body = texts[i].encode()
                    texts[i] = without(body, union_of(found, len(body))).decode("utf-8", "ignore")
                    if chars_col:
                        counts[i] = len(texts[i])
            columns[place] = pa.array(texts, columns[place].type)
            if chars_col:
                columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
