"""Operator 3: removal of repeated word windows by recompression.

A level of recompression renames a document's symbols (words at first) in two rounds: runs of equal neighbours, of any
length, become one symbol; then ``ab`` becomes one symbol wherever a hash bit deals a to the left and b to the right
half of the alphabet.  A name is a hash of what the symbol stands for, so all tasks give equal strings equal names:
the naming is global without a dictionary that every round would have to shuffle.

Which symbols of a level lie inside a window whatever surrounds it depends on the window's words alone: a level takes
from either end the run that may go on outside, and a symbol that may be paired with one outside.  So equal windows
share their certain symbols on every level.  Spark rounds then find the repeats:

1. a window's key is its least hashed certain symbol of the highest level, with the symbols of falling level that
   every window around it holds on both sides; keys that occur once are set aside, equal segments of windows with one
   key symbol collapse (:mod:`.windows`).  Of a window without certain symbols (about three runs at most) its first run is the key;
2. windows of segments that occur once but share a key are named, in 128 bits, by their certain symbols of the highest
   level and by the words left at both ends; a name that is counted twice verifies the repeat.

A window of 35 words holds three levels (``levels_of``); longer windows hold more.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

Edge cases: a null or empty text has no words; documents shorter than a window are kept; repeated rows are documents
whose windows repeat; null ids are rows of their own; texts of any length are read whole in overlapping blocks; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch, stored
from .windows import (
    ANCHORS, NO_ID, batch_of, document_spans, full_runs, hot_anchors, mixed, open_segments, open_texts, runs_of, segments, texts_of, twisted,
    union_of, unit_names, whole,
)

WINDOW = 35
#: Bytes of text, and words, handled at once; words at most 2**22 less a window.
BLOCK, WORDS = 1 << 19, 1 << 18
PLACE = np.uint64((1 << 22) - 1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the words of texts laid end to end (``ends``: where texts end), and two hashes of each."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    cut[0] = cut[-1] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, *unit_names(data, start, end)


def levels_of(w: int) -> int:
    """Levels at which a window still holds several certain symbols: a level makes symbols 4/3 longer."""
    return max(1, int(math.log(w / 14, 4 / 3))) if w > 14 else 1


class Parse:
    """Recompression of word sequences laid end to end (``first``: words that start a document).

    ``names[k]``, ``twins[k]``: two hashes of the symbols of level k, level 0 being the words; ``heads[k][j]``: the
    symbol of level k - 1 at which symbol j of level k starts, and the number of them last.  A window of the words
    ``i:j`` certainly holds the symbols ``low[i]:high[j]`` of the highest level."""

    def __init__(self, words: np.ndarray, twins: np.ndarray | None, first: np.ndarray, levels: int):
        self.names, self.twins, self.heads = [words], [twins], [np.arange(len(words) + 1)]
        self.low, self.high = np.arange(len(words) + 1), np.arange(len(words) + 1)
        change = np.flatnonzero(np.append((words[1:] != words[:-1]) | first[1:], True)) + 1 if len(words) else np.zeros(0, int)
        self.change = np.repeat(change, np.diff(np.append(0, change)))  # where the run of each word ends
        for level in range(levels):
            first = self._level(first, level)
        starts = self.heads[-1]
        for heads in self.heads[-2::-1]:
            starts = heads[starts]
        self.starts = starts  # in words

    def _level(self, first: np.ndarray, level: int) -> np.ndarray:
        name, twin = self.names[-1], self.twins[-1]
        # Runs.
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | first[1:]
        at = np.flatnonzero(head)
        times = np.diff(np.append(at, len(name)))
        run = np.append(np.cumsum(head) - 1, len(at))
        self.low = np.minimum(run[self.low] + 1, len(at))
        self.high = run[np.maximum(self.high - 1, 0)]
        many, first = times > 1, first[at]
        count = times[many].astype(np.uint64)
        name = name[at]
        name[many] = mixed(name[many] ^ twisted(count))
        # Pairs.
        left = (mixed(name ^ np.uint64(0x70616972 + level)) & np.uint64(1)) == 0
        pair = np.zeros(len(at), bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~first[1:]
        keep = np.ones(len(at), bool)
        keep[1:] = ~pair[:-1]
        symbol = np.append(np.cumsum(keep) - 1, keep.sum())
        self.low = symbol[self.low + np.append(~left, False)[self.low]]
        self.high = symbol[self.high - np.append(False, left)[self.high]]
        own = np.flatnonzero(keep)
        pairs = pair[own]
        second = own[pairs] + 1
        out = name[own]
        with np.errstate(over="ignore"):
            out[pairs] = mixed(twisted(out[pairs]) + name[second])
            self.names.append(out)
            if twin is not None:
                twin = twin[at]
                twin[many] = twisted(twin[many] ^ mixed(count))
                out = twin[own]
                out[pairs] = twisted(mixed(out[pairs]) + twin[second])
        self.twins.append(out if twin is not None else None)
        self.heads.append(np.append(at[own], len(self.names[-2])))
        return first[own]

    def anchors(self, w: int) -> np.ndarray:
        """For each window its key symbol, or, without any, a negative number for where its first run ends and how: beyond
        the window (0), inside (1), or with it (2), as the last of a run's windows is told apart from the others, its equals."""
        symbol = self.least(w)
        end, own = self.change[: len(symbol)], np.arange(len(symbol)) + w
        return np.where(symbol < 0, -1 - 3 * end - np.where(end < own, 1, 2 * (end == own)), symbol)

    def least(self, w: int) -> np.ndarray:
        """For each window of w words its least hashed certain symbol, the first of equal ones; -1 without any."""
        n = len(self.low) - w
        low, high = self.low[:n], self.high[w:]
        size = np.maximum(high - low, 0)
        rank = (mixed(self.names[-1] ^ np.uint64(0x616E63686F72)) & ~PLACE) | np.arange(len(self.names[-1]), dtype=np.uint64)
        tables, span = [rank], 1  # the least of 1, 2, 4, ... symbols from each on
        while 2 * span <= size.max(initial=0):
            tables.append(np.minimum(tables[-1][:-span], tables[-1][span:]))
            span *= 2
        offset = np.cumsum([0, *map(len, tables)])
        power = np.concatenate(([0], np.floor(np.log2(np.arange(1, w + 1) + 0.5)).astype(int)))[size]
        low = np.where(size > 0, low, 0)
        table = np.concatenate(tables)
        got = np.minimum(table[offset[power] + low], table[offset[power] + np.where(size > 0, high - (1 << power), 0)])
        return np.where(size > 0, (got & PLACE).astype(np.int64), -1)

    def run_keys(self, places: np.ndarray) -> np.ndarray:
        """The keys of windows without a key symbol: of their first run's word, and of the next one if they hold it."""
        end, how = np.divmod(-1 - places, 3)
        word = self.names[0]
        follow = np.where(how == 1, word[np.minimum(end, len(word) - 1)], np.uint64(0))
        return mixed(twisted(word[end - 1]) ^ follow)

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        """A hash of each symbol of the highest level and of the symbols next to it: one of the level below on either
        side, beside these one of the next lower level, down to words.  Every window that certainly holds the symbol
        holds all of these."""
        key, left, right = mixed(self.names[-1][symbols]), symbols, symbols + 1
        for heads, below in zip(self.heads[:0:-1], self.names[-2::-1], strict=True):
            left, right = heads[left] - 1, heads[right]
            key = mixed(key ^ below[np.maximum(left, 0)])
            key = mixed(twisted(key) ^ below[np.minimum(right, len(below) - 1)])
            left, right = np.maximum(left, 0), np.minimum(right + 1, len(below))
        return key


def blocks(col: pa.LargeBinaryArray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Document ranges of about ``BLOCK`` bytes."""
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK, "right")) - 1)
        yield a, min(b, len(col))
        a = min(b, len(col))


def digests(view: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit hashes, as two columns, of slices of 16-byte units."""
    out = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip((16 * starts).tolist(), (16 * ends).tolist(), strict=True)])
    return np.frombuffer(out, "<i8").reshape(-1, 2)


def parts(words: np.ndarray, w: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that overlap by a window less one; a window's symbols don't depend on where a range is cut."""
    for x in range(0, len(words) - w + 1, WORDS):
        yield x, min(x + WORDS + w - 1, len(words))


def parsed(words: np.ndarray, twins: np.ndarray | None, ends: np.ndarray, x: int, y: int, w: int) -> Parse:
    """The parse of the words x:y; ``ends``: where documents end."""
    first = np.zeros(y - x, bool)
    first[ends[(ends >= x) & (ends < y)] - x] = True
    return Parse(words[x:y], None if twins is None else twins[x:y], first, levels_of(w))


def anchor_extract(w: int):
    """The ``extract`` of :func:`.windows.hot_anchors`, in words."""

    def extract(batch: pa.RecordBatch, keys_only: bool) -> Iterator[pa.RecordBatch]:
        col = batch.column(2).cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        if not len(col) or col.buffers()[2] is None:
            return
        data = np.frombuffer(col.buffers()[2], np.uint8)
        for a, b in blocks(col, offs):
            ends = offs[a + 1 : b + 1] - offs[a]
            start, _, words, twins = words_of(data[offs[a] : offs[b]], ends)
            word_ends = np.searchsorted(start, ends)  # words up to each document's end
            names = memoryview(np.column_stack((words, twins)).tobytes())
            for x, y in parts(words, w):
                parse = parsed(words, None, word_ends, x, y, w)
                place = parse.anchors(w)
                first, last = runs_of(place, whole(word_ends, len(place), x, w))
                p = place[first]
                held = p >= 0
                key = np.empty(len(p), np.int64)
                key[held] = parse.keys(p[held]).view(np.int64)
                key[~held] = parse.run_keys(p[~held]).view(np.int64)
                if keys_only:
                    yield batch_of([key], "key long")
                    continue
                doc = np.searchsorted(word_ends, x + first, "right")
                base = np.concatenate(([0], word_ends))[doc]
                rid, rhash = (batch.column(i).to_numpy()[a + doc] for i in (0, 1))
                ab = digests(names, x + first, x + last + w)
                far = np.where(held, parse.starts[np.maximum(p, 0)] - first, 0)
                places = [v.astype(np.int32) for v in (x + first - base, last - first + 1, far)]
                yield batch_of([rid, rhash, *places, key, ab[:, 0], ab[:, 1]], ANCHORS)

    return extract


def repeated_spans(texts: DataFrame, w: int) -> DataFrame:
    """(rid, rhash, spans) in words, of the texts with repeated windows."""
    with scratch(texts.sparkSession):
        anchors = hot_anchors(texts, anchor_extract(w))
        segs = segments(anchors)
        found = verified(open_texts(texts, open_segments(segs), ["key", "a", "b", "c", "at", "n"]), w)
        return stored(document_spans(anchors, full_runs(segs).unionByName(found), w), "spans", keep=True)


NAMES = "key long, a long, b long, c long, i int, x long, y long"


def window_names(words: np.ndarray, twins: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """The 128-bit names, as two columns, of the windows that start at ``at``: of the words before the certain symbols of the
    highest level, of these, and of the words after them."""
    out = np.empty((len(at), 2), np.int64)
    for x, y in parts(words, w):
        own = np.flatnonzero((at >= x) & (at < x + WORDS))
        if not len(own):
            continue
        parse = parsed(words, twins, np.zeros(0, np.int64), x, y, w)
        unit = memoryview(np.column_stack((words[x:y], twins[x:y])).tobytes())
        symbol = memoryview(np.column_stack((parse.names[-1], parse.twins[-1])).tobytes())
        i = at[own] - x
        low, high = parse.low[i], parse.high[i + w]
        none = low >= high
        left = np.where(none, i + w, parse.starts[np.minimum(low, len(parse.starts) - 1)])
        right = np.where(none, i + w, parse.starts[np.minimum(high, len(parse.starts) - 1)])
        low, high = np.where(none, 0, low), np.where(none, 0, high)
        sizes = np.column_stack((left - i, high - low)).astype("<u2").tobytes()
        rows = zip(*((16 * v).tolist() for v in (i, left, low, high, right, i + w)), range(0, len(sizes), 4), strict=True)
        name = b"".join([xxhash.xxh3_128_digest(b"".join((unit[a:b], symbol[c:d], unit[e:f], sizes[k : k + 4]))) for a, b, c, d, e, f, k in rows])
        out[own] = np.frombuffer(name, "<i8").reshape(-1, 2)
    return out


def verified(rows: DataFrame, w: int) -> DataFrame:
    """``RUNS`` of the segments that occur once, from (text, segs): the windows whose name occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(body.encode(), np.uint8)
                _, _, words, twins = words_of(raw, np.array([len(raw)]))
                n = np.array([s["n"] for s in segs])
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                xy = window_names(words, twins, i + np.repeat([s["at"] for s in segs], n), w)
                yield batch_of([np.repeat(np.array([s[k] for s in segs], np.int64), n) for k in ("key", "a", "b", "c")] + [i.astype(np.int32), xy[:, 0], xy[:, 1]], NAMES)

    names = stored(rows.mapInArrow(run, NAMES), "names")
    again = names.groupBy("x", "y").agg(F.sum("c").alias("total")).filter("total > 1").select("x", "y")
    found = names.filter("c = 1").join(again, ["x", "y"]).groupBy("key", "a", "b").agg(F.collect_list("i").alias("places"))
    return found.selectExpr("key", "a", "b", "transform(places, i -> named_struct('lo', i, 'hi', i)) as runs")


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False,
) -> DataFrame:
    """One row per document, ``DIGEST`` (and on request ``kept``: the kept words, joined by blanks)."""
    texts = texts_of(docs, id_col, text_col)
    spans = repeated_spans(texts, window)
    ddl = DIGEST + (", rhash long, kept string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = batch.set_column(2, "text", batch.column(2).cast(pa.binary())).columns
            for rid, rhash, body, found in zip(*(c.to_pylist() for c in columns), strict=True):
                words = body.split()  # at exactly the six blanks
                cut = union_of(found, len(words))
                kept = words
                if cut:
                    kept = [x for s, e in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(words)], strict=True) for x in words[s:e]]
                line = b" ".join(kept)
                row = (None if rid == NO_ID else rid, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest())
                out.append((*row, rhash, line.decode()) if with_text else row)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
            yield batch_of([pa.array([x[i] for x in out], kinds[i]) for i in range(6 if with_text else 4)], ddl)

    return texts.join(spans.hint("shuffle_hash"), ["rid", "rhash"], "left").select("rid", "rhash", "text", "spans").mapInArrow(run, ddl)
