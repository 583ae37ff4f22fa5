"""Operator 9: benchmark decontamination with one Aho-Corasick automaton.

A benchmark item's windows are its runs of ``window`` consecutive words (a shorter item is one window).  Every window
holds one of the blocks of ``(window + 1) // 2`` words into which its item is cut, so the automaton's patterns are the
blocks: each word of the benchmark lies in one pattern, not in ``window`` of them.  A normalised document is scanned
once; from each block found, the match is read on to both sides, word by word against the item, as far as a window
goes.  Word positions of the document are mapped to offsets of the original text.

One automaton holds ``BLOCK_CHARS`` of normalised text at most.  A longer benchmark is dealt to several, each a pass
over the documents of its own with one automaton alive, and the passes' hits are put together for each document; the
driver holds one pass's text at a time.  Items of any length are cut to parts that overlap by a window less one word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Texts are handled as UTF-8 bytes: every
separator is a single byte, so one translation table lower-cases and blanks them.

Edge cases: a null or empty text, document or item, has no words, no hits and no windows; equal item ids are one
item; repeated and null doc_ids are judged row by row; a text of any length is scanned whole; empty tables give no
rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

WINDOW = 13
#: Characters of benchmark text in one automaton, about 45 bytes of a Python worker's memory each; and of a part.
BLOCK_CHARS, PART_WORDS = 6_000_000, 20_000

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def parts_of(text: str | None, size: int) -> list[str]:
    """A text's words, blank-separated, in parts that hold every window whole."""
    words = words_of(text)
    return [b" ".join(words[i : i + PART_WORDS + size - 1]).decode() for i in range(0, max(1, len(words) - size + 1), PART_WORDS)] if words else []


class Scanner:
    """The automaton over the parts of benchmark items, (item, text)."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        import ahocorasick

        self.size, self.block = size, (size + 1) // 2
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        units, self.automaton, at = [], ahocorasick.Automaton(), 0
        places: dict[str, list[tuple[int, int]]] = {}  # of a pattern: where it starts, and its item
        for item, text in dict.fromkeys((str(item), part) for item, text in items for part in parts_of(text, size)):
            words = text.encode().split()
            self.names.append(item)
            units += [-1, *(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)]  # -1 equals no word
            at += 1
            step = self.block if len(words) >= size else len(words)
            for i in range(0, len(words) - step + 1, step):
                places.setdefault(" " + b" ".join(words[i : i + step]).decode("latin-1") + " ", []).append((at + i, len(self.names) - 1))
            at += len(words)
        self.units = np.array([*units, *[-1] * (size + 1)], np.int32)
        for pattern, found in places.items():
            self.automaton.add_word(pattern, (pattern.count(" ") - 1, np.array(found)))
        if places:
            self.automaton.make_automaton()

    def _match(self, before: np.ndarray, after: np.ndarray, n: int, places: np.ndarray) -> tuple[int, int, frozenset[str]] | None:
        """How far a pattern of n words is part of windows, given the document's words before it, backward, and after it:
        the words before and after it that lie in one, and the items; None without a window."""
        start = places[:, :1]
        left, right = (np.logical_and.accumulate(x, axis=1).sum(axis=1) for x in (
            self.units[start - 1 - np.arange(len(before))] == before, self.units[start + n + np.arange(len(after))] == after))
        short = (self.units[start[:, 0] - 1] == -1) & (self.units[start[:, 0] + n] == -1) & (n < self.size)  # a whole item
        long = ~short & (left + n + right >= self.size)
        if not (short | long).any():
            return None
        return left[long].max(initial=0), right[long].max(initial=0), frozenset(self.names[k] for k in places[short | long, 1].tolist())

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items whose windows occur."""
        raw = words_of(text)
        hit, names = np.zeros(len(raw), bool), set()
        if raw and self.names:
            line = f" {b' '.join(raw).decode('latin-1')} "
            found = list(self.automaton.iter(line))
            if found:
                own = np.array([self.vocabulary.get(w, -2) for w in raw], np.int32)
                blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                seen, reach = {}, self.size - self.block
                for end, (n, places) in found:
                    at = int(np.searchsorted(blanks, end)) - n
                    near = own[max(0, at - reach) : at + n + reach]
                    key = (int(places[0, 0]), min(at, reach), near.tobytes())
                    if key not in seen:
                        seen[key] = self._match(own[max(0, at - reach) : at][::-1], own[at + n : at + n + reach], n, places)
                    if got := seen[key]:
                        before, after, items = got
                        hit[at - before : at + n + after] = True
                        names |= items
        return len(raw), hit, names

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Hit words as maximal (start, end) code point offsets of the original text."""
        _, hit, _ = self.scan(text)
        data = np.frombuffer(text.encode().translate(TABLE), np.uint8) != 32
        edge = np.diff(np.concatenate(([0], data.astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)))
        return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs_of(hit)]


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


_scanners: dict[bytes, Scanner] = {}


def scanner(blob: bytes, size: int) -> Scanner:
    """The scanner of a pickled part of a benchmark; the last one is kept for the worker's later tasks."""
    key = hashlib.sha256(blob + str(size).encode()).digest()
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(pickle.loads(blob), size)
    return _scanners[key]


def parts_table(benchmark: DataFrame, item_col: str, text_cols: tuple[str, ...], size: int) -> tuple[DataFrame, int]:
    """The benchmark's parts (item, text), and the number of automata that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, part) for item, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in texts for part in parts_of(t, size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["item", "text"])

    item = f"coalesce(cast(`{item_col}` as string), 'None') as item"
    texts = benchmark.selectExpr(item, *(f"`{c}` as text{i}" for i, c in enumerate(text_cols)))
    rows = stored(texts.mapInArrow(run, "item string, text string").distinct(), "benchmark")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return rows, max(1, -(-total // BLOCK_CHARS))


def broadcast_part(rows: DataFrame, k: int, n: int):
    """The k-th of n parts, dealt by hash, as a broadcast list: about ``BLOCK_CHARS`` characters."""
    own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
    return rows.sparkSession.sparkContext.broadcast(pickle.dumps([tuple(r) for r in own.collect()]))


FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
HITS = pa.schema([("rid", pa.int64()), ("rhash", pa.int64()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
COUNTS = pa.schema([("rid", pa.int64()), ("rhash", pa.int64()), ("n_words", pa.int64())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def judged(n: int, k: int, names: set[str], share: int) -> tuple:
    return n, k, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), k > 0 and share * k >= n


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, rhash, text): rows that agree in id and text's hash have equal hits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("rid"), F.xxhash64(text).alias("rhash"), text.alias("text"))


def judged_in_passes(texts: DataFrame, parts: DataFrame, n: int, window: int, share: int) -> DataFrame:
    """``SCHEMA`` and rhash, from a pass over the texts for each automaton; no text is shuffled."""

    def hits(blob):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = scanner(blob.value, window).scan
            for batch in batches:
                found = [(rid, rhash, *scan(text)) for rid, rhash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield batch_of([(rid, rhash, np.flatnonzero(hit), sorted(names)) for rid, rhash, _, hit, names in found if names], HITS)

        return run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(rid, rhash, len(words_of(text))) for rid, rhash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)], COUNTS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = [(rid, *judged(n_words, len(set().union(*words or ())), set().union(*items or ()), share), rhash) for rid, rhash, n_words, words, items in rows]
            yield batch_of(out, FOUND.append(pa.field("rhash", pa.int64())))

    found = None
    for k in range(n):
        blob = broadcast_part(parts, k, n)
        one = texts.mapInArrow(hits(blob), "rid long, rhash long, words array<int>, items array<string>")
        one = stored(one.dropDuplicates(["rid", "rhash"]), "hits")
        blob.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("rid", "rhash").agg(F.collect_list("words").alias("words"), F.collect_list("items").alias("items"))
    counts = texts.mapInArrow(count, "rid long, rhash long, n_words long").alias("c")
    same = F.col("c.rid").eqNullSafe(F.col("f.rid")) & (F.col("c.rhash") == F.col("f.rhash"))
    return counts.join(found.alias("f"), same, "left").select("c.rid", "c.rhash", "n_words", "words", "items").mapInArrow(judge, SCHEMA + ", rhash long")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_cols: tuple[str, ...] = ("text",), window: int = WINDOW, least_share: float = 0.05,
) -> DataFrame:
    """One row per document, ``SCHEMA``.  Questions and answers in separate columns are separate texts of an item.
    A document is contaminated if it is hit and at least ``least_share`` of its words are."""
    (parts, n), share = parts_table(benchmark, item_col, item_text_cols, window), round(1 / least_share)
    if n > 1:
        return judged_in_passes(keyed(docs, id_col, text_col), parts, n, window, share).drop("rhash")
    blob = broadcast_part(parts, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(blob.value, window).scan
        for batch in batches:
            found = [(doc_id, *scan(text)) for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch_of([(doc_id, *judged(n, int(hit.sum()), names, share)) for doc_id, n, hit, names in found], FOUND)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_cols: tuple[str, ...] = ("text",), window: int = WINDOW, least_share: float = 0.05,
) -> DataFrame:
    """The documents, all columns, that aren't contaminated: with one automaton each row is judged where it lies."""
    (parts, n), share = parts_table(benchmark, item_col, item_text_cols, window), round(1 / least_share)
    if n > 1:
        bad = judged_in_passes(keyed(docs, id_col, text_col), parts, n, window, share).filter("contaminated")
        bad = bad.select("doc_id", "rhash").distinct().alias("k")
        same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"d.{text_col}"), F.lit(""))) == F.col("k.rhash"))
        return docs.alias("d").join(bad, same, "left_anti")
    blob, place = broadcast_part(parts, 0, 1), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(blob.value, window).scan
        for batch in batches:
            found = map(scan, batch.column(place).to_pylist())
            yield batch.filter(pa.array([not judged(n, int(hit.sum()), names, share)[4] for n, hit, names in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
