"""Operator 5: hierarchical multi-length packing.

A document's remainder (its length modulo the longest tier) is routed to the smallest context tier that holds it.
Each tier is packed from long to short: a window takes one piece of its own tier, its gap is filled best-fit from
the shorter tiers, and what is left of the gap is closed by cutting a shorter piece.  The last pieces of a task are
cut at powers of two.  Windows of a tier are dealt to step groups of equal token counts.

Packing needs no shuffle: a task packs the documents it tokenises, buffering at most ``BUFFER`` remainders.

Edge cases: a null or empty text is the end id alone; repeated and null doc_ids are packed row by row; a text of any
length is cut into full windows of the longest tier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import CACHE_ENTRIES, encoder

#: Context sizes, and tokens of one step group.
TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 8192
#: Remainders a task holds before it packs them.
BUFFER = 8192

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
PIECES = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (c.split() for c in SCHEMA.split(", "))])


class Packer:
    """Packs remainders ``(length, piece)`` into windows; ``emit(tier, [(piece, start, length), ...])`` gets each."""

    def __init__(self, tiers: tuple[int, ...], emit):
        self.tiers, self.emit = tiers, emit
        self.keys: list[int] = []  # lengths that occur, ascending
        self.by_length: dict[int, list[tuple[object, int]]] = {}
        self.size = 0

    def add(self, length: int, piece: object, start: int) -> None:
        stack = self.by_length.get(length)
        if stack is None:
            stack = self.by_length[length] = []
            bisect.insort(self.keys, length)
        stack.append((piece, start))
        self.size += 1

    def _take(self, most: int) -> tuple[int, object, int] | None:
        """The longest piece of at most ``most`` tokens."""
        k = bisect.bisect_right(self.keys, most) - 1
        if k < 0:
            return None
        length = self.keys[k]
        stack = self.by_length[length]
        piece, start = stack.pop()
        if not stack:
            del self.by_length[length]
            del self.keys[k]
        self.size -= 1
        return length, piece, start

    def _window(self, tier: int) -> None:
        """One window of ``tier`` tokens, led by the longest piece that it holds."""
        room, parts = tier, []
        while room and (got := self._take(room)):
            length, piece, start = got
            parts.append((piece, start, length))
            room -= length
        if room and (got := self._take(self.tiers[-1])):  # nothing fits: cut
            length, piece, start = got
            parts.append((piece, start, room))
            self.add(length - room, piece, start + room)
            room = 0
        if not room:
            self.emit(tier, parts)
            return
        for piece, start, length in parts:  # the task's last pieces, too few for a window
            self.add(length, piece, start)
        self._tail()

    def _tail(self) -> None:
        """Windows at the powers of two that the remaining tokens add up to."""
        rest, total = [], 0
        while got := self._take(self.tiers[-1]):
            rest.append(got)
            total += got[0]
        k = 0
        while total:
            size = room = 1 << (total.bit_length() - 1)
            parts = []
            while room:
                length, piece, start = rest[k]
                cut = min(length, room)
                parts.append((piece, start, cut))
                room -= cut
                if cut < length:
                    rest[k] = (length - cut, piece, start + cut)
                else:
                    k += 1
            self.emit(size, parts)
            total -= size

    def pack(self, last: bool) -> None:
        """All pieces of the longer tiers; of the shortest tier too, but what doesn't fill a window stays unless ``last``."""
        for tier, least in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0), strict=True):
            while self.keys and self.keys[-1] > least:
                if not last and self.size < 64:
                    return
                self._window(tier)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS, with_ids: bool = False, cache_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """One row per piece, ``SCHEMA`` (and the piece's ``ids`` as little-endian unsigned 32-bit integers on request).
    ``tiers`` are powers of two, ascending; a sequence id names the task in its upper bits.
    ``cache_entries``: chunks whose ids a Python worker remembers."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    longest, end = tiers[-1], int(end_id).to_bytes(4, "little")
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cache_entries)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        made = {}

        def emit(tier: int, parts: list) -> None:
            seq, at = base + made.get("all", 0), 0
            made["all"] = made.get("all", 0) + 1
            k = made[tier] = made.get(tier, -1) + 1
            group = base | (tier.bit_length() << 34) | (k // max(1, step_tokens // tier))
            for (doc_id, ids, first), start, length in parts:
                part = ids[4 * (start - first) : 4 * (start - first + length)]
                row = (doc_id[0], start, length, zlib.crc32(part), doc_id[1], seq, at, tier, group)
                rows.append((*row, part) if with_ids else row)
                at += length

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        packer = Packer(tiers, emit)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                doc = (doc_id, n)
                for start in range(0, n - longest + 1, longest):
                    emit(longest, [((doc, ids, 0), start, longest)])
                if rest := n % longest:
                    packer.add(rest, (doc, ids[4 * (n - rest) :], n - rest), n - rest)
                if packer.size >= BUFFER:
                    packer.pack(last=False)
                if len(rows) >= 20_000:
                    yield flush()
        packer.pack(last=True)
        yield flush()

    out = SCHEMA + (", ids binary" if with_ids else "")
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, out)
