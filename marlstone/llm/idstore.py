"""Operator 7: token-id shards with a minimal perfect hash index.

File format.  A store is a folder of Parquet files, so Spark's committer makes it survive lost executors; each row
is a shard over a range of document keys:

* ``payload``: the raw ids of its documents, back to back, little-endian, ``width`` bytes each;
* ``docs``: little-endian 64-bit id positions, one more than documents: document k has ids ``docs[k]:docs[k+1]``;
* ``levels``: the minimal perfect hash.  Level i is a bit array in which each key not placed before sets the bit of
  its i-th hash, if no other key does; the number of set bits before a key's bit is its slot in 0..n-1;
* ``ranks``: for each level the number of set bits, of this and earlier levels, before each 64 bytes of it, as
  little-endian unsigned 32-bit integers, so that a slot is found by counting the bits of 64 bytes at most;
* ``slots``: for each slot the key's fingerprint (32 bits of another hash), its first document and their number;
* ``keys``: the document keys in order (a manifest for full scans; a lookup doesn't read it).

A lookup hashes the key, finds its slot, compares the fingerprint and slices the payload: in a shard at hand that is
constant time, whatever its size.  Shards are of bounded size; Parquet statistics of the first and last key say which
to read.  A key with very many documents goes on over shards and tasks, each with a slot for it.

Edge cases: a null or empty text is the end id alone; documents of one key are neighbours in order of their text's hash;
a null key comes first, is stored, but can't be looked up; an empty table gives an empty store.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_dir
from .tokens import encoder

#: A shard ends after so many ids or documents; bytes of input a writing task gets at least.
SHARD_IDS, SHARD_DOCS, TASK_BYTES = 2_000_000, 4096, 256 << 20
#: Bits of a level for each key that reaches it.
SPREAD = 2
SHARD = "shard_id long, first_key long, last_key long, n_docs long, n_ids long, width int, payload binary, docs binary, levels array<binary>, ranks array<binary>, slots binary, keys binary, null_keys long"
SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("count", "<u4")])
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def key_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys: two xor-shift-multiply rounds over a seeded odd stride."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, read from its levels and ranks."""

    def __init__(self, levels: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    @staticmethod
    def build(keys: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        levels, ranks, before = [], [], 0
        while len(keys):
            m = (len(keys) * SPREAD + 7) // 8 * 8
            at = (key_hash(keys, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            counts = np.add.reduceat(alone, np.arange(0, m, 512), dtype=np.int64)
            levels.append(np.packbits(alone).tobytes())
            ranks.append((before + np.cumsum(counts) - counts).astype("<u4").tobytes())
            before += int(counts.sum())
            keys = keys[~alone[at]]
        return levels, ranks

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that reach no bit (other keys may get any slot)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, (level, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (key_hash(keys[left], i) % np.uint64(8 * len(level))).astype(np.int64)
            byte, bit = at >> 3, 7 - (at & 7)
            hit = (level[byte] >> bit) & 1 == 1
            own, byte, bit = left[hit], byte[hit], bit[hit]
            # The set bits before it in its 64 bytes.
            place = (byte & ~63)[:, None] + np.arange(64)
            full = np.where(place < byte[:, None], BITS[level[np.minimum(place, len(level) - 1)]], 0).sum(axis=1)
            out[own] = ranks[byte >> 6] + full + BITS[level[byte] >> (bit + 1)]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (key_hash(keys, 0x5EED) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """Keyed access to one shard row."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], "<u8").astype(np.int64)
        self.slots = np.frombuffer(row["slots"], SLOT)
        self.hash = PerfectHash(row["levels"], row["ranks"])
        self.payload, self.width = row["payload"], row["width"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; number 0 where the fingerprint differs."""
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.hash.slots(keys)
        slot = self.slots[np.maximum(at, 0)]
        known = (at >= 0) & (slot["print"] == fingerprints(keys))
        return np.where(known, slot["first"], 0).astype(np.int64), np.where(known, slot["count"], 0).astype(np.int64)

    def ids(self, doc: int) -> np.ndarray:
        a, b = self.docs[doc], self.docs[doc + 1]
        return np.frombuffer(self.payload, f"<u{self.width}", b - a, a * self.width)


def shard_row(shard_id: int, keys: list[int | None], ids: list[bytes], width: int) -> dict:
    """Builds a shard of documents in key order; ``ids`` are little-endian unsigned 32-bit."""
    docs = np.cumsum([0, *(len(x) // 4 for x in ids)])
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], np.int64)
    distinct, first, count = np.unique(known, return_index=True, return_counts=True)
    levels, ranks = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), SLOT)
    at = PerfectHash(levels, ranks).slots(distinct)
    slots["print"][at], slots["first"][at], slots["count"][at] = fingerprints(distinct), first + nulls, count
    payload = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    return {
        "shard_id": shard_id, "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None,
        "n_docs": len(keys), "n_ids": int(docs[-1]), "width": width, "payload": payload, "docs": docs.astype("<u8").tobytes(),
        "levels": levels, "ranks": ranks, "slots": slots.tobytes(), "keys": known.astype("<i8").tobytes(), "null_keys": nulls,
    }


def write_store(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encodes whole texts in ascending key order and writes the shards; returns the store's path."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/idstore-{uuid.uuid4().hex}"
    schema, end = schema_of(SHARD), int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        base, made, size = TaskContext.get().partitionId() << 32, 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                    yield pa.RecordBatch.from_pylist([shard_row(base + made, keys, ids, width)], schema)
                    keys, ids, size, made = [], [], 0, made + 1
                keys.append(key)
                ids.append(enc.encode(text) + end)
                size += len(ids[-1]) // 4
        if keys:
            yield pa.RecordBatch.from_pylist([shard_row(base + made, keys, ids, width)], schema)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"coalesce(`{text_col}`, '') as text")
    # Equal rows, too, are dealt to several tasks: by their place in the input.
    rows = rows.withColumn("rhash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "rhash", "place"]
    rows = rows.repartitionByRange(write_tasks(docs), *order).sortWithinPartitions(*order)
    rows.select("doc_id", "text").mapInArrow(run, SHARD).write.parquet(path)
    return path


def write_tasks(docs: DataFrame) -> int:
    """Tasks to write a store with: the session's number, more where the input's estimated size asks for it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # more stands for an unknown size
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // TASK_BYTES)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """(shard_id, shard_start): ids before each shard.  The inner window runs within a task of the writer, the outer
    over one row per task."""
    shards = store.select("shard_id", "n_ids", F.shiftright("shard_id", 32).alias("task"))
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_start"))
    inner = Window.partitionBy("task").orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    return shards.join(tasks, "task").select("shard_id", (F.col("task_start") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("shard_start"))


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, found through the index by its key: doc_id, start, n_tokens, ids_crc32."""
    ddl = "shard_id long, doc_id long, at long, n_tokens long, ids_crc32 long"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                keys = np.unique(np.frombuffer(row["keys"], "<i8"))
                first, count = shard.find(keys)
                found = [(None, k) for k in range(row["null_keys"])]
                found += [(key, f + k) for key, f, n in zip(keys.tolist(), first.tolist(), count.tolist(), strict=True) for k in range(n)]
                ends = shard.docs.tolist()
                out = [(row["shard_id"], key, ends[k], ends[k + 1] - ends[k], zlib.crc32(shard.ids(k).astype("<u4").tobytes())) for key, k in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    store = read_store(spark, path)
    rows = store.mapInArrow(run, ddl)
    return rows.join(shard_starts(store), "shard_id").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids): the ids of a stated, bounded list of keys.  Shards outside the keys' range are pruned by the
    Parquet statistics of first_key and last_key."""
    if len(keys) > 1_000_000:
        raise ValueError("look up at most 1,000,000 keys a call")
    wanted = np.unique(np.array(keys, np.int64))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                shard = Shard(row)
                first, count = shard.find(own)
                out = [(int(k), shard.ids(f + i).tolist()) for k, f, n in zip(own, first.tolist(), count.tolist(), strict=True) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    store = read_store(spark, path)
    if not len(wanted):
        return store.limit(0).selectExpr("first_key as doc_id", "cast(null as array<long>) as ids")
    near = store.filter((F.col("last_key") >= int(wanted[0])) & (F.col("first_key") <= int(wanted[-1])))
    return near.mapInArrow(run, "doc_id long, ids array<long>")
