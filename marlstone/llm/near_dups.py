"""Operator 4: near-duplicate documents by a MinHash LSH forest.

A document's set holds the 64-bit hashes of its distinct ``shingle``-word shingles.  Equal sets are one class from the
start, however many documents have them.  A tree of the forest is a sorted order of the classes' signatures: each tree
reads the minimum hashes from another one on, ``depth`` of them and ``MORE`` that only sort further.  Spark sorts all
trees' rows by ranges, ties cut by class, so that no order, prefix or copy group has to fit a task.

Neighbours in an order are candidates if their longest common prefix reaches ``depth``.  Depth adapts by region: a run
of more than ``REGION`` classes is read deeper, a minimum hash at a time, until its runs are small.  Runs become
groups whose full sets are compared exactly; a group of too many shingles is first compared with common leaders.
Then every region is looked at that was read deeper, or lies in such a group, and still holds classes that aren't
connected: it is compared exactly in blocks where a task can hold it; else its classes go to the next forest, of longer
prefixes and as many more trees as keep the same certainty, and in the last one to the comparison in blocks, too.  So no
pair that shares a prefix is given up, and a region of documents that merely share a passage costs more signatures
instead of all its pairs.

A pair of similarity 0.8 shares no prefix in any tree of a forest with probability (1 - 0.8**depth)**trees, at most 3
in a million; this is the only way to lose a link.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than a shingle are one shingle.

Edge cases: a null, empty or blank text has an empty set and is linked with nothing; repeated rows have equal sets
and one component; rows with a null id take part, but name a component only if it has no other id; an empty table
gives no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..sources.storage import scratch, stored
from .recompression import blocks, words_of
from .windows import NO_ID, batch_of, mixed, texts_of, tidied, trimmed, twisted

SHINGLE, SIMILARITY = 4, 80
#: Trees and depth of the forests, the first for all classes, the others for regions that need them.
FORESTS = ((24, 4), (72, 8), (180, 12))
#: Minimum hashes by which an order goes on beyond the depth; classes of a region that is not read deeper.
MORE, REGION = 4, 8192
#: Rows of the sorted orders that a task holds, 26 bytes each.
TASK_ROWS = 4_000_000
#: Shingles of the sets that one task compares at once; more are split.
GROUP_SHINGLES = 1_000_000
#: Leaders of a split group.
LEADERS = 8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts laid end to end: sorted distinct shingle hashes, text after text, and the sets' bounds."""
    n = len(ends)
    start, _, words, _ = words_of(LOWER[data], ends)
    count = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    first = np.cumsum(count) - count
    few = np.minimum(count, k)  # words of a document's shingles
    shingles = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    doc = np.repeat(np.arange(n), shingles)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    own = few[doc]
    hashes = twisted(own.astype(np.uint64))
    for i in range(k):  # word by word: a sum of powers could cancel
        live = own > i if own.min(initial=k) <= i else slice(None)
        hashes[live] = mixed(twisted(hashes[live]) ^ words[at[live] + i])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=n))))


def signatures(hashes: np.ndarray, bounds: np.ndarray, forest: int) -> np.ndarray:
    """The minimum hashes of each non-empty set, trees * depth of them, by their low 16 bits: an order needs no more."""
    trees, depth = FORESTS[forest]
    rng = np.random.default_rng([42024, forest])
    mul = rng.integers(1 << 62, 1 << 63, trees * depth, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.empty((len(full), trees * depth), ">u2")
    with np.errstate(over="ignore"):
        for j in range(trees * depth) if len(full) else ():
            out[:, j] = np.minimum.reduceat(((hashes * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), full)
    return out


def signed(texts: DataFrame, k: int) -> DataFrame:
    """(rid, rhash, n_shingles, a, b, sig): each document's set size, set name and signature in the first forest."""
    ddl = "rid long, rhash long, n_shingles long, a long, b long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2).cast(pa.large_binary())
            offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
            for x, y in blocks(col, offs):
                hashes, bounds = shingle_sets(data[offs[x] : offs[y]], offs[x + 1 : y + 1] - offs[x], k)
                sizes = np.diff(bounds)
                digests = [xxhash.xxh3_128_digest(hashes[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                names = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                rows = iter(signatures(hashes, bounds, 0))
                sig = pa.array([next(rows).tobytes() if n else None for n in sizes], pa.binary())
                yield batch_of([batch.column(0)[x:y], batch.column(1)[x:y], sizes, names[:, 0], names[:, 1], sig], ddl)

    return texts.mapInArrow(tidied(run), ddl)


def signed_again(texts: DataFrame, classes: DataFrame, k: int, forest: int) -> DataFrame:
    """``classes`` (cid, rid, rhash, n_shingles) with their signatures in a later forest."""
    ddl = "cid long, rid long, rhash long, n_shingles long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = []
            for text in batch.column(4).to_pylist():
                raw = np.frombuffer(text.encode(), np.uint8)
                sig.append(signatures(*shingle_sets(raw, np.array([len(raw)]), k), forest)[0].tobytes())
            if sig:
                yield batch_of([*batch.columns[:4], pa.array(sig, pa.binary())], ddl)

    rows = texts.join(classes.hint("shuffle_hash"), ["rid", "rhash"]).select("cid", "rid", "rhash", "n_shingles", "text")
    return rows.dropDuplicates(["cid"]).mapInArrow(run, ddl)


def orders(classes: DataFrame, forest: int) -> DataFrame:
    """(seq, cid): for each class and tree its place in the tree's order, the tree's number before minimum hashes."""
    trees, depth = FORESTS[forest]
    read = (np.arange(trees)[:, None] * depth + np.arange(depth + MORE)) % (trees * depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time: a class has a row in every tree.
            for x in range(0, batch.num_rows, 2048):
                cids = batch.column(0)[x : x + 2048].to_numpy()
                sig = fixed_rows(batch.column(1)[x : x + 2048])
                seq = np.empty((len(cids), trees, 1 + depth + MORE), ">u2")
                seq[:, :, 0], seq[:, :, 1:] = np.arange(trees), sig[:, read]
                seq = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * seq.shape[2]), seq.shape[0] * trees, [None, pa.py_buffer(seq.tobytes())])
                yield batch_of([seq.cast(pa.binary()), np.repeat(cids, trees)], "seq binary, cid long")

    return classes.select("cid", "sig").mapInArrow(run, "seq binary, cid long")


def fixed_rows(col: pa.Array) -> np.ndarray:
    """A column of byte strings of one length as rows of 16-bit units."""
    col = col.cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(">u2").reshape(len(col), -1)


REGIONS = "cid long, region long, first long, deeper boolean, edge boolean"


def regions(rows: DataFrame, depth: int, most: int, n_rows: int = 0) -> DataFrame:
    """``REGIONS`` of the sorted orders: for each class that shares ``depth`` minimum hashes with a neighbour, the
    region (named by these), the first class of the run it was put into, and whether the region was read deeper.
    ``edge``: the first class of a task's first and last regions, which may go on in other tasks.  ``n_rows``: rows
    known to come, so that a task holds about ``TASK_ROWS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        cid = np.concatenate([b.column(1).to_numpy() for b in got])
        seq = np.concatenate([fixed_rows(b.column(0)) for b in got])
        prefix = np.zeros(len(cid), int)  # units in common with the row before
        prefix[1:] = np.logical_and.accumulate(seq[1:] == seq[:-1], axis=1).sum(axis=1)

        def runs(units: int) -> tuple[np.ndarray, np.ndarray]:
            start = np.flatnonzero(prefix < units)
            size = np.diff(np.append(start, len(cid)))
            return np.repeat(start, size), np.repeat(size, size)

        head, size = runs(1 + depth)
        first, done = cid.copy(), np.zeros(len(cid), bool)
        for more in range(MORE + 1):
            start, members = runs(1 + depth + more)
            take = ~done if more == MORE else ~done & (members <= most)
            first[take] = cid[start[take]]
            done |= take
        name = np.zeros(len(cid), np.uint64)
        for unit in range(1 + depth):
            name = mixed(twisted(name) ^ seq[:, unit].astype(np.uint64))
        edge = (np.arange(len(cid)) == head) & ((head == 0) | (head == head[-1]))
        out = (size > 1) | edge
        yield batch_of([cid[out], name[out].view(np.int64), first[out], (size > most)[out], edge[out]], REGIONS)

    tasks = n_rows // TASK_ROWS
    more = [tasks] if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return rows.repartitionByRange(*more, "seq", "cid").sortWithinPartitions("seq", "cid").mapInArrow(run, REGIONS)


def linked_parts(sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """The connected parts of sets linked at ``similarity`` per cent: for each set, the first of its part."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(size)))
    part = np.full(n, -1)
    mark = np.zeros(int(ids.max()) + 1, bool)
    rest, rest_ids, rest_at = np.arange(n), ids, bounds[:-1]
    for seed in range(n):
        if part[seed] >= 0:
            continue
        part[seed] = seed
        queue = [seed]
        while queue and len(rest):
            u = queue.pop()
            own = ids[bounds[u] : bounds[u + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[rest_ids].astype(np.int64), rest_at)
            mark[own] = False
            hit = (part[rest] < 0) & (100 * common >= similarity * (size[u] + size[rest] - common))
            part[rest[hit]] = seed
            queue += rest[hit].tolist()
            free = part[rest] < 0
            if 2 * free.sum() < len(rest):  # drop what is placed
                rest = rest[free]
                rest_ids = np.concatenate([ids[bounds[v] : bounds[v + 1]] for v in rest]) if len(rest) else ids[:0]
                rest_at = np.cumsum(size[rest]) - size[rest]
    return part


def confirmed(groups: DataFrame, k: int, similarity: int) -> DataFrame:
    """(u, v): every set of the groups (grp, cid, text) and the first set of its linked part of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids: list[int] = []
        sets: list[np.ndarray] = []
        at = None

        def decide() -> pa.RecordBatch:
            own = np.array(cids)
            return batch_of([own, own[linked_parts(sets, similarity)]], "u long, v long")

        for batch in batches:
            for grp, cid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != at and cids:
                    yield decide()
                    cids, sets = [], []
                at = grp
                raw = np.frombuffer(text.encode(), np.uint8)
                cids.append(cid)
                sets.append(shingle_sets(raw, np.array([len(raw)]), k)[0])
        if cids:
            yield decide()
        trimmed()

    return groups.select("grp", "cid", "text").repartition("grp").sortWithinPartitions("grp", "cid").mapInArrow(run, "u long, v long")


def with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(grp, cid, text) of (grp, cid, rid, rhash); a document that is listed twice brings its set once."""
    return texts.join(rows.hint("shuffle_hash"), ["rid", "rhash"]).select("grp", "cid", "text").dropDuplicates(["grp", "cid"])


def led(texts: DataFrame, large: DataFrame, near: DataFrame, k: int, similarity: int, group_shingles: int) -> DataFrame:
    """Links (u, v) of groups that are too large for a task: chunks by hash, each with the group's leaders, the classes
    with most regions."""
    large = large.withColumn("chunks", F.ceil(2 * F.col("total") / group_shingles)).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    score = near.groupBy("cid").agg(F.count("*").alias("score"))
    slot = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(LEADERS))
    best = F.max_by(F.struct("cid", "rid", "rhash"), F.struct("score", "cid")).alias("x")
    leads = large.join(score, "cid").withColumn("slot", slot).groupBy("grp", "chunks", "slot").agg(best)
    leads = leads.select("grp", "x.*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    cols = ["grp", "chunk", "cid", "rid", "rhash"]
    rows = large.select(cols).unionByName(leads.select(cols)).withColumn("grp", F.xxhash64("grp", "chunk"))
    return confirmed(with_text(texts, rows), k, similarity)


def compared(texts: DataFrame, rest: DataFrame, k: int, similarity: int, group_shingles: int) -> DataFrame:
    """Links (u, v) of regions (region, cid, root, rid, rhash, n_shingles): classes outside a region's largest part
    (root) are compared with all of the region, block by block."""
    sizes = rest.groupBy("region", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("part"))
    sizes = sizes.groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("part").alias("total"))
    chunks = F.greatest(F.lit(1), F.ceil(2 * F.col("total") / group_shingles))
    rows = rest.join(stored(sizes, "sizes"), "region").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    rows = stored(rows, "rest")
    others = rows.filter("root != main").withColumn("block", F.col("chunk"))
    every = rows.join(others.select("region", "block").distinct(), "region")
    guests = others.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    grp = F.xxhash64("region", "chunk", "block").alias("grp")
    return confirmed(with_text(texts, every.select(grp, "cid", "rid", "rhash").unionByName(guests.select(grp, "cid", "rid", "rhash"))), k, similarity)


def forest_links(
    texts: DataFrame, classes: DataFrame, known: DataFrame | None, forest: int, k: int, similarity: int, group_shingles: int, region: int,
) -> tuple[DataFrame, bool]:
    """Links (u, v) of the classes (cid, rid, rhash, n_shingles, sig), and whether each class has one, to its part's
    first.  ``known``: (cid, root) of classes that are connected already."""
    trees, depth = FORESTS[forest]
    near = stored(regions(orders(classes, forest), depth, region, classes.count() * trees), "regions")
    if known is not None:  # regions of one part are settled
        near = near.join(known, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        parts = stored(near.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("region"), "parts")
        near = stored(near.join(parts, "region").drop("root"), "regions")
    edges = near.filter("edge")
    # Aggregates are tables before they are joined on their own key, so that adaptive execution can deal a key of very many rows.
    across = edges.join(stored(edges.groupBy("region").agg(F.min("first").alias("least")), "least"), "region").selectExpr("first as u", "least as v")
    groups = components(near.selectExpr("cid as u", "first as v").unionByName(across)).selectExpr("u as cid", "root as grp")
    members = groups.join(classes.select("cid", "rid", "rhash", "n_shingles"), "cid")
    members = stored(members, "grouped")
    members = stored(members.join(stored(members.groupBy("grp").agg(F.sum("n_shingles").alias("total")), "totals"), "grp"), "members")
    small, large = (members.filter(F.col("total") <= group_shingles), members.filter(F.col("total") > group_shingles))
    links = confirmed(with_text(texts, small), k, similarity)
    done = large.isEmpty()
    if not done:
        links = links.unionByName(led(texts, large, near, k, similarity, group_shingles))
    links = stored(links, "links")
    # Regions that were not compared as a whole.
    unsure = members.select("cid", (F.col("total") > group_shingles).alias("split"))
    rows = near.join(unsure, "cid", "left").filter("deeper or split").select("region").distinct()
    if rows.isEmpty():
        return links, done
    roots = links if known is None else links.unionByName(known.selectExpr("cid as u", "root as v"))
    roots = roots.selectExpr("u as cid", "v as root") if done and known is None else components(roots).selectExpr("u as cid", "root")
    rest = near.select("region", "cid").distinct().join(rows, "region").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    parts = stored(rest.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("region"), "parts")
    rest = stored(rest.join(parts, "region").join(classes.select("cid", "rid", "rhash", "n_shingles"), "cid"), "rest")
    if rest.isEmpty():
        return links, done
    # Regions that a task can hold, and all that the last forest leaves, are compared; the others go to the next forest.
    sizes = rest.groupBy("region").agg(F.sum("n_shingles").alias("total"))
    huge = sizes.filter(F.col("total") > group_shingles).select("region")
    if forest + 1 == len(FORESTS) or huge.isEmpty():
        return links.unionByName(compared(texts, rest, k, similarity, group_shingles)), False
    huge = stored(huge, "huge")
    links = links.unionByName(compared(texts, rest.join(huge, "region", "left_anti"), k, similarity, group_shingles))
    rest = stored(rest.join(huge, "region"), "rest")
    again = stored(signed_again(texts, rest.select("cid", "rid", "rhash", "n_shingles").distinct(), k, forest + 1), "again")
    roots = stored(rest.select("cid", "root").distinct(), "roots")
    return links.unionByName(forest_links(texts, again, roots, forest + 1, k, similarity, group_shingles, region)[0]), False


def find_near_dups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY,
    group_shingles: int = GROUP_SHINGLES, region: int = REGION,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, rhash (the text's hash), stays.  ``similarity``:
    least 100 * intersection / union of linked sets.  ``stays`` marks one (doc_id, text) of each component, the least by
    doc_id (null last) and rhash, and all documents without a shingle."""
    texts = texts_of(docs, id_col, text_col)
    known = F.when(F.col("rid") != F.lit(NO_ID), F.col("rid"))
    sets = stored(signed(texts, shingle), "sets")
    row = F.struct(known.isNull().alias("unnamed"), "rid", "rhash")
    one = [F.first(c).alias(c) for c in ("rid", "rhash", "n_shingles", "sig")]
    with scratch(docs.sparkSession):
        classes = sets.filter("n_shingles > 0").groupBy("a", "b").agg(F.min(known).alias("least_id"), F.min(row).alias("least_row"), *one)
        classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        links, done = forest_links(texts, classes, None, 0, shingle, similarity, group_shingles, region)
        roots = links.selectExpr("u as cid", "v as root") if done else components(links).selectExpr("u as cid", "root")
        named = classes.select("cid", "a", "b", "least_id", "least_row").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        named = stored(named, "named", keep=True)
        least = stored(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("least_row").alias("stay")), "least", keep=True)
    named = named.join(least, "root").select("a", "b", "component_id", "stay")
    some = sets.filter("n_shingles > 0").select(known.alias("doc_id"), "n_shingles", "rhash", "a", "b", row.alias("row"))
    some = some.join(named, ["a", "b"]).withColumn("stays", F.col("row") == F.col("stay")).drop("a", "b", "row", "stay")
    none = sets.filter("n_shingles = 0").select(known.alias("doc_id"), "n_shingles", "rhash", known.alias("component_id"), F.lit(True).alias("stays"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return some.unionByName(none).select("doc_id", "n_shingles", "component_id", kept, "rhash", "stays")
