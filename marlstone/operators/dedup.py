"""Duplicates: exact groups, near pairs, leader clusters, keep/delete plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .graph import components
from .signatures import classes_of, meetings, near_classes

#: Items of a component whose leaders are found by one scan.
MOST_ITEMS = 1_000_000
#: Items of the first batch of signatures that are paired with each other; all batches so far grow to this many times as many.
FIRST_ITEMS, GROWTH = 30_000, 3


def exact_groups(rows: DataFrame, key: str, item: str, scope: list[str] | None = None) -> DataFrame:
    """Key, number of items and least item of every group with more than one, within each scope."""
    return rows.groupBy(*(scope or []), key).agg(F.count("*").alias("n"), F.min(item).alias("first_id")).filter("n > 1")


def adjacent_pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b) for all two items of a group, a < b.  The pairs are the result asked for; a report over large groups
    takes :func:`exact_groups` or :func:`keep_delete`, which grow with the items."""
    left = rows.select(F.col(key).alias("k"), F.col(item).alias("a"))
    right = rows.select(F.col(key).alias("k"), F.col(item).alias("b"))
    return left.join(right, "k").filter("a < b").select("a", "b")


def keep_delete(rows: DataFrame, key: str, item: str, order: list[Column]) -> DataFrame:
    """(keep, dup): each item but the first of its group in ``order``, with that first.  The first is a map-side
    combined minimum, so that a group of any size is never sorted or gathered in one task; it is a table before it is
    joined, so that adaptive execution can deal the rows of such a group over tasks."""
    rank = F.struct(*order, F.col(item))
    first = rows.groupBy(key).agg(F.min(rank).alias("r"), F.count("*").alias("n")).filter("n > 1").select(key, F.col(f"r.{item}").alias("keep"))
    return rows.select(key, item).join(stored(first, "first"), key).filter(F.col(item) != F.col("keep")).select("keep", F.col(item).alias("dup"))


def near_pairs(sigs: DataFrame, item: str, sig: str, threshold: int) -> DataFrame:
    """(a, b, distance): signatures of 64 bits at most ``threshold`` bits apart, a < b, in which every two members of near
    classes are listed, as asked; :func:`near_classes` and :func:`members` grow with the items instead."""
    classes = classes_of(sigs, item, sig)
    own = stored(sigs.select(F.col(item).alias("x"), F.col(sig).alias("s")).join(classes.select("s", "id"), "s").select("x", "id"), "members")
    pairs = near_classes(classes, threshold).unionByName(classes.filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")))
    found = pairs.join(own.select(F.col("id").alias("a"), F.col("x")), "a").join(own.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
    once = (F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))
    return found.filter(once).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def leader_clusters(pairs: DataFrame, items: DataFrame, item: str, most: int = MOST_ITEMS) -> DataFrame:
    """(leader, member) of greedy leader clusters in order of ``item``: an item is a leader unless an earlier leader is
    near it, and joins the first such leader.  Leaders alone are left out.

    Components of the pairs don't touch each other.  One of up to ``most`` items is settled by a scan of its pairs in
    order, in which a task holds the members found so far; larger ones by rounds, each of which settles the items whose
    earlier neighbours are settled, so their number grows with the longest chain."""
    known = stored(pairs.select("a", "b").join(items.select(F.col(item).alias("a")), "a", "left_semi"), "pairs")
    parts = components(known.selectExpr("a as u", "b as v"))
    sizes = parts.groupBy("root").agg(F.count("*").alias("n"))
    sized = stored(known.join(parts.withColumnRenamed("u", "a"), "a").join(sizes, "root"), "sized")
    kind = dict(sized.dtypes)["a"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, at, first, members = None, None, None, set()
        out: list[tuple] = []

        def close() -> None:
            if first is not None:
                members.add(at)
                out.append((first, at))

        for batch in batches:
            for r, b, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r, b) != (root, at):
                    close()
                    if r != root:
                        members = set()
                    root, at, first = r, b, None
                if first is None and a not in members:
                    first = a
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], batch.schema.field(1).type) for i in range(2)], names=["leader", "member"])
            out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], batch.schema.field(1).type) for i in range(2)], names=["leader", "member"])

    small = sized.filter(F.col("n") <= most).select("root", "b", "a").repartition("root").sortWithinPartitions("root", "b", "a")
    found = small.mapInArrow(settle, f"leader {kind}, member {kind}")
    large = sized.filter(F.col("n") > most).select("a", "b")
    return found if large.isEmpty() else found.unionByName(_leaders_by_rounds(stored(large, "large")))


def _leaders_by_rounds(known: DataFrame) -> DataFrame:
    state = stored(known.select(F.col("a").alias("id")).union(known.select(F.col("b").alias("id"))).distinct().withColumn("kind", F.lit(None).cast("string")), "state")
    while True:
        before = known.join(state.selectExpr("id as a", "kind as earlier"), "a")
        seen = before.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.col("earlier") == "leader").alias("led"), F.bool_or(F.col("earlier").isNull()).alias("open"))
        kind = F.coalesce("kind", F.when(F.coalesce("led", F.lit(False)), "member").when(~F.coalesce("open", F.lit(False)), "leader"))
        state = stored(state.join(seen, "id", "left").select("id", kind.alias("kind")), "state")
        if state.filter("kind is null").isEmpty():
            break
    led = known.join(state.filter("kind = 'leader'").selectExpr("id as a"), "a").join(state.filter("kind = 'member'").selectExpr("id as b"), "b")
    return led.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("leader")).select("leader", "member")


def signature_leaders(firsts: DataFrame, threshold: int, batch: int = FIRST_ITEMS) -> DataFrame:
    """(leader, member) of the leader clusters of distinct signatures (id, s), in batches of rising ids.  A batch's leaders
    take their members from all later items before these are paired with each other, so pairs grow with the leaders near
    an item, which are far apart, and not with the square of a cluster.  Earlier batches have the earlier leaders, so what is
    taken is taken by its first."""
    rest, led = stored(numbered(firsts.select("id", "s"), "id"), "rest"), []
    n = rest.count()
    without = lambda rows, some: rows.join(some.select(F.col("member").alias("id")).hint("merge"), "id", "left_anti")
    while True:
        own, later = rest.filter(F.col("i") <= batch), rest.filter(F.col("i") > batch)
        led.append(stored(leader_clusters(near_classes(own, threshold), own, "id"), "led"))
        if batch >= n:
            return reduce(DataFrame.unionByName, led)
        pairs = meetings(without(own, led[-1]).select("id", "s"), later.select("id", "s"), threshold, [], F.lit(True))
        led.append(stored(pairs.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("leader")).select("leader", "member"), "taken"))
        rest, batch = stored(without(later, led[-1]), "rest"), batch * GROWTH


def signature_clusters(sigs: DataFrame, item: str, sig: str, threshold: int, batch: int = FIRST_ITEMS) -> DataFrame:
    """(leader, member) of the leader clusters of signatures.  Items with one signature are clustered as its first item:
    the others join the leader that item has, or is, so copies are never paired with each other."""
    sigs = stored(sigs.select(item, sig), "signatures")
    firsts = classes_of(sigs, item, sig)
    led = signature_leaders(firsts, threshold, batch).withColumnRenamed("member", "id")
    leader = stored(firsts.join(led.hint("merge"), "id", "left").select(F.col("s").alias(sig), F.coalesce("leader", "id").alias("leader")), "leaders")
    return sigs.join(leader.hint("merge"), sig).filter(F.col(item) != F.col("leader")).select("leader", F.col(item).alias("member"))


def plan_totals(plan: DataFrame, sizes: DataFrame, item: str, size: str) -> DataFrame:
    """Number of deletions and the size they free."""
    return plan.join(sizes.select(F.col(item).alias("dup"), F.col(size).alias("size")), "dup").agg(F.count("*").alias("n_deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their number ``i`` in order, from 1: a task's offset plus the row within the task."""
    ordered = rows.orderBy(*order).withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    ordered = stored(ordered, "ordered")
    sizes = ordered.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    row = F.row_number().over(Window.partitionBy("task").orderBy("place"))
    return ordered.join(F.broadcast(offsets), "task").withColumn("i", F.col("base") + row).drop("task", "place", "base")


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    """Report lines ``n. a  <=>  b``, numbered in order."""
    line = F.format_string("%d. %s  <=>  %s", "i", F.col("a").cast("string"), F.col("b").cast("string"))
    return numbered(pairs, "a", "b").select("i", line.alias("line"))


def plan_lines(plan: DataFrame, mark: str = "") -> DataFrame:
    """(i, part, line): two report lines for each (keep, dup) of a plan, ``n. KEEP`` and ``DEL`` below it.  ``mark`` stands
    before the number, and the second line is indented by as much more."""
    keep = F.format_string(f"{mark}%d. KEEP %s", "i", F.col("keep").cast("string"))
    drop = F.concat(F.lit(" " * (4 + len(mark)) + "DEL  "), F.col("dup").cast("string"))
    return numbered(plan, "keep", "dup").select("i", F.posexplode(F.array(keep, drop)).alias("part", "line"))


def live_rows(rows: DataFrame, inventory: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose item is still in the inventory, and the number that is missing."""
    now = inventory.select(item).distinct()
    return rows.join(now, item, "left_semi"), rows.join(now, item, "left_anti").agg(F.count("*").alias("n_missing"))
