"""Bracketed searches over observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.storage import stored


def in_blocks(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """The key, order and value columns of ``rows`` with ``_block``: ranges of (key, order), dealt by Spark, so that a key of
    very many rows is several blocks and none is a task's alone.  Running values are taken within blocks; what earlier
    blocks of the key add is small.  The operators below return these columns and their own."""
    ranges = rows.select(list(dict.fromkeys([key, *order, *values]))).repartitionByRange(key, *order).withColumn("_block", F.spark_partition_id())
    return stored(ranges, "blocks")


def _within(key: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(key, "_block").orderBy(*order)


def _earlier(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("r._block") == F.col("c._block"))
    return rows.alias("r").join(blocks.alias("c"), same).select("r.*", *(f"c.{x}" for x in blocks.columns if x not in (key, "_block")))


def running_bracket(rows: DataFrame, key: str, order: list[str], value: str, low: float, high: float) -> DataFrame:
    """After each observation: the largest value under ``low`` and the smallest over ``high`` so far."""
    rows = in_blocks(rows, key, order, value)
    v = F.col(value)
    under, over = F.max(F.when(v < low, v)), F.min(F.when(v > high, v))
    blocks = rows.groupBy(key, "_block").agg(under.alias("_u"), over.alias("_o"))
    blocks = blocks.select(key, "_block", F.max("_u").over(_earlier(key)).alias("_under"), F.min("_o").over(_earlier(key)).alias("_over"))
    own = _within(key, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _carried(rows.withColumn("under", under.over(own)).withColumn("over", over.over(own)), blocks, key)
    return rows.withColumn("under", F.greatest("under", "_under")).withColumn("over", F.least("over", "_over")).drop("_block", "_under", "_over")


def carried_values(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with the last ``value`` that isn't null ``before`` each row in its key's order, and the next one ``after``."""
    rows = in_blocks(rows, key, order, value)
    v = F.struct(F.col(value).alias("v"))
    some = F.when(F.col(value).isNotNull(), v)
    blocks = rows.groupBy(key, "_block").agg(F.max_by(v, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_l"), F.min_by(v, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_f"))
    later = Window.partitionBy(key).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", F.last("_l", True).over(_earlier(key)).alias("_past"), F.last("_f", True).over(later).alias("_coming"))
    up = _within(key, order).rowsBetween(Window.unboundedPreceding, -1)
    # Downwards in reverse order: a frame that reaches to the end is read anew for every row.
    down = Window.partitionBy(key, "_block").orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = _carried(rows.withColumn("before", F.last(some, True).over(up)).withColumn("after", F.last(some, True).over(down)), blocks, key)
    return rows.withColumn("before", F.coalesce("before", "_past")["v"]).withColumn("after", F.coalesce("after", "_coming")["v"]).drop("_block", "_past", "_coming")


def _run_ends(blocks: DataFrame, key: str, goes_on: Column) -> DataFrame:
    """(key, _block, _carry): the run that is open where a block of (_n, _tail) begins.  ``goes_on``: the block is all one run
    that continues the block before; its rows _n then add to that run, else _tail rows at its end start a new one."""
    w = Window.partitionBy(key).orderBy("_block")
    blocks = blocks.withColumn("_on", F.coalesce(goes_on, F.lit(False)) & (F.row_number().over(w) > 1))
    blocks = blocks.withColumn("_chain", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    chain = Window.partitionBy(key, "_chain").orderBy("_block")
    blocks = blocks.withColumn("_end", F.sum(F.when(F.col("_on"), F.col("_n")).otherwise(F.col("_tail"))).over(chain))
    return blocks.withColumn("_carry", F.coalesce(F.lag("_end").over(w), F.lit(0)))


def run_lengths(rows: DataFrame, key: str, order: list[str], same: str) -> DataFrame:
    """``run``: how many rows in a row, so far, have the same value."""
    rows = in_blocks(rows, key, order, same)
    w = _within(key, order)
    new = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    rows = rows.withColumn("run", F.row_number().over(Window.partitionBy(key, "_block", "_island").orderBy(*order)))
    last = F.max_by(F.struct(F.col(same).alias("v"), F.col("run").alias("tail")), F.struct(*order))
    first = F.min_by(F.struct(F.col(same).alias("v")), F.struct(*order))
    blocks = rows.groupBy(key, "_block").agg(F.count("*").alias("_n"), F.max("_island").alias("_islands"), first.alias("_first"), last.alias("_last"))
    before = Window.partitionBy(key).orderBy("_block")
    blocks = blocks.withColumn("_joins", F.lag("_last.v").over(before).eqNullSafe(F.col("_first.v")) & (F.row_number().over(before) > 1)).withColumn("_tail", F.col("_last.tail"))
    blocks = _run_ends(blocks, key, F.col("_joins") & (F.col("_islands") == 1)).select(key, "_block", F.when(F.col("_joins"), F.col("_carry")).otherwise(0).alias("_carry"))
    rows = _carried(rows, blocks, key)
    run = F.col("run") + F.when(F.col("_island") == 1, F.col("_carry")).otherwise(0)
    return rows.withColumn("run", run.cast("int")).drop("_new", "_island", "_block", "_carry")


def guard_hits(rows: DataFrame, key: str, order: list[str], hit: Column, limit: int) -> DataFrame:
    """``hits``: consecutive hits so far, reset by any other row; ``tripped`` once they reach ``limit``."""
    rows = in_blocks(rows.withColumn("_hit", F.coalesce(hit.cast("int"), F.lit(0))), key, order, "_hit")
    w = _within(key, order)
    rows = rows.withColumn("_island", F.sum(1 - F.col("_hit")).over(w))
    rows = rows.withColumn("hits", F.sum("_hit").over(Window.partitionBy(key, "_block", "_island").orderBy(*order)))
    blocks = rows.groupBy(key, "_block").agg(F.count("*").alias("_n"), F.sum("_hit").alias("_k"), F.max_by("hits", F.struct(*order)).alias("_tail"))
    blocks = _run_ends(blocks, key, F.col("_n") == F.col("_k")).select(key, "_block", "_carry")
    rows = _carried(rows, blocks, key)
    rows = rows.withColumn("hits", F.col("hits") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0))
    return rows.withColumn("tripped", F.col("hits") >= limit).drop("_hit", "_island", "_block", "_carry")


def index_buckets(rows: DataFrame, key: str, order: list[str], k: int, duration: str, first: str) -> DataFrame:
    """Every ``k`` rows of a key become one: the first row's value and the summed duration, 20 at least."""
    rows = in_blocks(rows, key, order, duration, first)
    blocks = rows.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select(key, "_block", F.coalesce(F.sum("_n").over(_earlier(key)), F.lit(0)).alias("_before"))
    rows = _carried(rows.withColumn("_rn", F.row_number().over(_within(key, order)) - 1), blocks, key).withColumn("_rn", F.col("_rn") + F.col("_before"))
    rows = rows.withColumn("bucket", F.floor(F.col("_rn") / max(1, k)).cast("int"))
    return rows.groupBy(key, "bucket").agg(F.min_by(first, "_rn").alias("first"), F.greatest(F.lit(20.0), F.sum(duration)).alias("duration"))


def largest_under(rows: DataFrame, size_of: Callable[[Column], Column], limit: Column, low: int, high: int) -> Column:
    """The largest q of ``low..high`` with size_of(q) <= limit; null if none.  For a size that grows with q."""
    qs = F.sequence(F.lit(low), F.lit(high))
    return F.array_max(F.filter(qs, lambda q: size_of(q) <= limit))


def next_quality(quality: Column, size: Column, target: Column | float, under: Column, over: Column) -> Column:
    """Bisection between known bounds, else the root correction, clamped by the distance from the target."""
    target = rules.col(target)
    ratio = size / target
    step = F.sqrt(target / size)
    far = (ratio > 1.20) | (ratio < 0.80)
    step = F.when(far, rules.clamp(step, 0.70, 1.30)).otherwise(rules.clamp(step, 0.88, 1.12))
    q = rules.clamp((quality * step).cast("int"), 1, 100)
    q = F.when(q.isNotNull(), F.least(F.greatest(q, under + 1), over - 1))  # least and greatest skip unknown bounds
    return F.when((over - under) > 1, F.floor((over + under) / 2).cast("int")).otherwise(q)


def scale_step(scale: Column, size: Column, low: Column, high: Column, ratio: float = 0.35) -> tuple[Column, Column, Column]:
    """One step of the search for a scale: the bracket's ends after a result of ``size``, and the next scale to try, a
    step-capped root correction inside the bracket, else its midpoint; null where the size lies in the band."""
    over = size > rules.TARGET_MAX
    low, high = F.when(over, low).otherwise(scale), F.when(over, scale).otherwise(high)
    wish = rules.step_cap(scale, rules.suggested_scale(scale, rules.MID, size), ratio)
    return low, high, F.when(~rules.in_band(size), rules.bracket_clamp(wish, low, high))


def scale_decision(source: Column, it: Column, fast: Column, predicted: Column, ratio_known: Column, fresh: Column) -> Column:
    """Why an expensive encode can be skipped, or null: the first rule that holds."""
    guess = source.isin("formula", "neighbor stats")
    probed = (it <= 1) & guess & ratio_known
    over = predicted > rules.TARGET_MAX * F.when(fresh, 1.005).otherwise(1.08)
    return (
        F.when((it == 0) & guess & (fast > 1.30 * rules.TARGET_MAX), "hard skip")
        .when((it == 0) & guess & (predicted > 1.20 * rules.TARGET_MAX) & (fast > 0.90 * rules.TARGET_MAX), "first-med skip")
        .when(probed & over, "overflow skip")
        .when(probed & (predicted < rules.TARGET_MIN - 0.10), "underflow skip")
    )
