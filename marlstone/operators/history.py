"""Run history: latest-per-key upserts, compaction, time-decayed means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``: a map-side combined maximum, never a sort of a whole key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(rows.columns)


def latest_in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, the oldest of them first."""
    return latest(rows, keys, order).orderBy(*order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """History with ``new`` rows in place of older ones of their key."""
    return latest(old.unionByName(new, allowMissingColumns=True), keys, order)


def compact(rows: DataFrame, keys: list[str], order: list[str], scale: str | None = None, default: float = 0.75) -> DataFrame:
    """The last row of each key, with ``count`` the number of rows it stands for (not a sum of earlier counts).  Where the
    last of several rows has no ``scale``, it gets their mean, a missing one counting as ``default``.

    With one column of order each column is taken by itself, all from one row, as which row it is depends on the order alone:
    numbers are then aggregated by hashes, where structs would have all rows sorted."""
    rest = [c for c in rows.columns if c not in keys and c not in order and c != "count"]
    if len(order) == 1:
        last = [F.when(F.max(order[0]).isNull(), F.first(c)).otherwise(F.max_by(c, order[0])).alias(c) for c in rest]
        best = [F.struct(F.max(order[0]).alias(order[0]), *last).alias("r"), F.count("*").alias("count")]
    else:
        best = [F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("r"), F.count("*").alias("count")]
    mean = [F.avg(F.coalesce(F.col(scale), F.lit(default))).alias("mean_scale")] if scale else []
    rows = rows.groupBy(*keys).agg(*best, *mean).select(*keys, "r.*", "count", *(["mean_scale"] if scale else []))
    if not scale:
        return rows
    return rows.withColumn(scale, F.when(F.col(scale).isNull() & (F.col("count") > 1), F.col("mean_scale")).otherwise(F.col(scale))).drop("mean_scale")


def decayed_mean(rows: DataFrame, keys: list[str], value: str, age_seconds: Column, half_life: float = 86_400.0) -> DataFrame:
    """Mean of positive values weighted by 2 ** (-age / half-life); a missing age counts as 0; null without weight."""
    w = F.pow(F.lit(2.0), -F.coalesce(age_seconds, F.lit(0.0)) / half_life)
    rows = rows.filter(F.col(value) > 0).select(*keys, (F.col(value) * w).alias("vw"), w.alias("w"))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum("vw"), F.sum("w")).alias("decayed_mean"))
