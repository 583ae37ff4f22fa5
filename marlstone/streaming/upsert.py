"""Streaming upsert of history: our extension of the append-and-compact store to a file stream.

The history lies in buckets of its keys' hash.  A batch rewrites the buckets it touches, as ``v=<batch>`` of each, and
then writes a manifest that names every bucket's version: that is its commit.  A batch that runs again starts from the
manifest before it, so the result is exact.  Versions that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import upsert
from ..sources.storage import children, dropped


def _manifest(spark: SparkSession, target: str, n: int) -> dict[str, int]:
    return json.loads(spark.read.text(f"{target}/manifest/{n}").first()[0]) if n >= 0 else {}


def _paths(target: str, versions: dict[str, int]) -> list[str]:
    return [f"{target}/v={v}/bucket_={b}" for b, v in versions.items()]


def stream_upsert(rows: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key under ``target``; :func:`read_upserted` reads it."""

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
        batch = batch.persist()
        touched = [str(r[0]) for r in batch.select(bucket).distinct().collect()]  # at most ``buckets``
        before, older = _manifest(spark, target, n - 1), _manifest(spark, target, n - 2)
        old = _paths(target, {b: before[b] for b in touched if b in before})
        known = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
        upsert(known, batch, keys, order).withColumn("bucket_", bucket).write.mode("overwrite").partitionBy("bucket_").parquet(f"{target}/v={n}")
        now = {**before, **dict.fromkeys(touched, n)}
        spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/manifest/{n}")
        for path in set(_paths(target, older)) - set(_paths(target, before)):
            dropped(spark, path)
        batch.unpersist()

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The history after the last committed batch."""
    last = max((int(name) for name in children(spark, f"{target}/manifest")), default=-1)
    paths = _paths(target, _manifest(spark, target, last))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
