"""Sinks: ordered text reports, history export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(lines: DataFrame, order: str, path: str) -> None:
    """Text files whose names sort as their lines do: the lines are range-partitioned, never gathered in one task."""
    lines.orderBy(order).select(F.col("line").cast("string").alias("value")).write.text(path)


def export_history(sections: dict[str, DataFrame], path: str, created: str | None = None) -> None:
    """One JSON folder for each section, with its name, a version and when it was made (now, if not stated)."""
    stamp = F.lit(created) if created else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    for name, rows in sections.items():
        rows.withColumn("_schema_version", F.lit(1)).withColumn("_created", stamp).write.mode("overwrite").json(f"{path}/{name}")


def append_batches(batches: list[DataFrame], path: str) -> None:
    """Deferred batches as one append."""
    if batches:
        first, *rest = batches
        for b in rest:
            first = first.unionByName(b, allowMissingColumns=True)
        first.write.mode("append").parquet(path)
