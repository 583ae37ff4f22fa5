"""The history store's JSON file, and its export.  Missing sections are empty; nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = {
    "gif_stats": "palette int, width int, height int, frames int, fast_size double, med_size double, scale double, timestamp double, count int",
    "webp_animated_stats": "width int, height int, frames int, init_size_mb double, quality int, method int, result_size_mb double, encode_sec double, timestamp double, count int, resize_count int, final_width int, final_height int",
    "video_webp_stats": "profile string, source_width int, source_height int, source_fps_bucket double, source_duration_bucket double, source_size_bucket double, source_size_mb double, quality int, width int, result_size_mb double, encode_sec double, attempts int, success boolean, timestamp double, count int",
}
KEYS = {
    "gif_stats": ["palette", "width", "height", "frames"],
    "webp_animated_stats": ["width", "height", "frames", "init_size_mb", "method"],
    "video_webp_stats": ["source_width", "source_height", "source_fps_bucket", "source_duration_bucket", "source_size_bucket", "profile"],
}


def read_history(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One DataFrame for each section of a history file (UTF-8, with or without a byte order mark)."""
    ddl = ", ".join(f"{name} array<struct<{cols.replace(' ', ':').replace(',:', ',')}>>" for name, cols in SECTIONS.items())
    raw = spark.read.schema(ddl).option("multiLine", True).json(path)
    return {name: raw.select(F.inline(name)) for name in SECTIONS}


def video_probe(text: str = "probe") -> list:
    """Columns of a probe's JSON: width, height, fps, duration; null where it can't be read."""
    from ..functions.rules import fraction

    parsed = F.from_json(F.col(text), "streams array<struct<width:int,height:int,avg_frame_rate:string>>, format struct<duration:string>")
    stream = F.get(parsed["streams"], 0)
    return [stream["width"].alias("width"), stream["height"].alias("height"), fraction(stream["avg_frame_rate"]).alias("fps"), parsed["format"]["duration"].try_cast("double").alias("duration")]


def write_section(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).parquet(path)


def version_of(text: Column, name: str = "APP_VERSION") -> Column:
    """The value of a version constant in source text: of the first line that starts with ``name`` and sets it to a text in
    double quotes; empty if there is none, null for a null text."""
    return F.regexp_extract(text, rf'(?m)^{name}\s*=\s*"([^"]+)"', 1)


def tool_version(texts: DataFrame, text: str = "value", name: str = "APP_VERSION") -> DataFrame:
    return texts.select(version_of(F.col(text), name).alias("version"))
