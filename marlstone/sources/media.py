"""Media inventory: files, header checks and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import MB, PROCESS_ABOVE, STATIC_BYTES, suffix

#: Suffixes of images.
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff")


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content: content is read only by queries that use it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)


def images(inventory: DataFrame) -> DataFrame:
    return inventory.filter(suffix(F.col("path")).isin(*IMAGES))


def file_count(inventory: DataFrame) -> DataFrame:
    """The number of files, without their content."""
    return inventory.agg(F.count("path").alias("n"))


def animated(content: Column) -> Column:
    """Whether a RIFF/WEBP file's first eight chunks hold the animation flag or an ANIM chunk; false for other files and
    null.  A walk over chunk heads in built-in functions: a chunk's size says where the next one starts."""
    size = F.length(content)
    part = lambda at, n: F.substring(content, at + 1, F.lit(n))
    number = lambda *at: F.conv(F.concat(*(F.hex(part(x, 1)) for x in at)), 16, 10).cast("bigint")

    def chunk(state: Column, _: Column) -> Column:
        at = state["at"]
        whole = size >= at + 8
        flagged = (part(at, 4) == F.lit(bytearray(b"VP8X"))) & (size > at + 8) & (number(at + 8).bitwiseAND(2) > 0)
        hit = whole & ((part(at, 4) == F.lit(bytearray(b"ANIM"))) | flagged)
        length = number(at + 7, at + 6, at + 5, at + 4)
        follow = F.when(whole, F.least(at + 8 + length + length % 2, size.cast("bigint"))).otherwise(size).cast("int")
        return F.struct(follow.alias("at"), F.coalesce(state["found"] | hit, F.lit(False)).alias("found"))

    start = F.struct(F.lit(12).alias("at"), F.lit(False).alias("found"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, chunk, lambda s: s["found"])
    riff = (size >= 12) & (F.substring(content, 1, 4) == F.lit(bytearray(b"RIFF"))) & (F.substring(content, 9, 4) == F.lit(bytearray(b"WEBP")))
    return F.when(riff, walk).otherwise(False)


def route(ext: Column, size: Column, is_anim: Column) -> Column:
    """Where a file goes, or null: gif, video, png, jpg, webp_animated, webp_static."""
    large = size > PROCESS_ABOVE * MB
    return (
        F.when(ext == ".gif", F.when(large, "gif"))
        .when(ext.isin(".mp4", ".mov"), "video")
        .when(ext == ".png", "png")
        .when(ext.isin(".jpg", ".jpeg"), F.when(size > STATIC_BYTES, "jpg"))
        .when(ext == ".jfif", "jpg")
        .when((ext == ".webp") & (size > STATIC_BYTES), F.when(is_anim, F.when(large, "webp_animated")).otherwise("webp_static"))
    )


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.filter("route is not null").groupBy("route").agg(F.count("*").alias("n"))
