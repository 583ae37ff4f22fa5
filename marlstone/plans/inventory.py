"""Files and what they say of themselves: containers, headers, stores and probes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers, history_json, media
from ..sources.storage import shared_dir, table
from .registry import query


def little(x: Column, size: int) -> Column:
    """A number as so many bytes in hexadecimal digits, the lowest first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(x.cast("bigint"), 8 * i).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0") for i in range(size)))


def built_containers(part: DataFrame) -> DataFrame:
    """(partkey, content): a file for each part, three kinds in turn: a GIF of p_size % 7 frames, of which every third states no
    duration and all carry a comment of several blocks; an animated WEBP of as many and a chunk of odd length; other bytes."""
    k, n, lit = F.col("p_partkey"), (F.col("p_size") % 7).cast("int"), F.lit
    frames = F.when(n > 0, F.sequence(lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    comment = F.concat(lit("21FE"), *[lit("05" + "6162630A64")] * 3, lit("0203FF00"))
    control = lambda i: F.when(i % 3 < 2, F.concat(lit("21F90400"), little((k + i * 7) % 90, 2), lit("0000"))).otherwise(lit(""))
    image = lambda i: F.concat(comment, control(i), lit("2C00000000"), little(k % 500 + 1, 2), little(F.col("p_size"), 2), lit("000203AABBCC01DD00"))
    bits = (k % 3).cast("int")  # a palette of 2, 4 or 8
    palette = F.array_join(F.array_repeat(lit("0A0B0C"), (2 * F.pow(lit(2), bits)).cast("int")), "")
    gif = F.concat(lit("474946383961"), little(k % 500 + 1, 2), little(F.col("p_size"), 2), little(bits + 128, 1), lit("0000"), palette, F.array_join(F.transform(frames, image), ""), lit("3B"))
    anmf = lambda i: F.concat(lit("414E4D46"), little(lit(17), 4), lit("00" * 12), little(k * 3 + i, 3), lit("00"), lit("AA"), lit("00"))
    canvas = F.concat(lit("56503858"), little(lit(10), 4), lit("02000000"), little(k % 700, 3), little(F.col("p_size"), 3))
    webp = F.concat(lit("524946460000000057454250"), canvas, lit("45584946"), little(lit(3), 4), lit("01020300"), F.array_join(F.transform(frames, anmf), ""))
    digits = F.when(k % 3 == 0, gif).when(k % 3 == 1, webp).otherwise(F.hex("p_name"))
    return part.select(k.alias("partkey"), F.unhex(digits).alias("content"))


CONTAINER_SQL = """WITH g AS (SELECT p_partkey AS k, p_partkey % 3 AS kind, p_size AS s, unnest(range(0, p_size % 7)) AS i FROM part WHERE p_partkey % 3 < 2 AND p_size % 7 > 0),
 d AS (SELECT *, CASE WHEN kind = 1 THEN k * 3 + i WHEN i % 3 < 2 THEN (k + i * 7) % 90 * 10 ELSE 100 END AS ms FROM g),
 f AS (SELECT k AS partkey, CASE kind WHEN 0 THEN 'gif' ELSE 'webp' END AS kind, CASE kind WHEN 0 THEN k % 500 + 1 ELSE k % 700 + 1 END AS width, CASE kind WHEN 0 THEN s ELSE s + 1 END AS height,
  CASE kind WHEN 0 THEN 2 * pow(2, k % 3)::INT ELSE 0 END AS palette, ms FROM d),
 one AS (SELECT p_partkey AS partkey, 'webp' AS kind, p_partkey % 700 + 1 AS width, p_size + 1 AS height, 0 AS palette, 100 AS ms FROM part WHERE p_partkey % 3 = 1 AND p_size % 7 = 0)
 SELECT partkey, kind, width, height, palette, count(*) AS frames, sum(ms)::BIGINT AS total_ms, max(ms) AS longest_ms FROM (SELECT * FROM f UNION ALL SELECT * FROM one) GROUP BY ALL"""


@query(CONTAINER_SQL)
def container_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, palette, frames and durations of each part's file, read from its bytes."""
    return containers.summaries(containers.with_frames(built_containers(table(spark, sf_dir, "part"))), ["partkey"])


@query("SELECT p_partkey AS partkey, p_partkey % 3 = 1 AS animated FROM part")
def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part's file is an animation, by the first chunks of its head."""
    return built_containers(table(spark, sf_dir, "part")).select("partkey", media.animated(F.col("content")).alias("animated"))


@query("SELECT n_name AS name, 0 AS images FROM nation UNION ALL SELECT n_name || '.PNG', 1 FROM nation UNION ALL SELECT 'sub/' || n_name || '.jpeg', 1 FROM nation")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder tree of a file without a suffix and two images for each nation, listed again: all files, and which are images."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    names = table(spark, sf_dir, "nation").select("n_name")
    empty_files(spark, root, names.select(F.explode(F.array(F.col("n_name"), F.concat("n_name", F.lit(".PNG")), F.concat(F.lit("sub/"), "n_name", F.lit(".jpeg")))).alias("name")))
    found = media.files(spark, root).select("path", "length")
    name = F.regexp_extract("path", "/files-[0-9a-f]+/(.*)$", 1).alias("name")
    image = media.images(found).select(name, F.lit(1).alias("images"))
    return found.select(name).join(image, "name", "left").select("name", F.coalesce("images", F.lit(0)).alias("images"))


@query("SELECT count(*) * 3 AS n FROM nation")
def counted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    names = table(spark, sf_dir, "nation").select("n_name")
    empty_files(spark, root, names.select(F.explode(F.array(F.col("n_name"), F.concat(F.lit("a/"), "n_name"), F.concat(F.lit("a/b/"), "n_name"))).alias("name")))
    return media.file_count(media.files(spark, root))


def empty_files(spark: SparkSession, root: str, names: DataFrame) -> None:
    """Small files of given names (few: the driver makes them), by the file system that the shared folder is in."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in names.collect():  # three for each of the nations
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{r[0]}"))
        out.write(1)
        out.close()


@query("""SELECT p_size % 4 AS palette, count(*) AS n, sum(p_size) AS width, round(sum(p_retailprice), 3) AS fast_size FROM part GROUP BY 1""")
def read_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History files with a section of parts, read section by section."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    entry = F.struct(*(F.expr(x) for x in ("p_size % 4 as palette", "p_size as width", "p_retailprice as fast_size")))
    # A file is one object, so of a thousand parts.
    files = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("file")).agg(F.collect_list(entry).alias("gif_stats"))
    files.repartition("file").write.partitionBy("file").json(path)
    found = history_json.read_history(spark, path)["gif_stats"]
    return found.groupBy("palette").agg(F.count("*").alias("n"), F.sum("width").alias("width"), F.round(F.sum("fast_size"), 3).alias("fast_size"))


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id % 4000 END AS width, CASE WHEN event_id % 5 > 0 THEN (event_id % 300)::INT END AS height,
 CASE WHEN event_id % 5 > 0 THEN (event_id % 60000)::DOUBLE / greatest(1, event_id % 1001) END AS fps, CASE WHEN event_id % 5 > 1 THEN value END AS duration FROM events""")
def video_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe's JSON for each event: some broken, some without a duration that can be read."""
    e = F.col("event_id")
    stream = F.struct((F.col("user_id") % 4000).cast("int").alias("width"), (e % 300).cast("int").alias("height"), F.concat((e % 60000).cast("string"), F.lit("/"), (e % 1001).cast("string")).alias("avg_frame_rate"))
    said = F.when(e % 5 == 1, "N/A").otherwise(F.col("value").cast("string"))
    probe = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(said.alias("duration")).alias("format")))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 0, "no such file").otherwise(probe).alias("probe"))
    return rows.select("event_id", *history_json.video_probe())


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1.' || doc_id ELSE '' END AS version FROM documents""")
def tool_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version constant in a source text for each document, which two of three don't set."""
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('APP_VERSION = "1.'), F.col("doc_id").cast("string"), F.lit('"\nx = 1'))).when(F.col("doc_id") % 3 == 1, '  APP_VERSION = "2"').otherwise("VERSION = 3")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("import os\n"), line).alias("value"))
    return docs.select("doc_id", history_json.version_of(F.col("value")).alias("version"))
