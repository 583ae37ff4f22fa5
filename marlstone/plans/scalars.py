"""Queries over the scalar rules, report texts, sinks and small reports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import admin, decisions, dedup, history, recovery, search
from ..sources import history_json, sinks
from ..sources.storage import shared_dir, table
from .catalog import BASE_SQL, KEEP, NAME_SQL, backup_sets, deletions
from .registry import query

#: A part as a file: its size in MB, scale, quality and frames.
FILE_SQL = """SELECT p_partkey AS partkey, p_partkey AS k, p_size AS sz, p_retailprice / 60.0::DOUBLE AS size, 0.4::DOUBLE + p_size / 50.0::DOUBLE AS scale, 40 + p_size AS q, p_size * 30 AS frames,
 p_retailprice / 70.0::DOUBLE AS predicted FROM part"""
SUGGESTED_SQL = "greatest(0.01::DOUBLE, scale * sqrt(14.245::DOUBLE / size))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as partkey", "p_partkey as k", "p_size as sz", "p_retailprice / 60.0D as size", "0.4D + p_size / 50.0D as scale", "40 + p_size as q", "p_size * 30 as frames", "p_retailprice / 70.0D as predicted"
    )


def capped_sql(wish: str, ratio: float) -> str:
    return f"(CASE WHEN abs({wish} - scale) <= scale * {ratio}::DOUBLE THEN {wish} ELSE scale + sign({wish} - scale) * scale * {ratio}::DOUBLE END)"


def clamped_sql(x: str, low: str, high: str) -> str:
    return f"(CASE WHEN {low} < {high} AND {x} > {low} AND {x} < {high} THEN {x} ELSE ({low} + {high}) / 2 END)"


@query(f"""WITH f AS ({FILE_SQL}), c AS (SELECT *, greatest(least(trunc(q * pow(14.245::DOUBLE / predicted, 1 / 1.35::DOUBLE))::INT, 100), 45) AS raw FROM f),
 d AS (SELECT *, CASE WHEN raw > q THEN least(raw, trunc(q * 1.2::DOUBLE)::INT, q + 12, 100) ELSE raw END AS cap FROM c)
 SELECT partkey, round({SUGGESTED_SQL}, 6) AS suggested, round({clamped_sql(capped_sql(SUGGESTED_SQL, 0.35), '0.3::DOUBLE', '1.2::DOUBLE')}, 6) AS safe,
 greatest(least(trunc(sqrt(14.245::DOUBLE / size) * 95 * 1.02::DOUBLE)::INT, 95), 45) AS seeded, round(least(3600.0::DOUBLE, greatest(600.0::DOUBLE, frames * 0.52::DOUBLE)), 6) AS timeout,
 CASE WHEN abs(cap - q) >= 3 THEN cap END AS corrected, round(size / 12 * frames * 1.02::DOUBLE, 6) AS extrapolated,
  round(least(14.245::DOUBLE, 14.99::DOUBLE, size * 0.97::DOUBLE), 6) AS probe_target,
 round(1.1::DOUBLE + sz * 0.05::DOUBLE / 256, 6) AS bias, round(size * (sz * 20 / 320.0::DOUBLE) * (24 / 12.0::DOUBLE) * 2.0::DOUBLE, 6) AS proxy, round(round_even(scale, 4), 6) AS scale_key,
 round({clamped_sql(capped_sql('(scale * sqrt(14.245::DOUBLE / predicted))', 0.45), '0.2::DOUBLE', '1.5::DOUBLE')}, 6) AS skip,
 round(CASE WHEN abs(0.2::DOUBLE + 14.245::DOUBLE * (1.2::DOUBLE - 0.2::DOUBLE) / 20.0::DOUBLE - scale) <= scale * 0.15::DOUBLE THEN 0.2::DOUBLE + 14.245::DOUBLE * (1.2::DOUBLE - 0.2::DOUBLE) / 20.0::DOUBLE END, 6) AS secant,
 (k % 2 <> 0 AND frames >= 120 AND greatest(least(k % 9, 6), 0) <> 4) AS explores FROM d""")
def scale_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales, qualities, timeouts and estimates of every file."""
    f, lit = files(spark, sf_dir), F.lit
    scale, size, q, frames, sz, predicted, k = (F.col(c) for c in ("scale", "size", "q", "frames", "sz", "predicted", "k"))
    six = lambda x, name: F.round(x, 6).alias(name)
    return f.select(
        "partkey",
        six(rules.suggested_scale(scale, rules.MID, size), "suggested"),
        six(rules.safe_scale(scale, rules.MID, size, 0.35, lit(0.3), lit(1.2)), "safe"),
        rules.seeded_quality(size, rules.MID, 45, 95).alias("seeded"),
        six(rules.frame_timeout(frames), "timeout"),
        rules.corrected_quality(q, predicted, lit(rules.MID)).alias("corrected"),
        six(rules.extrapolated_size(size, lit(12), frames), "extrapolated"),
        six(rules.probe_target(size), "probe_target"),
        six(rules.ratio_bias(sz), "bias"),
        six(rules.proxy_estimate(size, sz * 20, lit(320.0), lit(24), lit(12.0)), "proxy"),
        six(rules.scale_key(scale), "scale_key"),
        six(decisions.skip_scale(lit(0.2), lit(1.5)), "skip"),
        six(decisions.secant_scale(lit(0.2), lit(1.2), lit(0.0), lit(20.0), scale), "secant"),
        decisions.exploratory_fast(k % 2 == 0, frames, k % 9, lit(4)).alias("explores"),
    )


@query(f"""WITH f AS ({FILE_SQL}), n AS (SELECT *, CASE WHEN size > 14.99 THEN 0.01::DOUBLE ELSE scale END AS lo,
  CASE WHEN size > 14.99 THEN scale ELSE 4.0::DOUBLE END AS hi FROM f)
 SELECT partkey, round(lo, 6) AS low, round(hi, 6) AS high,
  round(CASE WHEN size < 13.5 OR size > 14.99::DOUBLE + 0.005::DOUBLE THEN {clamped_sql(capped_sql(SUGGESTED_SQL, 0.35), 'lo', 'hi')} END, 6) AS next
  FROM n""")
def iterate_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step that the search for a scale repeats, for every file."""
    low, high, then = search.scale_step(F.col("scale"), F.col("size"), F.lit(0.01), F.lit(4.0))
    return files(spark, sf_dir).select("partkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(then, 6).alias("next"))


@query(f"""WITH f AS ({FILE_SQL}) SELECT partkey, array_to_string(list_transform(range(0, 4), lambda i: floor(i * sz / 4.0)::INT), ',') AS starts,
 array_to_string(list_filter(range(0, sz), lambda x: x % greatest(1, sz // 5) = 0)[1:5], ',') AS every,
  CASE WHEN sz * 10 <= 12 THEN sz * 10 ELSE greatest(least(trunc(sqrt(sz * 10) * 1.25::DOUBLE)::INT, 36), 12) END AS samples,
 (sz::DOUBLE) / greatest(1, k % 4) AS fraction, lower(lpad(to_hex(k), 16, '0')) || '|' || lower(lpad(to_hex(k * 7919), 16, '0')) AS hex_key,
 round_even((bit_count(xor(k::BIGINT, k::BIGINT * 31)) + bit_count(xor(k::BIGINT, k::BIGINT * 17)) + bit_count(xor(k::BIGINT, 5::BIGINT))) / 3.0::DOUBLE, 0)::INT AS distance
  FROM f""")
def sampling_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to sample, fractions, and signatures of several parts, the shorter padded with its last."""
    sz, k = F.col("sz"), F.col("k").cast("bigint")
    text = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    values = F.sequence(F.lit(0), sz - 1)
    return files(spark, sf_dir).select(
        "partkey",
        text(rules.even_starts(sz, 4)).alias("starts"),
        text(rules.strided(values, 5)).alias("every"),
        rules.sample_size(sz * 10).alias("samples"),
        rules.fraction(F.concat(sz.cast("string"), F.lit("/"), (k % 4).cast("string"))).alias("fraction"),
        rules.hex_key(F.array(k, k * 7919)).alias("hex_key"),
        rules.hamming(F.array(k), F.array(k * 31, k * 17, F.lit(5).cast("bigint"))).alias("distance"),
    )


@query("""WITH n AS (SELECT p_partkey AS partkey, (p_partkey * 1003 + 7)::BIGINT AS n, p_retailprice / 19.0::DOUBLE AS s, p_name FROM part)
 SELECT partkey, CASE WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f KB', n / 1024.0::DOUBLE) END AS size_label,
 CASE WHEN s >= 60 THEN printf('%dm %ds', floor(s / 60)::BIGINT, floor(s % 60)::BIGINT) ELSE printf('%.1fs', s) END AS duration_label,
 CASE WHEN length(p_name) > 9 THEN '...' || right(p_name, 6) ELSE rpad(p_name, 9, ' ') END AS short_label FROM n""")
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as partkey", "bigint(p_partkey * 1003 + 7) as n", "p_retailprice / 19.0D as s", "p_name")
    return part.select("partkey", rules.size_label(F.col("n")).alias("size_label"), rules.duration_label(F.col("s")).alias("duration_label"), rules.short_label(F.col("p_name"), 9).alias("short_label"))


PATH_SQL = r"SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://[^/?#]*/?', ''), '[?#].*$', '') AS path FROM pages"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://[^/?#]*/?", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(rf"""SELECT page_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS suffix, regexp_replace(path, '\.[^./]+$', '') || '.gif' AS renamed,
 CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '.' END AS top,
  CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent FROM ({PATH_SQL})""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, sf_dir).select("page_id", rules.suffix(p).alias("suffix"), rules.with_suffix(p, ".gif").alias("renamed"), rules.top_folder(p).alias("top"), rules.parent_folder(p).alias("parent"))


@query(f"""SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '.' END AS folder, count(*) AS n FROM ({PATH_SQL}) WHERE path IS NOT NULL
 GROUP BY 1""")
def scope_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.scope_buckets(paths(spark, sf_dir).filter("path is not null"), "path", rules.top_folder(F.col("path")))


@query(f"""WITH n AS (SELECT keep, dup, row_number() OVER (ORDER BY keep, dup) AS i FROM ({KEEP}) WHERE rn > 1)
 SELECT i, 0 AS part, 'D' || i || '. KEEP ' || keep AS line FROM n UNION ALL SELECT i, 1, '     DEL  ' || dup FROM n""")
def dup_plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.plan_lines(deletions(spark, sf_dir), mark="D")


@query("""SELECT user_id, event_type, n AS count, round(CASE WHEN scale IS NULL AND n > 1 THEN mean ELSE scale END, 6) AS scale FROM (SELECT *,
  row_number() OVER w AS rn, count(*) OVER g AS n, avg(coalesce(scale, 0.75::DOUBLE)) OVER g AS mean
 FROM (SELECT user_id, event_type, ts, event_id, CASE WHEN event_id % 3 > 0 THEN value END AS scale FROM events)
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC), g AS (PARTITION BY user_id, event_type)) WHERE rn = 1""")
def history_compact_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("scale"))
    found = history.compact(rows, ["user_id", "event_type"], ["ts", "event_id"], scale="scale")
    return found.select("user_id", "event_type", "count", F.round("scale", 6).alias("scale"))


@query("SELECT event_id, ts AS start_time, value AS percent_complete FROM events WHERE event_type = 'purchase'")
def adm_operation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    operations = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("major_resource_id"), F.col("ts").alias("start_time"), F.col("value").alias("percent_complete"))
    return admin.operation_status(operations, "purchase").drop("major_resource_id")


@query("""SELECT count(*) FILTER (s = 'F') AS converted, count(*) FILTER (s = 'O') AS existing, count(*) FILTER (s = 'P') AS failed,
  count(*) FILTER (s <> 'P' AND k % 3 = 0) AS source_deleted,
 count(*) FILTER (s <> 'P' AND k % 3 = 1) AS source_delete_failed FROM (SELECT o_orderstatus AS s, o_orderkey AS k FROM orders)""")
def adm_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "converted").when(F.col("o_orderstatus") == "O", "exists").otherwise("failed")
    deleted = F.when(F.col("o_orderkey") % 3 < 2, F.col("o_orderkey") % 3 == 0)
    return admin.status_summary(table(spark, sf_dir, "orders").select(status.alias("status"), deleted.alias("deleted")))


@query("""SELECT lang, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 > 0 THEN lang END AS lang, CASE WHEN doc_id % 7 > 0 THEN n_chars END AS n_chars
 FROM documents) WHERE lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1""")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 7 > 0, F.col("n_chars")).alias("n_chars"))
    return admin.complete_rows(docs, ["lang", "n_chars"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT c_name AS object_name, 'ix' || o_orderkey AS index_name, p_name AS column_name, 'datetime' AS type_name FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN part ON p_partkey = l_partkey WHERE p_size % 5 = 1""")
def adm_datetime_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name as object_name")
    indexes = table(spark, sf_dir, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey as object_id", "1 as index_id", "object_name", "concat('ix', o_orderkey) as index_name")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as object_id", "1 as index_id", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name as column_name", "p_size % 5 as user_type_id")
    numbered = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    place = F.xxhash64("l_linenumber", "l_partkey")
    columns = numbered.select("object_id", place.alias("column_id"), "user_type_id", "column_name").distinct()
    types = table(spark, sf_dir, "region").selectExpr("r_regionkey as user_type_id", "if(r_regionkey = 1, 'datetime', 'int') as type_name")
    return admin.datetime_index_columns(indexes, numbered.select("object_id", "index_id", place.alias("column_id")), columns, types)


@query("""SELECT s_name AS disk, round(round_even(b / 1073741824.0::DOUBLE, 2) - round_even(a / 1073741824.0::DOUBLE, 2), 6) AS gained_gb
 FROM (SELECT s_name, (s_acctbal * 1000000)::BIGINT AS a, (s_acctbal * 1000000)::BIGINT + s_suppkey * 12345678 AS b FROM supplier)""")
def adm_free_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    disks = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("disk"), F.round(F.col("s_acctbal") * 1000000).cast("bigint").alias("free"), "s_suppkey")
    after = disks.select("disk", (F.col("free") + F.col("s_suppkey") * 12345678).alias("free"))
    return admin.free_space_gained(disks.drop("s_suppkey"), after).withColumn("gained_gb", F.round("gained_gb", 6))


@query("SELECT s_name AS disk, round(round_even((s_acctbal * 1000000)::BIGINT / 1073741824.0::DOUBLE, 2), 6) AS free_gb FROM supplier")
def adm_free_gb(spark: SparkSession, sf_dir: str) -> DataFrame:
    disks = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("disk"), F.round(F.col("s_acctbal") * 1000000).cast("bigint").alias("free"))
    return admin.free_space(disks).withColumn("free_gb", F.round("free_gb", 6))


@query("""SELECT event_id, ts, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 50
 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def history_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", (F.col("user_id") % 50).alias("kind"))
    return history.latest_in_order(rows, ["event_type", "kind"], ["ts", "event_id"]).drop("kind")


ERROR_SQL = f"""{BASE_SQL}, w AS (SELECT DISTINCT db FROM s WHERE db NOT LIKE '%7')
 SELECT w.db, 0 AS line_no, 'ERROR: No FULL backup found for database ' || {NAME_SQL.format('w')} || ' (latest FULL lookup returned none).' AS line
  FROM w WHERE db NOT IN (SELECT db FROM f WHERE db NOT LIKE '%3')
 UNION ALL SELECT w.db, 1, 'HINT: Available FULL backups for this database:' FROM w WHERE db NOT IN (SELECT db FROM f WHERE db NOT LIKE '%3')
 UNION ALL SELECT w.db, 0, 'ERROR: No media family files found for the chosen FULL backup (media_set_id=' || full_id || ').' FROM w
  JOIN b ON w.db = b.db WHERE w.db NOT LIKE '%3' AND full_id % 2 = 0"""


@query(ERROR_SQL)
def recovery_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys ending in 7 aren't asked for, those ending in 3 have no full backup, even sets no media."""
    sets = backup_sets(spark, sf_dir)
    base = recovery.recovery_base(sets.filter("not (kind = 'D' and db like '%3')"))
    clauses = base.filter("full_id % 2 = 1").selectExpr("db", "'D' as kind", "'x' as clause")
    return recovery.recovery_errors(sets.select("db").distinct().filter("db not like '%7'"), base, clauses)


@query(f"""WITH s AS (SELECT event_id AS set_id, 'db]' || user_id AS db, ts AS start, ts + INTERVAL 5 MINUTE AS finish, event_type FROM events),
  c AS (SELECT DISTINCT db, (SELECT date_trunc('day', max(ts)) - INTERVAL 10 DAY FROM events) AS completed FROM s),
 l AS (SELECT s.*, set_id % 3 > 0 AS found, strftime(start, '%Y-%m-%d %H:%M:%S') AS a, strftime(finish, '%Y-%m-%d %H:%M:%S') AS b FROM s
  JOIN c ON s.db = c.db WHERE event_type = 'click' AND finish > completed),
 r AS (SELECT db, 0 AS step, NULL::BIGINT AS set_id, list_filter(['/* RESTORE LOG CHAIN AFTER COMPLETION TIME */', '-- Database: ' || {NAME_SQL.format('c')}, '-- Completion time: ' || strftime(completed, '%Y-%m-%dT%H:%M:%S'),
   '-- LOG backups selected: ' || (SELECT count(*) FROM l WHERE l.db = c.db), '', CASE WHEN db NOT IN (SELECT db
  FROM l) THEN '-- WARNING: No LOG backups found after completion time.' END], lambda x: x IS NOT NULL) AS lines FROM c
  UNION ALL SELECT db, 1, set_id,
  CASE WHEN found THEN ['-- LOG backup set id: ' || set_id || ' (start=' || a || ', finish=' || b || ')', 'RESTORE LOG ' || {NAME_SQL.format('l')}, '    FROM DISK = N''/b/' || set_id || '_2.bak''', '    WITH NORECOVERY, REPLACE, STATS = 10;', '']
   ELSE ['-- WARNING: No media files found for LOG backup_set_id=' || set_id || '.'] END FROM l
  UNION ALL SELECT db, 2, NULL, ['-- After applying these logs, DB remains in RESTORING (NORECOVERY).'] FROM c)
 SELECT db, step, set_id, unnest(range(0, len(lines)))::INT AS line_no, unnest(lines) AS line FROM r""")
def recovery_logs_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = backup_sets(spark, sf_dir)
    files = sets.filter("set_id % 3 > 0").select("media_id", F.posexplode(F.array(*(F.concat(F.lit("/b/"), F.col("media_id").cast("string"), F.lit(f"_{n}.bak")) for n in (1, 2)))).alias("seq", "path"))
    done = sets.select("db").distinct().crossJoin(F.broadcast(sets.agg(F.expr("date_trunc('day', max(start)) - interval 10 days").alias("completed"))))
    return recovery.logs_after_script(recovery.logs_after(sets, files, done), done)


@query(f"""WITH n AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS i FROM (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x
  JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id))
 SELECT i || '. ' || a || '  <=>  ' || b AS line FROM n""")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of duplicate pairs, written as text and read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("digest", F.sha2("text", 256))
    sinks.write_report(dedup.numbered_pairs(dedup.adjacent_pairs(docs, "digest", "doc_id")), "i", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of history, appended to one store in two writes and read back: two kinds of events as deferred batches, all
    others as a section."""
    path = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_type", "value")
    sinks.append_batches([events.filter(F.col("event_type") == kind) for kind in ("click", "purchase")], path)
    history_json.write_section(events.filter("coalesce(event_type, '') not in ('click', 'purchase')"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT p_brand AS brand, count(*) AS n, 1::BIGINT AS version FROM part GROUP BY 1")
def exported_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section of the history exported as JSON and read back."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.export_history({"parts": table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"))}, path)
    return spark.read.schema("brand string, _schema_version bigint").json(f"{path}/parts").groupBy("brand").agg(F.count("*").alias("n"), F.max("_schema_version").alias("version"))
