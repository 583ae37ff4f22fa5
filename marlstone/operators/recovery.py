"""Recovery chains: the latest base of every key, the log events after it, and the script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import quoted, quotename
from ..sources.storage import stored

STAMP = "yyyy-MM-dd HH:mm:ss"


def recovery_base(sets: DataFrame, prefer_diff: bool = True) -> DataFrame:
    """(db, full_id, full_start, diff_id, diff_start, base_start) from (set_id, db, kind, start, finish): the full backup
    that finished last, the differential that finished last among those begun after it, and the later start."""
    rank = F.struct("finish", "set_id")
    full = sets.filter("kind = 'D'").groupBy("db").agg(F.max_by(F.struct("set_id", "start"), rank).alias("f"))
    full = full.select("db", F.col("f.set_id").alias("full_id"), F.col("f.start").alias("full_start"))
    later = sets.filter("kind = 'I'").join(full, "db").filter(F.lit(prefer_diff) & (F.col("start") > F.col("full_start")))
    diff = later.groupBy("db").agg(F.max_by(F.struct("set_id", "start"), rank).alias("d")).select("db", F.col("d.set_id").alias("diff_id"), F.col("d.start").alias("diff_start"))
    return full.join(diff, "db", "left").withColumn("base_start", F.coalesce("diff_start", "full_start"))


def log_chain(sets: DataFrame, base: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(db, set_id, start[, path]): log backups begun after the base; with media, one row for each file."""
    logs = sets.filter("kind = 'L'").join(base.select("db", "base_start"), "db").filter("start > base_start").select("db", "set_id", "start", *(["media_id"] if media is not None else []))
    return logs if media is None else logs.join(media, "media_id").select("db", "set_id", "start", "path")


def from_clause(media: DataFrame) -> DataFrame:
    """(media_id, clause): the ordered FROM DISK list of a media set, from (media_id, seq, path)."""
    quote = F.concat(F.lit("DISK = N'"), quoted(F.col("path")), F.lit("'"))
    parts = media.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", quote.alias("q")))).alias("p"))
    return parts.select("media_id", F.concat(F.lit("    FROM "), F.array_join(F.transform("p", lambda x: x["q"]), ",\n         "), F.lit("\n")).alias("clause"))


def recovery_script(base: DataFrame, logs: DataFrame, clauses: DataFrame) -> DataFrame:
    """(db, step, line_no, line): script rows of every key, ordered by step and line_no, rather than one text of
    unbounded length.  ``clauses``: (db, kind, clause); ``logs``: (db, set_id, start, path).  A key whose full backup has
    no clause has no script but an error, see :func:`recovery_errors`."""
    clauses, logs = stored(clauses, "clauses"), stored(logs, "logs")
    base = stored(base.join(clauses.filter("kind = 'D'").select("db"), "db", "left_semi"), "base")
    name = quotename(F.col("db"))
    at = lambda c: F.date_format(c, STAMP)
    head = base.select("db", F.lit(0).alias("step"), F.array(
        F.lit("/* RESTORE SCRIPT FOR SECONDARY REPLICA */"), F.concat(F.lit("-- Database: "), name), F.concat(F.lit("-- FULL start: "), at("full_start")),
        F.concat(F.lit("-- DIFF start: "), at("diff_start")), F.concat(F.lit("-- Base for LOG chain: "), at("base_start"))).alias("lines"))
    with_clause = base.join(clauses, "db")
    body = with_clause.filter("kind = 'D' or diff_id is not null").select("db", F.when(F.col("kind") == "D", 1).otherwise(2).alias("step"), F.array(
        F.when(F.col("kind") == "D", "-- 1) RESTORE FULL").otherwise("-- 2) RESTORE DIFFERENTIAL"), F.concat(F.lit("RESTORE DATABASE "), name), F.col("clause"),
        F.when(F.col("kind") == "D", "    WITH NORECOVERY, REPLACE, STATS = 10;").otherwise("    WITH NORECOVERY, STATS = 10;")).alias("lines"))
    chain = base.select("db", F.lit(3).alias("step"), F.array(F.concat(F.lit("-- "), F.when(F.col("diff_id").isNotNull(), "3").otherwise("2"), F.lit(") RESTORE LOG CHAIN (chronological order)"))).alias("lines"))
    fixed = head.unionByName(body).unionByName(chain).select("db", "step", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("bigint").alias("set_id"), F.posexplode(F.array_compact("lines")).alias("line_no", "line"))
    log = logs.join(base.select("db"), "db").select("db", F.lit(4).alias("step"), F.col("start").cast("timestamp").alias("at"), F.col("set_id").cast("bigint").alias("set_id"), F.posexplode(F.array(
        F.concat(F.lit("RESTORE LOG "), name), F.concat(F.lit("    FROM DISK = N'"), quoted(F.col("path")), F.lit("'")), F.lit("    WITH NORECOVERY, REPLACE, STATS = 10;"))).alias("line_no", "line"))
    warn = base.join(logs.select("db").distinct(), "db", "left_anti").select("db", F.lit(5).alias("step"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("bigint").alias("set_id"), F.lit(0).alias("line_no"), F.lit("-- WARNING: No LOG backups found after base.").alias("line"))
    return fixed.unionByName(log).unionByName(warn)


def recovery_errors(databases: DataFrame, base: DataFrame, clauses: DataFrame) -> DataFrame:
    """(db, line_no, line): why a key among ``databases`` (db) has no script: no full backup, or one without media."""
    none = databases.join(base.select("db"), "db", "left_anti").select("db", F.posexplode(F.array(
        F.concat(F.lit("ERROR: No FULL backup found for database "), quotename(F.col("db")), F.lit(" (latest FULL lookup returned none).")),
        F.lit("HINT: Available FULL backups for this database:"))).alias("line_no", "line"))
    lost = base.join(databases, "db", "left_semi").join(clauses.filter("kind = 'D'").select("db"), "db", "left_anti")
    text = F.concat(F.lit("ERROR: No media family files found for the chosen FULL backup (media_set_id="), F.col("full_id").cast("string"), F.lit(")."))
    return none.unionByName(lost.select("db", F.lit(0).alias("line_no"), text.alias("line")))


def logs_after_script(logs: DataFrame, completion: DataFrame) -> DataFrame:
    """(db, step, set_id, line_no, line): script rows of every key of ``completion`` (db, completed) with the logs of
    :func:`logs_after`, ordered by step, the log's start, finish and set_id, and line_no."""
    logs = stored(logs, "logs")
    name = quotename(F.col("db"))
    none = F.lit(None)
    counts = completion.join(logs.groupBy("db").agg(F.count("*").alias("n")), "db", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = counts.select("db", F.lit(0).alias("step"), none.cast("bigint").alias("set_id"), F.posexplode(F.array_compact(F.array(
        F.lit("/* RESTORE LOG CHAIN AFTER COMPLETION TIME */"), F.concat(F.lit("-- Database: "), name),
        F.concat(F.lit("-- Completion time: "), F.date_format("completed", "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("-- LOG backups selected: "), F.col("n").cast("string")), F.lit(""),
        F.when(F.col("n") == 0, "-- WARNING: No LOG backups found after completion time.")))).alias("line_no", "line"))
    span = F.concat(F.lit(" (start="), F.date_format("start", STAMP), F.lit(", finish="), F.date_format("finish", STAMP), F.lit(")"))
    found = F.array(
        F.concat(F.lit("-- LOG backup set id: "), F.col("set_id").cast("string"), span), F.concat(F.lit("RESTORE LOG "), name),
        F.concat(F.lit("    FROM DISK = N'"), quoted(F.col("path")), F.lit("'")), F.lit("    WITH NORECOVERY, REPLACE, STATS = 10;"), F.lit(""))
    lost = F.array(F.concat(F.lit("-- WARNING: No media files found for LOG backup_set_id="), F.col("set_id").cast("string"), F.lit(".")))
    body = logs.select("db", F.lit(1).alias("step"), F.col("set_id").cast("bigint").alias("set_id"), F.posexplode(F.when(F.col("path").isNotNull(), found).otherwise(lost)).alias("line_no", "line"))
    foot = F.lit("-- After applying these logs, DB remains in RESTORING (NORECOVERY).").alias("line")
    return head.unionByName(body).unionByName(completion.select("db", F.lit(2).alias("step"), none.cast("bigint").alias("set_id"), F.lit(0).alias("line_no"), foot))


def logs_after(sets: DataFrame, media: DataFrame, completion: DataFrame) -> DataFrame:
    """(db, set_id, start, finish, path): logs that finish after a key's completion time, with the last file of each;
    a null path means no file was found."""
    last = media.groupBy("media_id").agg(F.max_by("path", "seq").alias("path"))
    logs = sets.filter("kind = 'L'").join(completion, "db").filter("finish > completed")
    return logs.join(last, "media_id", "left").select("db", "set_id", "start", "finish", "path")


def script_lines(texts: DataFrame, key: str, text: str, width: int = 4000) -> DataFrame:
    """(key, line_no, part, line): texts without carriage returns, cut at line feeds and then every ``width`` characters.

    A length doesn't count the blanks at the end.  So printing stops where only blanks are left; a line is cut only while more
    than blanks lies beyond ``width``, and what is printed last of it ends there; and what is left after a line keeps no more
    of the text's last blanks than that line and its line feed have characters."""
    ls, size = F.col("ls"), F.size("ls")
    rows = texts.select(key, F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n").alias("ls"))
    rows = rows.select(key, F.slice(ls, F.lit(1), size - 1).alias("before"), F.element_at(ls, -1).alias("last"))
    rows = rows.withColumn("least", F.array_min(F.transform("before", lambda x: F.length(x) + 1)))
    bare = F.rtrim("last")
    last = F.when(F.col("least").isNull(), F.col("last")).otherwise(F.col("last").substr(F.lit(1), F.length(bare) + F.col("least")))
    rows = rows.select(key, F.when(bare == "", F.col("before")).otherwise(F.concat("before", F.array(last))).alias("ls"))
    lines = rows.select(key, F.posexplode("ls").alias("line_no", "full"))
    pieces = F.greatest(F.lit(0), F.floor((F.length(F.rtrim("full")) - 1) / width).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), pieces), lambda i: F.substring(F.col("full"), i * width + 1, F.lit(width)))
    return lines.select(key, "line_no", F.posexplode(cut).alias("part", "line"))
