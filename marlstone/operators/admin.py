"""Catalog reports over tables named as in the administrative views.  Each takes the tables it reads as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import statement_slice


def queue_sizes(replica_states: DataFrame, replicas: DataFrame, databases: DataFrame) -> DataFrame:
    """Log send and redo queues in whole MB.  The database list joins on the group alone, so a replica's row comes once
    for each database of its group."""
    rows = replica_states.filter("is_local = 1").join(replicas, ["replica_id"]).join(databases, "group_id")
    return rows.selectExpr("database_name", "replica_server_name", "log_send_queue_size div 1024 as log_send_queue_mb", "redo_queue_size div 1024 as redo_queue_mb")


def sync_states(replica_states: DataFrame, replicas: DataFrame, groups: DataFrame, names: DataFrame) -> DataFrame:
    rows = replica_states.join(replicas, "replica_id").join(groups, "group_id").join(names, "database_id", "left")
    return rows.select("group_name", "replica_server_name", F.col("name").alias("database_name"), "synchronization_state_desc", "synchronization_health_desc").orderBy("group_name", "replica_server_name", "database_name")


def sessions(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "login_name", "login_time").orderBy(F.col("login_time").desc(), "session_id")


def backup_progress(requests: DataFrame, texts: DataFrame, patterns: tuple[str, ...] = ("backup%", "restore%")) -> DataFrame:
    rows = requests.filter(reduce(Column.__or__, (F.col("command").ilike(p) for p in patterns))).join(texts, "sql_handle")
    return rows.selectExpr("session_id", "command", "text", "percent_complete", "estimated_completion_time div 1000 as left_s", "total_elapsed_time div 1000 as elapsed_s")


def last_modified(per_database: dict[str, DataFrame], column: str = "modify_date") -> DataFrame:
    """Each database's last change, all databases in one plan."""
    parts = [df.agg(F.max(column).alias("last_modified")).select(F.lit(name).alias("database_name"), "last_modified") for name, df in per_database.items()]
    return reduce(DataFrame.unionByName, parts)


def database_files(files: DataFrame, databases: DataFrame, filegroups: DataFrame) -> DataFrame:
    rows = files.join(databases.select("database_id", F.col("name").alias("database_name")), "database_id", "left").join(filegroups.select("data_space_id", F.col("name").alias("filegroup")), "data_space_id", "left")
    kind = F.when(F.col("type_desc") == "LOG", "log").otherwise("data")
    return rows.filter(~F.col("database_name").isin("master", "model", "msdb", "tempdb")).select("database_name", kind.alias("kind"), "filegroup", "physical_name", "size")


def database_sizes(files: DataFrame, databases: DataFrame) -> DataFrame:
    """Whole MB of 8 KB pages, cut to MB file by file before they are added."""
    rows = databases.filter("database_id > 4").join(files, "database_id")
    mb = F.expr("size * 8 div 1024")
    return rows.groupBy("name").agg(F.sum(F.when(F.col("type_desc") == "ROWS", mb).otherwise(0)).alias("data_mb"), F.sum(F.when(F.col("type_desc") == "LOG", mb).otherwise(0)).alias("log_mb"))


def job_search(
    jobs: DataFrame, steps: DataFrame, servers: DataFrame, pattern: str, schedules: DataFrame | None = None, links: DataFrame | None = None,
) -> DataFrame:
    rows = jobs.join(steps, "job_id").join(servers, F.col("originating_server_id") == F.col("srvid")).filter(F.col("command").ilike(pattern))
    cols = ["job_id", "name", "enabled", "srvname", "step_id", "step_name", "command"]
    if schedules is None or links is None:
        return rows.select(cols)
    named = links.join(schedules.select("schedule_id", F.col("name").alias("schedule_name"), F.col("enabled").alias("schedule_enabled")), "schedule_id", "left")
    return rows.join(named, "job_id", "left").select(*cols, "schedule_name", "schedule_enabled")


def partition_counts(
    tables: DataFrame, partitions: DataFrame, indexes: DataFrame, schemes: DataFrame, functions: DataFrame, bounds: DataFrame,
    all_partitions: bool = False,
) -> DataFrame:
    """Rows of each partition with its boundary.  The last partition has none and is left out, unless ``all_partitions``."""
    rows = tables.join(partitions, "object_id").join(indexes, ["object_id", "index_id"]).filter("index_id <= 1").join(schemes, "data_space_id").join(functions, "function_id")
    rows = rows.join(bounds.withColumnRenamed("boundary_id", "partition_number"), ["function_id", "partition_number"], "left" if all_partitions else "inner")
    return rows.select("table_name", "partition_number", "value", "rows")


def chosen_partitions(counts: DataFrame, heads: list[str], spans: dict[str, tuple[int, int]], most: int = 5) -> DataFrame:
    """Of :func:`partition_counts`: the first ``most`` partitions of the tables ``heads``, and those between two numbers of the
    tables ``spans``."""
    number = F.col("partition_number")
    tests = [(F.col("table_name") == t) & (number <= most) for t in heads] + [(F.col("table_name") == t) & number.between(*ends) for t, ends in spans.items()]
    return counts.filter(reduce(Column.__or__, tests)).orderBy("table_name", "partition_number", "rows")


def connection_counts(processes: DataFrame, databases: DataFrame) -> DataFrame:
    rows = processes.filter("spid > 50").join(databases.select(F.col("database_id").alias("dbid"), "name"), "dbid")
    return rows.groupBy("name", "loginame", "hostname", "program_name").agg(F.count("dbid").alias("connections")).orderBy(F.col("connections").desc(), "name", "loginame", "hostname", "program_name")


def fill_factors(indexes: DataFrame, objects: DataFrame, schemas: DataFrame) -> DataFrame:
    rows = indexes.join(objects, "object_id").join(schemas, "schema_id").filter("index_name is not null")
    return rows.select("schema_name", "object_name", "index_name", "fill_factor").orderBy(F.col("fill_factor").desc(), "schema_name", "object_name", "index_name")


def datetime_index_columns(
    indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, types: DataFrame, kinds: tuple[str, ...] = ("datetime",),
) -> DataFrame:
    rows = indexes.join(index_columns, ["object_id", "index_id"]).join(columns, ["object_id", "column_id"]).join(types, "user_type_id")
    return rows.filter(F.col("type_name").isin(*kinds)).select("object_name", "index_name", "column_name", "type_name")


def cached_statements(stats: DataFrame, texts: DataFrame) -> DataFrame:
    rows = stats.join(texts, "sql_handle")
    return rows.select("plan_handle", "creation_time", statement_slice(F.col("text"), F.col("statement_start_offset"), F.col("statement_end_offset")).alias("statement"))


def applied_statements(stats: DataFrame, texts: DataFrame, plans: DataFrame) -> DataFrame:
    """Each statistics row (plan_handle, sql_handle, statement_start_offset, statement_end_offset) with what is applied to it:
    the text of its handle, the latest plan of its handle, and the table function that gives the words of its statement.
    Applied rows depend on the row at hand; rows that get none are left out."""
    text = texts.where(F.col("texts_handle") == F.col("sql_handle").outer()).select("text")
    plan = plans.where(F.col("plans_handle") == F.col("plan_handle").outer()).orderBy(F.col("created").desc(), "query_plan").limit(1).select("query_plan")
    rows = stats.lateralJoin(text).lateralJoin(plan)
    rows = rows.withColumn("statement", statement_slice(F.col("text"), F.col("statement_start_offset"), F.col("statement_end_offset")))
    said = F.split(F.trim(F.regexp_replace(F.col("statement"), r"\s+", " ")), " ")
    word = stats.sparkSession.tvf.posexplode(said.outer())
    return rows.lateralJoin(word).select("plan_handle", "sql_handle", "query_plan", "statement", F.col("pos").alias("place"), F.col("col").alias("word"))


def stale_statistics(stats: DataFrame, cutoff: Column, least_percent: float = 4.0) -> DataFrame:
    """Statistics not updated since ``cutoff`` with more than ``least_percent`` changes: equal (name, total) rows of
    different schemas and statistics collapse."""
    changed = F.try_divide(F.col("modification_counter") * F.lit(1.0), F.nullif(F.col("rows"), F.lit(0))) * 100
    rows = stats.filter((F.col("last_updated") < cutoff) & (changed > least_percent))
    return rows.groupBy("name", "schema_id", "stats_name").agg(F.sum("modification_counter").alias("changes")).select("name", "changes").distinct()


def set_enabled(jobs: DataFrame, pattern: str, enabled: int) -> DataFrame:
    return jobs.withColumn("enabled", F.when(F.col("name").ilike(pattern), F.lit(enabled)).otherwise(F.col("enabled")))


def job_commands(jobs: DataFrame, enabled: int) -> DataFrame:
    """A command for each job.  The name's quotes are not doubled."""
    return jobs.select(F.concat(F.lit("EXEC msdb.dbo.sp_update_job @job_name = N'"), F.col("name"), F.lit(f"', @enabled = {enabled};")).alias("command"))


def listeners(processes: DataFrame, connections: DataFrame, name: str | Column) -> DataFrame:
    """Connections of the processes of a name, with the process's columns."""
    own = processes.filter(F.col("Name") == name).select(F.col("ProcessId").alias("OwningProcess"), "Name", "CommandLine")
    return connections.join(own, "OwningProcess")


def free_space(disks: DataFrame) -> DataFrame:
    """(disk, free_gb) from (disk, free) in bytes, to two places."""
    return disks.select("disk", F.bround(F.col("free") / (1024**3), 2).alias("free_gb"))


def free_space_gained(before: DataFrame, after: DataFrame) -> DataFrame:
    """The difference of the rounded sizes, as they are shown."""
    gained = free_space(before).withColumnRenamed("free_gb", "b").join(free_space(after).withColumnRenamed("free_gb", "a"), "disk")
    return gained.select("disk", (F.col("a") - F.col("b")).alias("gained_gb"))


def operation_status(operations: DataFrame, resource: str = "distribution") -> DataFrame:
    """A resource's operations, the latest first."""
    return operations.filter(F.col("major_resource_id") == resource).orderBy(F.col("start_time").desc())


def status_summary(results: DataFrame) -> DataFrame:
    """One row of counts: results by status (any other status is a failure), and sources deleted or not after those that
    succeeded.  ``deleted`` null: not tried."""
    done = F.col("status").isin("converted", "exists")
    return results.agg(
        F.count_if(F.col("status") == "converted").alias("converted"), F.count_if(F.col("status") == "exists").alias("existing"), F.count_if(~F.coalesce(done, F.lit(False))).alias("failed"),
        F.count_if(done & F.col("deleted")).alias("source_deleted"), F.count_if(done & ~F.col("deleted")).alias("source_delete_failed"),
    )


def complete_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in ``columns``."""
    return rows.dropna(subset=columns)


def scope_buckets(files: DataFrame, path: str, scope: Column) -> DataFrame:
    """(folder, n), the folders in case-insensitive order."""
    return files.groupBy(scope.alias("folder")).agg(F.count(path).alias("n")).orderBy(F.lower("folder"), "folder")
