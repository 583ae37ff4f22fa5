"""Where an encode starts: plans from history, with their SQL.  Parts are the files to come, order lines what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import history, predict
from ..sources.storage import table
from .registry import query

#: A part as a file, and its lines as encodes of it, a little wider or longer with each; the latest of one profile counts.
FILE_COLUMNS = ["p_partkey AS id", "p_size * 40 AS width", "p_size * 25 + p_partkey % 3 AS height", "p_size * 12 AS frames", "p_retailprice / 60.0{d} AS init_mb"]
RUN_COLUMNS = [
    "p_size * 40 + l_linenumber % 2 AS width", "p_size * 25 + p_partkey % 3 AS height", "p_size * 12 + l_linenumber % 3 AS frames", "p_retailprice / 60.0{d} AS init_mb", "l_linenumber % 4 AS method",
    "40 + CAST(l_quantity AS int) AS quality", "13.0{d} + l_discount * 24.0{d} AS result_mb", "l_orderkey * 10 + l_linenumber AS timestamp", "l_orderkey % 3 AS resize_count",
    "p_size * 38 + l_linenumber AS final_width", "p_size * 20 AS final_height",
]
PROFILE = ["width", "height", "frames", "init_mb", "method"]
OFF = "abs(h.{0} - p.{0}) / greatest(p.{0}, 1)::DOUBLE"
PLAN_SQL = f"""WITH f AS (SELECT {', '.join(x.format(d='::DOUBLE') for x in FILE_COLUMNS)} FROM part),
 r AS (SELECT {', '.join(x.format(d='::DOUBLE') for x in RUN_COLUMNS)} FROM lineitem JOIN part ON p_partkey = l_partkey),
 h AS (SELECT *, count(*) OVER (PARTITION BY {', '.join(PROFILE)}) AS n, row_number() OVER (PARTITION BY {', '.join(PROFILE)} ORDER BY timestamp DESC) AS rn FROM r),
 k AS (SELECT p.id, h.quality, h.method, h.result_mb, h.n, h.width = p.width AND h.height = p.height AND h.frames = p.frames AS strong,
   {' AND '.join(OFF.format(x) + ' < 1e-6' for x in PROFILE[:3])} AND abs(h.init_mb - p.init_mb) < 1e-6 AS exact,
   h.resize_count > 0 AND h.final_width <= p.width AND h.final_height <= p.height AND h.final_width > 0 AND h.final_height > 0 AS pre, h.resize_count, h.final_width, h.final_height,
   row_number() OVER (PARTITION BY p.id ORDER BY NOT (h.width = p.width AND h.height = p.height AND h.frames = p.frames),
    NOT ({' AND '.join(OFF.format(x) + ' < 1e-6' for x in PROFILE[:3])} AND abs(h.init_mb - p.init_mb) < 1e-6), abs(h.init_mb - p.init_mb), abs(h.result_mb - 14.245::DOUBLE), h.timestamp DESC, h.quality, h.method) AS place
  FROM f p JOIN h ON h.rn = 1 AND {' AND '.join(OFF.format(x) + ' <= 0.03::DOUBLE' for x in PROFILE[:3])} AND abs(h.init_mb - p.init_mb) <= 0.35::DOUBLE
   AND (h.n >= 2 OR h.width = p.width AND h.height = p.height AND h.frames = p.frames) AND h.result_mb BETWEEN 13.5::DOUBLE - 0.3::DOUBLE AND 14.99::DOUBLE + 0.3::DOUBLE),
 s AS (SELECT f.id, k.* EXCLUDE (id), greatest(least(trunc(sqrt(14.245::DOUBLE / init_mb) * 95 * 1.02::DOUBLE)::INT, 95), 60) AS seeded, (SELECT count(*) FROM h WHERE rn = 1) AS records
  FROM f LEFT JOIN k ON k.id = f.id AND place = 1)
 SELECT id, coalesce(quality, seeded) AS quality, method, coalesce(strong AND (resize_count = 0 OR pre), false) AS direct_final, round(result_mb, 6) AS result_mb,
  CASE WHEN pre THEN final_width END AS pre_width, CASE WHEN pre THEN final_height END AS pre_height,
  CASE WHEN strong IS NULL THEN 'default (no webp match, records=' || records || ', ratio-seeded q=' || seeded || ')'
   ELSE CASE WHEN exact THEN 'webp exact stats' ELSE 'webp stats' END || ' (' || CASE WHEN strong THEN 'direct-final' ELSE 'probe-guided' END || ', records=' || records || ', count=' || n || ')'
  END AS source FROM s"""


@query(PLAN_SQL)
def startup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files and observed encodes to each file's plan, with the label of its source."""
    part = table(spark, sf_dir, "part")
    runs = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*(x.format(d="D") for x in RUN_COLUMNS))
    known = history.compact(runs, PROFILE, ["timestamp"])
    plan = predict.startup_plan(part.selectExpr(*(x.format(d="D") for x in FILE_COLUMNS)), known)
    return plan.withColumn("result_mb", F.round("result_mb", 6))


FEATURES = ["width", "height", "fps", "duration", "size"]
SOURCE_COLUMNS = ["p_partkey AS id", "p_partkey % 3 AS profile", "p_size * 40 AS width", "p_size % 9 * 120 + 240 AS height"]
#: Rates, durations and sizes go in buckets of 1, 5 and 2.
MEASURED = {"fps": ("p_partkey % 45 + 0.3", 1), "duration": ("p_partkey % 120 * 1.1", 5), "size": ("p_retailprice / 40.0", 2)}
ENTRY_COLUMNS = [
    "l_orderkey * 10 + l_linenumber AS entry", "l_orderkey % 3 AS profile", "CAST(l_quantity AS int) * 40 AS width", "l_linenumber * 150 + 200 AS height",
    "CASE WHEN l_orderkey % 11 > 0 THEN CAST(l_orderkey % 50 AS double) END AS fps", "CAST(l_partkey % 24 * 5 AS double) AS duration", "CAST(l_suppkey % 30 * 2 AS double) AS size", "50 + l_linenumber AS quality",
]
SCORE_SQL = " + ".join(f"abs(h.{f}::DOUBLE - p.{f}::DOUBLE) / greatest(p.{f}::DOUBLE, 1.0::DOUBLE)" for f in FEATURES)


@query(f"""WITH p AS (SELECT {', '.join(SOURCE_COLUMNS)}, {', '.join(f'round_even(({x})::DOUBLE / {s}, 0) * {s} AS {f}' for f, (x, s) in MEASURED.items())} FROM part),
 h AS (SELECT {', '.join(ENTRY_COLUMNS)} FROM lineitem),
 d AS (SELECT profile, {', '.join(FEATURES)}, min(entry) AS entry, arg_min(quality, entry) AS quality FROM h WHERE fps IS NOT NULL GROUP BY ALL),
 s AS (SELECT p.id, h.entry, h.quality, {SCORE_SQL} AS score FROM p JOIN d h ON h.profile = p.profile),
 b AS (SELECT id, min({{'s': score, 'e': entry, 'q': quality}}) AS x FROM s GROUP BY 1)
 SELECT id, x.e AS entry, x.q AS quality, round(x.s, 6) AS score, x.s <= 0.001 AS exact FROM b""")
def nearest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's nearest observation of its profile by five features, the first of equal ones, and whether it is exact."""
    measured = [rules.bucketize(F.expr(x).cast("double"), s).alias(f) for f, (x, s) in MEASURED.items()]
    probes = table(spark, sf_dir, "part").select(*map(F.expr, SOURCE_COLUMNS), *measured)
    entries = table(spark, sf_dir, "lineitem").selectExpr(*ENTRY_COLUMNS)
    best = predict.nearest_by_score(probes, entries, "profile", FEATURES, "entry", ["entry", "quality"])
    return best.select("id", "entry", "quality", F.round("score", 6).alias("score"), (F.col("score") <= 0.001).alias("exact"))
