"""The registered queries over the fixture tables, each with its SQL for the oracle.

The operators' own tables are not among the fixtures, so each runs on an analogue: documents for files, their text for
content, events for observations and backups, parts and orders for history, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import decisions, dedup, history, predict, recovery, search, signatures
from ..sources import media
from ..sources.storage import table
from .registry import query

# Duplicates


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").withColumn("digest", F.sha2("text", 256))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_groups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(digests(spark, sf_dir), "digest", "doc_id")


@query("SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.adjacent_pairs(digests(spark, sf_dir), "digest", "doc_id")


KEEP = """SELECT first_value(doc_id) OVER w AS keep, doc_id AS dup, row_number() OVER w AS rn FROM documents WHERE text IS NOT NULL
 WINDOW w AS (PARTITION BY text ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n_chars DESC, doc_id)"""


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.when(F.col("lang") == "en", 0).otherwise(1).alias("kind"), (-F.col("n_chars")).alias("size")]
    return dedup.keep_delete(digests(spark, sf_dir), "digest", "doc_id", order)


@query(f"SELECT keep, dup FROM ({KEEP}) WHERE rn > 1")
def dup_keep_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletions(spark, sf_dir)


@query("SELECT source, sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def dup_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(digests(spark, sf_dir), "digest", "doc_id", ["source"])


@query(f"SELECT count(*) AS n_deleted, coalesce(sum(d.n_chars), 0)::BIGINT AS freed FROM ({KEEP}) k JOIN documents d ON d.doc_id = k.dup WHERE rn > 1")
def dup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.plan_totals(deletions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "n_chars")


@query("""SELECT i, i || '. ' || a || '  <=>  ' || b AS line FROM (SELECT a.doc_id AS a, b.doc_id AS b, row_number() OVER (ORDER BY a.doc_id, b.doc_id) AS i
 FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id)""")
def dup_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.numbered_pairs(dup_pairs(spark, sf_dir))


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS n_missing, count(*) FILTER (l.doc_id IS NOT NULL) AS n_live FROM documents d LEFT
 JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def dup_live_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, missing = dedup.live_rows(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return missing.crossJoin(live.agg(F.count("*").alias("n_live"))).select("n_missing", "n_live")


BITS = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')"


@query(f"SELECT {BITS} AS bits, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1")
def sig_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = table(spark, sf_dir, "embeddings").select("vec_id", rules.sign_bits(F.col("embedding")).alias("sig"))
    groups = sigs.groupBy("sig").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    return groups.select(F.lpad(F.bin("sig"), 64, "0").alias("bits"), "n", "first_id")


#: Bits that near signatures may differ in, and words of a part of a document that has a signature of its own.
NEAR_BITS, PART_WORDS = 6, 100
WORDS = r"[^\x20\x09-\x0D]+"


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("i", "word"))


def document_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with words and the signature of these."""
    return signatures.word_signatures(document_words(spark, sf_dir), ["doc_id"])


def part_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the signatures of its parts, in order, as an image's frames have them."""
    words = document_words(spark, sf_dir).withColumn("part", F.floor(F.col("i") / PART_WORDS))
    parts = signatures.word_signatures(words, ["doc_id", "part"])
    sigs = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "sig"))).alias("parts"))
    return sigs.select("doc_id", F.transform("parts", lambda x: x["sig"]).alias("sigs"))


SIGNED = "bit_or(CASE WHEN 2 * ones > n THEN 1::UBIGINT << i ELSE 0::UBIGINT END)"


def signature_sql(keys: str) -> str:
    """(keys, sig): the words' bits are counted one place at a time."""
    return f"""SELECT {keys}, {SIGNED} AS sig FROM (SELECT {keys}, i, count(*) AS n, sum((h >> i) & 1) AS ones
  FROM (SELECT {keys}, ('0x' || left(md5(word), 16))::UBIGINT AS h, unnest(range(0, 64))::UBIGINT AS i FROM w) GROUP BY ALL) GROUP BY ALL"""


WORD_SQL = f"""w AS (SELECT doc_id, unnest(ws) AS word, (unnest(range(0, len(ws))) // {PART_WORDS})::INT AS part
  FROM (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS ws FROM documents WHERE text IS NOT NULL))"""
CLASS_SQL = f"{WORD_SQL}, s AS ({signature_sql('doc_id')}), c AS (SELECT sig, min(doc_id) AS id, count(*) AS n FROM s GROUP BY 1)"


@query(f"""WITH {CLASS_SQL} SELECT a.id AS a, b.id AS b, bit_count(xor(a.sig, b.sig))::INT AS distance FROM c a
 JOIN c b ON a.id < b.id WHERE bit_count(xor(a.sig, b.sig)) <= {NEAR_BITS}""")
def sig_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near signatures, each by the least document that has it; :func:`sig_members` lists who else has."""
    return signatures.near_classes(signatures.classes_of(document_signatures(spark, sf_dir), "doc_id", "sig"), NEAR_BITS)


@query(f"WITH {CLASS_SQL} SELECT doc_id, id AS class_id FROM s JOIN c ON s.sig = c.sig")
def sig_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.members(document_signatures(spark, sf_dir), "doc_id", "sig")


@query(f"""WITH {WORD_SQL}, p AS ({signature_sql('doc_id, part')}), s AS (SELECT doc_id, list(sig ORDER BY part) AS sigs FROM p GROUP BY 1),
 c AS (SELECT sigs, len(sigs) AS k, min(doc_id) AS id FROM s GROUP BY 1),
 d AS (SELECT a.id AS a, b.id AS b, round_even(list_sum(list_transform(range(1, greatest(a.k, b.k) + 1),
  lambda i: bit_count(xor(a.sigs[least(i, a.k)], b.sigs[least(i, b.k)]))::INT)) / greatest(a.k, b.k)::DOUBLE, 0)::INT AS distance FROM c a JOIN c b ON a.id < b.id)
 SELECT a, b, distance FROM d WHERE distance <= {NEAR_BITS}""")
def sig_array_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose parts are near, place by place, the shorter document padded with its last part."""
    return signatures.near_arrays(signatures.classes_of(part_signatures(spark, sf_dir), "doc_id", "sigs"), NEAR_BITS)


#: The items in order, each with the earlier ones near it; a step of the recursion adds an item to the leaders or not.
LEADERS_SQL = f"""WITH RECURSIVE {WORD_SQL}, s AS (SELECT doc_id, sig, row_number() OVER (ORDER BY doc_id) AS rn FROM ({signature_sql('doc_id')})),
 near AS (SELECT b.rn AS rn, list(a.doc_id) AS ids FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.sig, b.sig)) <= {NEAR_BITS} GROUP BY 1),
 st AS (SELECT s.rn, s.doc_id, coalesce(near.ids, []::BIGINT[]) AS ids FROM s LEFT JOIN near ON near.rn = s.rn),
 r AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS leaders
  UNION ALL SELECT r.rn + 1, CASE WHEN list_has_any(r.leaders, st.ids) THEN r.leaders ELSE list_append(r.leaders, st.doc_id) END FROM r
  JOIN st ON st.rn = r.rn + 1),
 l AS (SELECT leaders FROM r ORDER BY rn DESC LIMIT 1)
 SELECT list_min(list_intersect(l.leaders, st.ids)) AS leader, st.doc_id AS member FROM st, l WHERE list_has_any(l.leaders, st.ids)"""


@query(LEADERS_SQL)
def sig_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signature_clusters(document_signatures(spark, sf_dir), "doc_id", "sig", NEAR_BITS)


#: Rows y, columns x and frequencies u, w of the transform; the median is the mean of the two middle values.
COSINE_SQL = "list_sum(list_transform(range(0, 64), lambda k: m[k + 1]::DOUBLE * 4 * cos(pi() * (2 * (k // 8) + 1) * {u} / 16) * cos(pi() * (2 * (k % 8) + 1) * {w} / 16)))"


@query(f"""WITH f AS (SELECT vec_id, [{', '.join(COSINE_SQL.format(u=k // 4, w=k % 4) for k in range(16))}] AS f FROM (SELECT vec_id, embedding AS m FROM embeddings)),
 o AS (SELECT vec_id, f, list_sort(f) AS s FROM f)
 SELECT array_to_string(list_transform(f, lambda v: CASE WHEN v > (s[8] + s[9]) / 2 THEN '1' ELSE '0' END), '') AS sig, count(*) AS n, min(vec_id) AS first_id FROM o GROUP BY 1""")
def sig_matrix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 matrices, grouped by the bits of their low frequencies."""
    sigs = table(spark, sf_dir, "embeddings").select("vec_id", signatures.matrix_signature(F.col("embedding")).alias("sig"))
    return sigs.groupBy("sig").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


# History


@query("""SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(table(spark, sf_dir, "events").drop("props"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT event_id, ts, user_id, event_type, value, n AS count FROM (SELECT *, row_number() OVER w AS rn,
 count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC))
 WHERE rn = 1""")
def history_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.compact(table(spark, sf_dir, "events").drop("props"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT event_type, round(sum(value * w) / sum(w), 6) AS decayed_mean
 FROM (SELECT event_type, value, pow(2.0, -date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 1e6 / 86400.0) AS w FROM events
 WHERE value > 0) GROUP BY 1""")
def decayed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    age = F.expr("timestampdiff(MICROSECOND, ts, now)") / 1e6
    return history.decayed_mean(events.crossJoin(F.broadcast(now)), ["event_type"], "value", age).withColumn("decayed_mean", F.round("decayed_mean", 6))


@query("""SELECT o_orderpriority, round(avg(o_totalprice - price), 4) AS delta FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS price FROM lineitem
 GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def delta_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("price"))
    orders = table(spark, sf_dir, "orders").join(price, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.groupBy("o_orderpriority").agg(F.round(F.avg(F.col("o_totalprice") - F.col("price")), 4).alias("delta"))


# Prediction


@query("""SELECT p_type, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
 count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return predict.ols(rows, ["p_type"], "l_quantity", "l_extendedprice").select("p_type", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


#: Parts are history rows: size stands for the palette, price for width.  In the cascades, those of one brand and type.
NEAR_SQL = "abs(h.p_size - p.p_size) <= 8 AND abs(h.p_retailprice - p.p_retailprice) / p.p_retailprice <= 0.15"
WEIGHT_SQL = "1.0 / (0.05 + abs(h.p_retailprice - p.p_retailprice) / p.p_retailprice + abs(h.p_size - p.p_size) / 32.0)"


def profile_sql(on: str) -> str:
    return f"""SELECT partkey, sum(v * w) / sum(w) AS mean, sqrt(greatest(0.0, sum(v * v * w) / sum(w) - pow(sum(v * w) / sum(w), 2))) AS std, count(*) AS n
 FROM (SELECT p.p_partkey AS partkey, h.p_retailprice AS v, {WEIGHT_SQL} AS w
 FROM part p JOIN part h ON {on}) GROUP BY 1"""


PROFILE_SQL = profile_sql(f"p.p_type = h.p_type AND p.p_brand = h.p_brand AND {NEAR_SQL}")


def profiles(spark: SparkSession, sf_dir: str, of: Callable[..., DataFrame], on: list[str], shares: int = 1) -> DataFrame:
    """The neighbour profiles of parts among those that agree in ``on``: ``predict.box_profiles`` or ``predict.with_profiles``."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice")
    part = part.toDF("partkey", "type", "brand", "size", "price")
    distance = F.abs(F.col("h_price") - F.col("p_price")) / F.col("p_price") + F.abs(F.col("h_size") - F.col("p_size")) / 32.0
    return of(part, "partkey", on, {"size": 8}, {"price": 0.15}, "price", distance, positive=False, shares=shares)


@query(f"SELECT partkey, round(mean, 4) AS mean, round(std, 2) AS std, n FROM ({profile_sql(NEAR_SQL)})")
def neighbor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference looks through its whole history, whatever else an entry says.  Prices lie in few bins, so these are dealt out."""
    rows = profiles(spark, sf_dir, predict.box_profiles, [], shares=16)
    return rows.select("partkey", F.round("mean", 4).alias("mean"), F.round("std", 2).alias("std"), "n")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as probes: every third has a known scale, every third neighbours, the rest a mean difference or none."""
    shape = ["partkey", "price / 50.0 as size", "size * 12 as frames", "1.1D + 0.05D * size / 256 as bias", "partkey % 6 as k"]
    rows = profiles(spark, sf_dir, predict.with_profiles, ["type", "brand"]).selectExpr(*shape, "mean / 1000.0 as nb_mean", "std / 1000.0 as nb_std", "n as nb_n")
    known = F.when(F.col("k") < 2, F.lit(0.5) + F.col("k") / 4)
    rows = rows.withColumn("avg_scale", known)
    gone = F.col("k") >= 4
    return rows.withColumn("nb_n", F.when(gone, F.lit(None)).otherwise(F.col("nb_n"))).withColumn("delta", F.when(F.col("k") == 4, F.col("size") * 0.1))


PROBE_SQL = f"""SELECT p.p_partkey AS partkey, p.p_retailprice / 50.0 AS size, p.p_size * 12 AS frames, 1.1::DOUBLE + 0.05::DOUBLE * p.p_size / 256 AS bias, p.p_partkey % 6 AS k,
 CASE WHEN p.p_partkey % 6 < 2 THEN 0.5 + (p.p_partkey % 6) / 4 END AS avg_scale,
  CASE WHEN p.p_partkey % 6 < 4 THEN f.n END AS nb_n, f.mean / 1000.0 AS nb_mean, f.std / 1000.0 AS nb_std,
 CASE WHEN p.p_partkey % 6 = 4 THEN p.p_retailprice / 50.0 * 0.1 END AS delta FROM part p LEFT JOIN ({PROFILE_SQL}) f ON f.partkey = p.p_partkey"""
LONG_SQL = "CASE WHEN frames >= 400 AND size >= 20 THEN 0.88 WHEN frames >= 250 AND size >= 50 THEN 0.93 ELSE 1.0 END"
SCALE_SQL = f"""SELECT *, CASE WHEN avg_scale IS NOT NULL THEN avg_scale
 WHEN nb_n > 0 THEN greatest(nb_mean * CASE WHEN nb_n >= 4 AND nb_std <= 0.035 THEN 0.985 ELSE 0.95 END, sqrt(14.245 / size) * 0.99)
 WHEN delta IS NOT NULL THEN sqrt(14.245 / (size + delta * bias)) * 0.97 * {LONG_SQL} ELSE sqrt(14.245 / (size * bias)) * 0.95 * {LONG_SQL} END AS scale,
 CASE WHEN avg_scale IS NOT NULL THEN 'stats' WHEN nb_n > 0 THEN 'neighbor stats' WHEN delta IS NOT NULL THEN 'delta_avg' ELSE 'formula' END AS source
  FROM ({PROBE_SQL})"""


@query(f"SELECT partkey, round(scale + 1e-9, 5) AS scale, source FROM ({SCALE_SQL})")
def scale_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.scale_cascade(probes(spark, sf_dir)).select("partkey", F.round(F.col("scale") + 1e-9, 5).alias("scale"), "source")


@query(f"""WITH s AS (SELECT *, CASE WHEN k = 5 THEN 1.2 * size + 0.3 END AS fitted FROM ({SCALE_SQL})),
 r AS (SELECT *, coalesce(fitted, size + delta * bias, size * bias) AS raw FROM s), c AS (SELECT *,
  least(greatest(raw, size * 0.3, 0.1), size * 2) AS once FROM r)
 SELECT partkey, round(least(greatest(once * CASE source WHEN 'stats' THEN 1.08 WHEN 'neighbor stats' THEN 1.04 ELSE 1.0 END, size * 0.3, 0.1), size * 2) + 1e-9, 5) AS predicted
  FROM c""")
def size_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predict.scale_cascade(probes(spark, sf_dir)).withColumn("slope", F.when(F.col("k") == 5, 1.2)).withColumn("intercept", F.when(F.col("k") == 5, 0.3))
    return predict.size_cascade(rows).select("partkey", F.round(F.col("predicted") + 1e-9, 5).alias("predicted"))


@query("""SELECT brand, partkey, direct FROM (SELECT p_brand AS brand, p_partkey AS partkey, p_size BETWEEN 20 AND 30 AS direct,
 row_number() OVER (PARTITION BY p_brand
  ORDER BY p_size BETWEEN 20 AND 30 DESC, p_type LIKE '%PROMO%' DESC, abs(p_size - 25), abs(p_retailprice - 950), p_partkey DESC) AS rn FROM part
  WHERE p_retailprice BETWEEN 920 AND 980) WHERE rn = 1""")
def ranked_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").filter(F.col("p_retailprice").between(920, 980))
    part = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), F.col("p_size").between(20, 30).alias("direct"), F.col("p_type").like("%PROMO%").alias("exact"), "p_size", "p_retailprice")
    order = [~F.col("direct"), ~F.col("exact"), F.abs(F.col("p_size") - 25), F.abs(F.col("p_retailprice") - 950), -F.col("partkey")]
    return predict.best_by(part, ["brand"], order, ["partkey", "direct"])


@query("""SELECT orderkey, linenumber, price FROM (SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_extendedprice AS price,
 row_number() OVER (PARTITION BY l_orderkey
  ORDER BY NOT (l_extendedprice BETWEEN 20000 AND 30000), l_extendedprice > 30000, abs(l_extendedprice - 25000), l_linenumber, l_partkey) AS rn
  FROM lineitem) WHERE rn = 1""")
def best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as orderkey", "l_linenumber as linenumber", "l_partkey as partkey", "l_extendedprice as price")
    order = [~F.col("price").between(20000, 30000), F.col("price") > 30000, F.abs(F.col("price") - 25000), F.col("linenumber"), F.col("partkey")]
    return predict.best_by(rows, ["orderkey"], order, ["linenumber", "price"])


@query("""WITH l AS (SELECT user_id, value, floor(event_id % 50)::INT + 50 AS q, row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) AS rn FROM events),
 f AS (SELECT user_id, count(*) AS n, max(q) - min(q) AS spread, regr_slope(ln(value), ln(q)) AS a, regr_intercept(ln(value), ln(q)) AS b FROM l
  WHERE rn <= 3 AND value > 0 GROUP BY 1)
 SELECT user_id, n, CASE WHEN n >= 2 AND a BETWEEN 0.2 AND 5.0 AND (n > 2 OR spread >= 2) THEN round(a, 5) END AS alpha,
  CASE WHEN n >= 2 AND a BETWEEN 0.2 AND 5.0 AND (n > 2 OR spread >= 2) THEN round(b, 4) END AS log_c FROM f""")
def loglog_fit_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("q", (F.col("event_id") % 50 + 50).cast("int"))
    fit = predict.loglog_last3(events, "user_id", ["ts", "event_id"], "q", "value")
    return fit.select("user_id", "n", F.round("alpha", 5).alias("alpha"), F.round(F.log("c"), 4).alias("log_c"))


@query("""WITH p AS (SELECT p_brand AS brand, p_size AS q, greatest(0.5, avg(p_retailprice) - 935) AS s FROM part GROUP BY 1, 2),
 w AS (SELECT brand, q AS q0, s AS s0, lead(q) OVER o AS q1, lead(s) OVER o AS s1 FROM p WINDOW o AS (PARTITION BY brand ORDER BY q)),
 m AS (SELECT *, q1 IS NOT NULL AND (14.245 BETWEEN s0 AND s1 OR 14.245 BETWEEN s1 AND s0) AS hit,
  CASE WHEN abs(ln(s1) - ln(s0)) < 1e-9 THEN round_even((q0 + q1) / 2, 0) ELSE round_even(q0 + (ln(14.245) - ln(s0)) / (ln(s1) - ln(s0)) * (q1 - q0), 0) END AS est
  FROM w),
 g AS (SELECT brand, count(*) AS n, arg_min(est, q0) FILTER (hit) AS inside, min(q0) AS qf, arg_min(s0, q0) AS sf, max(q0) AS ql, arg_max(s0, q0) AS sl
  FROM m GROUP BY 1)
 SELECT brand, CASE WHEN n >= 2 THEN greatest(least(coalesce(inside,
  CASE WHEN sl < 14.245 THEN ql + 6 WHEN sf > 14.245 THEN qf - 6 END), 50), 1)::INT END AS quality FROM g""")
def piecewise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("q")).agg(F.greatest(F.lit(0.5), F.avg("p_retailprice") - 935).alias("s"))
    return predict.piecewise_quality(points, "brand", "q", "s", 14.245, 1, 50)


# Search


@query("""SELECT event_id, max(value) FILTER (value < 20) OVER w AS under, min(value) FILTER (value > 80) OVER w AS over FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.running_bracket(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20, 80).select("event_id", "under", "over")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::INT AS run
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events))""")
def stall_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.run_lengths(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "run")


@query("""SELECT event_id, sum(hit) OVER (PARTITION BY user_id, island
  ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS hits, sum(hit) OVER (PARTITION BY user_id, island
  ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 2 AS tripped
 FROM (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *,
  CASE WHEN value >= 60 THEN 1 ELSE 0 END AS hit FROM events))""")
def guard_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.guard_hits(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") >= 60, 2).select("event_id", "hits", "tripped")


@query("SELECT p_partkey AS partkey, max(q)::INT AS q FROM part LEFT JOIN (SELECT unnest(range(50, 101)) AS q) ON p_retailprice * q / 100 <= 700 GROUP BY 1")
def largest_q_under_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("partkey"), search.largest_under(part, lambda q: F.col("p_retailprice") * q / 100, F.lit(700), 50, 100).alias("q"))


@query("""SELECT partkey,
  CASE WHEN ov - un > 1 THEN floor((ov + un) / 2)::INT ELSE least(greatest(greatest(least(trunc(q * CASE WHEN size / 14.245 > 1.2 OR size / 14.245 < 0.8 THEN greatest(least(sqrt(14.245 / size), 1.3), 0.7) ELSE greatest(least(sqrt(14.245 / size), 1.12), 0.88) END)::INT, 100), 1), un + 1), ov - 1) END AS next_q
 FROM (SELECT p_partkey AS partkey, p_size + 45 AS q, p_size / 2.0 AS size, CASE WHEN p_partkey % 3 > 0 THEN p_size + 30 END AS un,
  CASE WHEN p_partkey % 5 > 0 THEN p_size + 50 END AS ov FROM part)""")
def next_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    under, over = F.when(c("p_partkey") % 3 > 0, c("p_size") + 30), F.when(c("p_partkey") % 5 > 0, c("p_size") + 50)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("partkey"), search.next_quality(c("p_size") + 45, c("p_size") / 2.0, 14.245, under, over).alias("next_q"))


SKIP_SQL = """CASE WHEN it = 0 AND guess AND fast > 1.30 * 14.99 THEN 'hard skip' WHEN it = 0 AND guess AND pred > 1.20 * 14.99 AND fast > 0.90 * 14.99 THEN 'first-med skip'
 WHEN it <= 1 AND guess AND ratio AND pred > 14.99 * 1.08 THEN 'overflow skip' WHEN it <= 1 AND guess AND ratio AND pred < 13.4 THEN 'underflow skip' END"""


@query(f"""SELECT partkey, {SKIP_SQL} AS reason
 FROM (SELECT p_partkey AS partkey, p_partkey % 3 AS it, p_size % 2 = 0 AS guess, p_partkey % 5 > 0 AS ratio, p_size / 2.0 AS fast, p_size / 1.9 AS pred
 FROM part)""")
def skip_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    source = F.when(c("p_size") % 2 == 0, "formula").otherwise("stats")
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("partkey"), search.scale_decision(source, c("p_partkey") % 3, c("p_size") / 2.0, c("p_size") / 1.9, c("p_partkey") % 5 > 0, F.lit(False)).alias("reason"))


@query("""SELECT user_id, bucket::INT AS bucket, arg_min(event_id, rn) AS first, round(greatest(20.0, sum(value)), 6) AS duration
 FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS rn, (row_number() OVER (PARTITION BY user_id
 ORDER BY ts, event_id) - 1) // 3 AS bucket FROM events) GROUP BY 1, 2""")
def index_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_buckets(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 3, "value", "event_id").withColumn("duration", F.round("duration", 6))


@query("""SELECT conv_id, idx::INT AS idx
  FROM (SELECT conv_id, unnest(CASE WHEN n <= 4 THEN range(0, n) ELSE list_distinct(list_transform(range(0, 4), lambda i: round_even(i * (n - 1) / 3.0, 0)::BIGINT)) END) AS idx
  FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1))""")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", F.explode(rules.even_indices(F.col("n"), 4)).alias("idx"))


#: Parts as states of a search: sizes from their size and price, the rest from their key.
STATE_COLUMNS = [
    "p_partkey AS partkey", "p_partkey % 3 AS it", "CASE p_partkey % 4 WHEN 0 THEN 'stats' WHEN 1 THEN 'neighbor stats' WHEN 2 THEN 'delta_avg' ELSE 'formula' END AS source",
    "p_size * 0.5{d} AS fast", "p_size * 0.55{d} AS predicted", "p_size * 0.6{d} AS med", "0.3{d} + p_partkey % 9 * 0.1{d} AS scale", "0.05{d} AS low", "4.0{d} AS high", "p_size * 11 AS frames",
    "p_partkey % 2 * 90000 + 50000 AS pixels", "p_size * 5 + 20 AS colors", "p_partkey % 5 * 1.0{d} AS delta", "1.12{d} AS bias",
]
CAP = "CASE WHEN abs(({x}) - scale) <= scale * {r} THEN ({x}) ELSE scale + sign(({x}) - scale) * scale * {r} END"
BRACKET = "CASE WHEN {lo} < {hi} AND ({x}) > {lo} AND ({x}) < {hi} THEN ({x}) ELSE ({lo} + {hi}) / 2 END"
HARD_WISH = "(CASE WHEN source = 'neighbor stats' AND 14.245 - delta * bias > 0 THEN scale * sqrt((14.245 - delta * bias) / fast) ELSE scale * sqrt(14.245 / fast) * 0.92 END * CASE WHEN frames >= 400 THEN 0.9 ELSE 1.0 END)"
SHRINK = "scale * sqrt(14.245 / predicted) * 0.99"
DECISION_SQL = {
    "fast": "CASE WHEN it = 0 AND fast BETWEEN 13.5 AND 14.995 AND frames >= 120 THEN 'direct' WHEN it >= 1 AND fast BETWEEN 13.8 AND 14.6 THEN 'preferred' END",
    "hard": f"CASE WHEN it = 0 AND source IN ('formula', 'neighbor stats') AND fast > 1.3 * 14.99 THEN {BRACKET.format(x=CAP.format(x=HARD_WISH, r=0.75), lo='low', hi='scale')} END",
    "under": f"CASE WHEN source = 'formula' AND predicted < 13.15 AND fast < 13.5 AND it < 9 THEN {BRACKET.format(x=CAP.format(x='scale * sqrt(14.245 / greatest(predicted, 0.1))', r=0.3), lo='greatest(low, scale)', hi='high')} END",
    "pre": "CASE WHEN it = 0 AND source = 'delta_avg' AND fast < 0.8 * 14.245 AND predicted < 0.92 * 13.5 THEN scale * 0.92 END",
    "soft": "CASE WHEN it = 0 AND abs(sh - scale) > 0.005 AND sh > low AND sh < high THEN sh END",
    "micro": f"CASE WHEN source = 'neighbor stats' AND predicted < 13.5 AND fast < 0.9 * 14.245 AND it <= 1 AND frames >= 80 AND high >= 3.9 AND abs({CAP.format(x='scale * sqrt(14.245 / (fast + 4))', r=0.3)} - scale) > 0.01 THEN {CAP.format(x='scale * sqrt(14.245 / (fast + 4))', r=0.3)} END",
    "temporal": "CASE WHEN it = 0 AND frames >= 360 AND pixels <= 100000 AND med > 14.99 AND scale < 0.85 THEN 'preserve' WHEN it = 0 AND frames >= 360 AND pixels <= 100000 AND med BETWEEN 13.5 AND 14.995 AND scale < 0.7 THEN 'retry' END",
    "keep_every": "greatest(least(round_even(med / 14.245, 0), 3), 2)::INT",
    "finished": "med BETWEEN 13.5 AND 14.995 OR it >= 1 AND med BETWEEN 13.8 AND 14.6",
    "next_scale": f"CASE WHEN w > lo2 AND w < hi2 THEN w ELSE {CAP.format(x='(lo2 + hi2) / 2', r=0.15)} END",
}
NUMBERS = ("hard", "under", "pre", "soft", "micro", "next_scale")


@query(f"""WITH s AS (SELECT {', '.join(c.format(d='::DOUBLE') for c in STATE_COLUMNS)} FROM part),
 t AS (SELECT *, CASE WHEN source = 'formula' AND predicted > 0.985 * 14.99 AND predicted <= 1.2 * 14.99 AND fast > 0.8 * 14.99 THEN {CAP.format(x=SHRINK, r=0.12)} WHEN source = 'stats' AND colors >= 220 AND predicted BETWEEN 0.995 * 14.99 AND 1.2 * 14.99 AND fast > 0.7 * 14.99 THEN {CAP.format(x=SHRINK, r=0.1)} END AS sh,
 CASE WHEN med > 14.99 THEN low ELSE scale END AS lo2,
  CASE WHEN med > 14.99 THEN scale ELSE high END AS hi2, {CAP.format(x='scale * sqrt(14.245 / med)', r=0.35)} AS w FROM s)
 SELECT partkey, {', '.join(f'round({x} + 1e-9, 6) AS {n}' if n in NUMBERS else f'{x} AS {n}' for n, x in DECISION_SQL.items())} FROM t""")
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "part").selectExpr(*(c.format(d="D") for c in STATE_COLUMNS))
    d = decisions
    made = {"fast": d.fast_accept(), "hard": d.hard_skip_scale(), "under": d.under_target_scale(), "pre": d.pre_correct_scale(), "soft": d.soft_shrink_scale(), "micro": d.micro_adjust_scale(),
            "temporal": d.temporal_step(), "keep_every": d.keep_every(), "finished": d.finished(), "next_scale": d.advanced_scale()}
    return state.select("partkey", *((F.round(x + 1e-9, 6) if n in NUMBERS else x).alias(n) for n, x in made.items()))


@query("""WITH s AS (SELECT p_partkey AS partkey, 40 + p_size AS q, 10 + p_retailprice % 97 / 10 AS size,
  CASE WHEN p_partkey % 2 = 0 THEN 40 END AS un, CASE WHEN p_partkey % 3 = 0 THEN 90 END AS ov,
  CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 * 0.5 END AS alpha FROM part),
 m AS (SELECT *, abs(size - 14.245) / 14.245 AS miss FROM s), t AS (SELECT *,
  CASE WHEN un IS NOT NULL AND ov IS NULL THEN greatest(CASE WHEN miss <= 0.04 THEN 1 ELSE 2 END,
  least(greatest(ceil(miss / 0.0125)::INT, 1), 3)) WHEN miss <= 0.04 THEN 1 ELSE 2 END AS step FROM m)
 SELECT partkey, CASE WHEN miss <= 0.1 AND (un IS NULL OR ov IS NULL) THEN greatest(least(CASE WHEN size > 14.245 THEN q - step ELSE q + step END, 100), 45) END AS nudged,
  round(size * pow(greatest(0.01, 45.0 / q), coalesce(alpha, 1.0)) + 1e-9, 5) AS floor_mb,
 un IS NULL AND ov IS NOT NULL AND q - 5 <= 45 AND size * pow(greatest(0.01, 45.0 / q), coalesce(alpha, 1.0)) > 1.05 * 14.99 AS early,
  round(CASE WHEN q <= 45 THEN greatest(least(sqrt(14.245 / size), 0.95), 0.8) END + 1e-9, 6) AS factor,
 coalesce(miss > 0.04 AND p_left > 0 AND ov - un > 1, false) AS refine,
  round(CASE WHEN size / 12 > 1 THEN greatest(13.0, 12.5 * size / 12) ELSE 13.0 END + 1e-9, 6) AS raised, size * 1.1 <= 14.99 * 0.96 AS direct
  FROM (SELECT *, partkey % 4 AS p_left FROM t)""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as partkey", "40 + p_size as q", "10 + p_retailprice % 97 / 10 as size", "case when p_partkey % 2 = 0 then 40 end as un", "case when p_partkey % 3 = 0 then 90 end as ov", "case when p_partkey % 5 > 0 then p_partkey % 5 * 0.5D end as alpha")
    d = decisions
    return rows.select(
        "partkey", d.nudged_quality(c("q"), c("size"), c("un"), c("ov")).alias("nudged"), F.round(d.floor_size(c("q"), c("size"), c("alpha")) + 1e-9, 5).alias("floor_mb"),
        d.early_resize(c("q"), c("size"), c("alpha"), c("q") - 5, c("un"), c("ov")).alias("early"), F.round(d.resize_factor(c("q"), c("size")) + 1e-9, 6).alias("factor"),
        F.coalesce(d.refine_in_band(c("size"), c("un"), c("ov"), c("partkey") % 4), F.lit(False)).alias("refine"),
        F.round(d.probe_raise(F.lit(13.0), F.lit(12.5), c("size") / 12) + 1e-9, 6).alias("raised"), d.direct_fast(c("size")).alias("direct"),
    )


# Inventory


ROUTE_SQL = """CASE WHEN ext = '.gif' THEN CASE WHEN size > 15.0 * 1048576 THEN 'gif' END WHEN ext IN ('.mp4', '.mov') THEN 'video' WHEN ext = '.png' THEN 'png' WHEN ext IN ('.jpg', '.jpeg') THEN CASE WHEN size > 1022976 THEN 'jpg' END
 WHEN ext = '.jfif' THEN 'jpg' WHEN ext = '.webp' AND size > 1022976 THEN CASE WHEN anim THEN CASE WHEN size > 15.0 * 1048576 THEN 'webp_animated' END ELSE 'webp_static' END END"""
EXTS = (".gif", ".mp4", ".png", ".jpg", ".jfif", ".webp", ".txt")


@query(f"""SELECT route, count(*) AS n FROM (SELECT {ROUTE_SQL} AS route
 FROM (SELECT CASE doc_id % 7 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTS))} END AS ext, n_chars * 8000 AS size, doc_id % 2 = 0 AS anim
 FROM documents)) WHERE route IS NOT NULL GROUP BY 1""")
def route_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % len(EXTS)).cast("int"))
    docs = table(spark, sf_dir, "documents").select(media.route(ext, F.col("n_chars") * 8000, F.col("doc_id") % 2 == 0).alias("route"))
    return media.route_counts(docs)


@query(r"SELECT regexp_extract(url, '(\.[a-z]+)$', 1) AS suffix, count(*) AS n FROM pages GROUP BY 1")
def url_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"(\.[a-z]+)$", 1).alias("suffix")).agg(F.count("*").alias("n"))


# Recovery


def backup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "D").when(F.col("event_type") == "purchase", "I").when(F.col("event_type") == "click", "L")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("set_id"), F.concat(F.lit("db]"), F.col("user_id").cast("string")).alias("db"), kind.alias("kind"), F.col("ts").alias("start"), F.expr("ts + interval 5 minutes").alias("finish"), F.col("event_id").alias("media_id"))


BASE_SQL = """WITH s AS (SELECT event_id AS set_id, 'db]' || user_id AS db,
  CASE event_type WHEN 'signup' THEN 'D' WHEN 'purchase' THEN 'I' WHEN 'click' THEN 'L' END AS kind, ts AS start, ts + INTERVAL 5 MINUTE AS finish
  FROM events),
 f AS (SELECT db, arg_max(set_id, (finish, set_id)) AS full_id, arg_max(start, (finish, set_id)) AS full_start FROM s WHERE kind = 'D' GROUP BY 1),
 d AS (SELECT s.db, arg_max(set_id, (finish, set_id)) AS diff_id, arg_max(start, (finish, set_id)) AS diff_start FROM s JOIN f ON s.db = f.db
  WHERE kind = 'I' AND start > full_start GROUP BY 1),
 b AS (SELECT f.*, diff_id, diff_start, coalesce(diff_start, full_start) AS base_start FROM f LEFT JOIN d ON f.db = d.db)"""


@query(f"{BASE_SQL} SELECT * FROM b")
def recovery_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovery_base(backup_sets(spark, sf_dir))


@query(f"{BASE_SQL} SELECT s.db, set_id, start FROM s JOIN b ON s.db = b.db WHERE kind = 'L' AND start > base_start")
def recovery_log_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = backup_sets(spark, sf_dir)
    return recovery.log_chain(sets, recovery.recovery_base(sets)).select("db", "set_id", "start")


NAME_SQL = "'[' || replace({0}.db, ']', ']]') || ']'"


@query(rf"""{BASE_SQL}, l AS (SELECT s.db, set_id, start FROM s JOIN b ON s.db = b.db WHERE kind = 'L' AND start > base_start),
 c AS (SELECT b.db, 'D' AS kind, '    FROM DISK = N''/b/' || full_id || '_1.bak'',' || chr(10) || '         DISK = N''/b/' || full_id || '_2.bak''' || chr(10) AS clause, diff_id
  FROM b
  UNION ALL SELECT b.db, 'I', '    FROM DISK = N''/b/' || diff_id || '_1.bak'',' || chr(10) || '         DISK = N''/b/' || diff_id || '_2.bak''' || chr(10), diff_id
  FROM b WHERE diff_id IS NOT NULL),
 r AS (SELECT db, 0 AS step, NULL::BIGINT AS set_id, list_filter(['/* RESTORE SCRIPT FOR SECONDARY REPLICA */', '-- Database: ' || {NAME_SQL.format('b')}, '-- FULL start: ' || strftime(full_start, '%Y-%m-%d %H:%M:%S'), '-- DIFF start: ' || strftime(diff_start, '%Y-%m-%d %H:%M:%S'), '-- Base for LOG chain: ' || strftime(base_start, '%Y-%m-%d %H:%M:%S')], lambda x: x IS NOT NULL) AS lines
  FROM b
  UNION ALL SELECT db,
  CASE kind WHEN 'D' THEN 1 ELSE 2 END, NULL, [CASE kind WHEN 'D' THEN '-- 1) RESTORE FULL' ELSE '-- 2) RESTORE DIFFERENTIAL' END, 'RESTORE DATABASE ' || {NAME_SQL.format('c')}, clause,
  CASE kind WHEN 'D' THEN '    WITH NORECOVERY, REPLACE, STATS = 10;' ELSE '    WITH NORECOVERY, STATS = 10;' END] FROM c
  UNION ALL SELECT db, 3, NULL, ['-- ' || CASE WHEN diff_id IS NOT NULL THEN '3' ELSE '2' END || ') RESTORE LOG CHAIN (chronological order)'] FROM b
  UNION ALL SELECT db, 4, set_id, ['RESTORE LOG ' || {NAME_SQL.format('l')}, '    FROM DISK = N''/b/' || set_id || '_' || n || '.bak''', '    WITH NORECOVERY, REPLACE, STATS = 10;']
  FROM l, (SELECT unnest([1, 2]) AS n)
  UNION ALL SELECT db, 5, NULL, ['-- WARNING: No LOG backups found after base.'] FROM b WHERE db NOT IN (SELECT db FROM l))
 SELECT db, step, set_id, unnest(range(0, len(lines)))::INT AS line_no, unnest(lines) AS line FROM r""")
def recovery_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = backup_sets(spark, sf_dir)
    files = sets.select("media_id", F.posexplode(F.array(*(F.concat(F.lit("/b/"), F.col("media_id").cast("string"), F.lit(f"_{n}.bak")) for n in (1, 2)))).alias("seq", "path"))
    base = recovery.recovery_base(sets)
    clauses = recovery.from_clause(files)
    full = base.select("db", F.lit("D").alias("kind"), F.col("full_id").alias("media_id")).unionByName(base.filter("diff_id is not null").select("db", F.lit("I").alias("kind"), F.col("diff_id").alias("media_id")))
    return recovery.recovery_script(base, recovery.log_chain(sets, base, files), full.join(clauses, "media_id").select("db", "kind", "clause")).drop("at")


@query("""WITH s AS (SELECT event_id AS set_id, 'db]' || user_id AS db, ts AS start, ts + INTERVAL 5 MINUTE AS finish, event_type FROM events),
  c AS (SELECT db, median(start) AS completed FROM s GROUP BY 1)
 SELECT s.db, set_id, start, finish, CASE WHEN set_id % 3 > 0 THEN '/b/' || set_id || '_2.bak' END AS path FROM s JOIN c ON s.db = c.db
  WHERE event_type = 'click' AND finish > (SELECT max(ts) - INTERVAL 10 DAY FROM events)""")
def recovery_logs_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = backup_sets(spark, sf_dir)
    files = sets.filter("set_id % 3 > 0").select("media_id", F.posexplode(F.array(*(F.concat(F.lit("/b/"), F.col("media_id").cast("string"), F.lit(f"_{n}.bak")) for n in (1, 2)))).alias("seq", "path"))
    done = sets.agg(F.expr("max(start) - interval 10 days").alias("completed"))
    return recovery.logs_after(sets, files, sets.select("db").distinct().crossJoin(F.broadcast(done)))


@query("""WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM documents),
  b AS (SELECT doc_id, ls[1:len(ls) - 1] AS before, ls[len(ls)] AS rest FROM l),
  k AS (SELECT doc_id, CASE WHEN rtrim(rest, ' ') = '' THEN before
   ELSE list_append(before, left(rest, length(rtrim(rest, ' ')) + coalesce(list_min(list_transform(before, lambda x: length(x) + 1)), length(rest)))) END AS ls FROM b),
  e AS (SELECT doc_id, unnest(range(0, len(ls)))::INT AS line_no, unnest(ls) AS line FROM k),
 p AS (SELECT *, unnest(range(0, greatest(0, (length(rtrim(line, ' ')) - 1)) // 4000 + 1))::INT AS part FROM e)
  SELECT doc_id, line_no, part, substring(line, part * 4000 + 1, 4000) AS line FROM p""")
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.script_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
