"""Operators on small frames: hand-computed cases, brute force and properties."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import rules
from marlstone.operators import admin, decisions, dedup, graph, history, predict, recovery, search
from marlstone.sources import history_json, media, storage
from marlstone.streaming.upsert import read_upserted, stream_upsert


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (lambda: rules.even_indices(L(100), 8), [0, 14, 28, 42, 57, 71, 85, 99]),
        (lambda: rules.even_indices(L(9), 8), [0, 1, 2, 3, 5, 6, 7, 8]),
        (lambda: rules.even_indices(L(5), 8), [0, 1, 2, 3, 4]),
        (lambda: rules.even_indices(L(0), 8), []),
        (lambda: F.slice(rules.even_starts(L(390), 20), 1, 5), [0, 19, 39, 58, 78]),
        (lambda: rules.bucketize(L(12.5), 5), 10.0),
        (lambda: rules.bucketize(L(7.5), 5), 10.0),
        (lambda: rules.bucketize(L(29.97), 1), 30.0),
        (lambda: rules.bucketize(L(3.0), 2), 4.0),
        (lambda: rules.bucketize(L(None).cast("double"), 2), None),
        (lambda: rules.hamming(F.array(L(0), L(0)), F.array(L(1))), 1),
        (lambda: rules.hamming(F.array(L(0), L(0)), F.array(L(1), L(0))), 0),
        (lambda: rules.hamming(F.array(L(0), L(0)), F.array(L(7), L(0))), 2),
        (lambda: rules.hamming(F.array(L(15)), F.array(L(0), L(15))), 2),
        (lambda: rules.clamp_prediction(L(100.0), L(10.0)), 20.0),
        (lambda: rules.clamp_prediction(L(1.0), L(10.0)), 3.0),
        (lambda: rules.clamp_prediction(L(12.0), L(10.0)), 12.0),
        (lambda: rules.clamp_prediction(L(0.0), L(0.1)), 0.1),
        (lambda: rules.step_cap(L(1.0), L(2.0), 0.15), 1.15),
        (lambda: rules.step_cap(L(1.0), L(0.5), 0.15), 0.85),
        (lambda: rules.step_cap(L(1.0), L(1.1), 0.15), 1.1),
        (lambda: rules.step_cap(L(1.0), L(2.0), 0.0), 1.0),
        (lambda: rules.bracket_clamp(L(5.0), L(1.0), L(4.0)), 2.5),
        (lambda: rules.bracket_clamp(L(2.0), L(1.0), L(4.0)), 2.0),
        (lambda: rules.bracket_clamp(L(1.0), L(1.0), L(4.0)), 2.5),
        (lambda: F.array(*(rules.sample_size(L(n)) for n in (10, 12, 13, 100, 400, 1000, 10000))), [10, 12, 12, 12, 25, 36, 36]),
        (lambda: F.array(*(rules.frame_timeout(L(n)) for n in (100, 2000, 10000))), [600.0, 1040.0, 3600.0]),
        (lambda: rules.seeded_quality(L(20.0), rules.MID, 60, 95), 81),
        (lambda: rules.quotename(L("a]b")), "[a]]b]"),
        (lambda: rules.hex_key(F.array(L(-1).cast("bigint"), L(255).cast("bigint"))), "ffffffffffffffff|00000000000000ff"),
        (lambda: rules.fraction(L("30000/1001")), 30000 / 1001),
        (lambda: rules.fraction(L("24/0")), 24.0),
        (lambda: rules.strided(F.array(*map(L, range(10))), 3), [0, 3, 6]),
        (lambda: rules.top_folder(L("a/b/c.gif")), "a"),
        (lambda: rules.top_folder(L("c.gif")), "."),
        (lambda: rules.parent_folder(L("a/b/c.gif")), "a/b"),
        (lambda: rules.with_suffix(L("a.b/c.gif"), ".webp"), "a.b/c.webp"),
        (lambda: rules.suffix(L("x/Y.GIF")), ".gif"),
        (lambda: rules.corrected_quality(L(80), L(10.0), L(10.2)), None),
        (lambda: rules.corrected_quality(L(80), L(20.0), L(10.0)), 47),
        (lambda: rules.short_label(L("abcdefgh"), 6), "...fgh"),
        (lambda: rules.statement_slice(L("select 1; select 2"), L(20), L(-1)), ""),
        (lambda: rules.statement_slice(L("select 1; select 2"), L(0), L(-1)), "s"),
        (lambda: rules.statement_slice(L("select 1; select 2"), L(20), L(26)), "sele"),
        (lambda: rules.clamp(L(None).cast("double"), L(1.0), L(2.0)), None),
        (lambda: rules.clamp_prediction(L(None).cast("double"), L(10.0)), None),
        (lambda: rules.clamp_prediction(L(5.0), L(None).cast("double")), None),
        (lambda: rules.clamp_prediction(L(50.0), L(10.0)), 20.0),
        (lambda: rules.sample_size(L(None).cast("int")), None),
        (lambda: rules.seeded_quality(L(None).cast("double"), 14.245, 45, 95), 95),
        (lambda: rules.probe_target(L(None).cast("double")), rules.MID),
        (lambda: search.next_quality(L(60), L(None).cast("double"), 14.245, L(None).cast("int"), L(None).cast("int")), None),
        (lambda: decisions.resize_factor(L(40), L(None).cast("double")), None),
        (lambda: rules.long_bias(L(1.0), L(400), L(20.0)), 0.88),
    ],
)
def test_rule(spark, expr, want):
    got = one(spark, expr())
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


@pytest.mark.parametrize("threshold", [0, 3, 6, 18])
def test_near_pairs_and_leaders(spark, threshold):
    rng = random.Random(threshold)
    sigs = []
    for i in range(120):
        base = rng.getrandbits(64) if i % 4 == 0 else sigs[-1][1]
        for _ in range(rng.randint(0, 4)):
            base ^= 1 << rng.randrange(64)
        sigs.append((i, base))
    signed = [(i, s - (1 << 64) if s >> 63 else s) for i, s in sigs]
    df = spark.createDataFrame(signed, "id long, sig long")
    pairs = dedup.near_pairs(df, "id", "sig", threshold)
    want = sorted((a, b, (x ^ y).bit_count()) for a, x in sigs for b, y in sigs if a < b and (x ^ y).bit_count() <= threshold)
    assert sorted(map(tuple, pairs.collect())) == want
    near, used, led = {(a, b) for a, b, _ in want}, set(), []
    for i, _ in sigs:
        if i not in used:
            mine = [j for j, _ in sigs if j > i and j not in used and (i, j) in near]
            used |= set(mine)
            led += [(i, j) for j in mine]
    for most in (1_000_000, 3):  # by scans, and by rounds in larger components
        assert sorted(map(tuple, dedup.leader_clusters(pairs, df, "id", most).collect())) == sorted(led)


def test_signature_clusters_against_a_scan(spark):
    """Many items of few signatures, in a chain of near ones: the greedy scan of all items."""
    rng = random.Random(8)
    own = [(i, (1 << rng.randrange(12)) - 1) for i in range(150)]
    want, used = [], set()
    for i, x in own:
        if i not in used:
            mine = [j for j, y in own if j > i and j not in used and (x ^ y).bit_count() <= 2]
            used |= set(mine)
            want += [(i, j) for j in mine]
    df = spark.createDataFrame(own, "id long, sig long")
    assert sorted(map(tuple, dedup.signature_clusters(df, "id", "sig", 2).collect())) == sorted(want)


def test_leaders_are_found_without_all_pairs_of_a_cluster(spark, monkeypatch):
    """Batches of rising ids: the same clusters, from far fewer pairs than near ones."""
    rng = random.Random(2)
    own = [(i, sum(1 << k for k in rng.sample(range(12), 2)) | i % 64 << 20) for i in range(400)]
    want, used, near = [], set(), 0
    for i, x in own:
        mine = [j for j, y in own if j > i and (x ^ y).bit_count() <= 6]
        near += len(mine)
        if i not in used:
            want += [(i, j) for j in mine if j not in used]
            used |= set(mine)
    seen, whole = [], dedup.leader_clusters
    monkeypatch.setattr(dedup, "leader_clusters", lambda pairs, *a: (seen.append(pairs.count()), whole(pairs, *a))[1])
    df = spark.createDataFrame(own, "id long, sig long")
    assert sorted(map(tuple, dedup.signature_clusters(df, "id", "sig", 6, batch=40).collect())) == sorted(want)
    assert len(seen) > 1 and sum(seen) < near // 10


def test_components_of_chains(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 300)
    edges = [(ids[i], ids[i + 1]) for i in range(299) if i % 60 != 59] + [(7_000, 7_000)]
    want = {v: min(ids[k : k + 60]) for k in range(0, 300, 60) for v in ids[k : k + 60]}
    got = {r["u"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_scratch_deletes_tables(spark):
    before = set(storage.children(spark, storage.shared_dir(spark)))
    with storage.scratch(spark):
        storage.stored(spark.range(5).toDF("id"), "inner")
        kept = storage.stored(spark.range(7).toDF("id"), "outer", keep=True)
    after = set(storage.children(spark, storage.shared_dir(spark)))
    assert [x.split("-")[0] for x in after - before] == ["outer"] and kept.count() == 7


def test_keep_delete_partitions_groups(spark):
    rows = [("a.webp", "x", 0, 9), ("b.gif", "x", 1, 1), ("c.gif", "y", 1, 1), ("d.webp", "z", 0, 1), ("e.webp", "z", 0, 1)]
    df = spark.createDataFrame(rows, "path string, digest string, gif int, mtime int")
    plan = dedup.keep_delete(df, "digest", "path", [(-F.col("gif")).alias("g"), (-F.col("mtime")).alias("m")])
    assert sorted(map(tuple, plan.collect())) == [("b.gif", "a.webp"), ("d.webp", "e.webp")]


def test_pairs_of_four(spark):
    df = spark.createDataFrame([(i, "k") for i in "dbca"], "path string, k string")
    assert sorted(map(tuple, dedup.adjacent_pairs(df, "k", "path").collect())) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]


def test_compact_counts_rows_not_counts(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, 1), (1, 2.0, 0.6, 5), (1, 3.0, 0.7, 1), (2, 1.0, None, 1)], "k int, ts double, scale double, count int")
    assert sorted(map(tuple, history.compact(df, ["k"], ["ts"]).collect())) == [(1, 3.0, 0.7, 3), (2, 1.0, None, 1)]
    df = spark.createDataFrame([(1, 1.0, 0.5, 1), (1, 2.0, None, 5), (1, 3.0, None, 1), (2, 1.0, None, 1)], "k int, ts double, scale double, count int")
    assert sorted(map(tuple, history.compact(df, ["k"], ["ts"], "scale").collect())) == [(1, 3.0, 2.0 / 3, 3), (2, 1.0, None, 1)]


def test_scale_steps_reach_the_band(spark):
    """The repeated step, on sizes that go with the square of the scale."""
    rows = [(i, 9.0 + 7 * i, 1.0, 0.01, 4.0) for i in range(1, 30)]
    for _ in range(14):
        df = spark.createDataFrame(rows, "id int, full double, scale double, low double, high double").withColumn("size", F.col("full") * F.col("scale") ** 2)
        low, high, then = search.scale_step(F.col("scale"), F.col("size"), F.col("low"), F.col("high"))
        rows = [tuple(r) for r in df.select("id", "full", F.coalesce(then, "scale"), F.when(then.isNull(), F.col("low")).otherwise(low), F.when(then.isNull(), F.col("high")).otherwise(high)).collect()]
    assert all(13.5 <= full * scale**2 <= 14.995 for _, full, scale, _, _ in rows)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "b"), (None, 1.0, "n")], "k int, ts double, v string")
    new = spark.createDataFrame([(1, 2.0, "c"), (None, 2.0, "m")], "k int, ts double, v string")
    once = history.upsert(old, new, ["k"], ["ts"])
    want = {(1, 2.0, "c"), (2, 1.0, "b"), (None, 2.0, "m")}
    assert set(map(tuple, once.collect())) == want == set(map(tuple, history.upsert(once, new, ["k"], ["ts"]).collect()))


def test_decayed_mean(spark):
    df = spark.createDataFrame([("a", 0.8, 0.0), ("a", 0.6, 86400.0), ("a", -1.0, 0.0), ("b", 1.0, 2e9)], "k string, v double, age double")
    got = dict(map(tuple, history.decayed_mean(df, ["k"], "v", F.col("age")).collect()))
    assert got["a"] == pytest.approx(0.733333, abs=1e-6) and got["b"] is None


def test_ols(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 2.0), ("b", 1.0, 4.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: (r["slope"], r["intercept"]) for r in predict.ols(df, ["k"], "x", "y").collect()}
    assert got["a"] == (pytest.approx(2), pytest.approx(0)) and got["b"] == got["c"] == (None, None)


def test_box_join_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(1, 60), round(rng.uniform(1, 300), 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, t string, s int, p double")
    got = {(r.p_id, r.h_id) for r in predict.box_join(df, df, ["t"], {"s": 8}, {"p": 0.15}).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and abs(a[2] - b[2]) <= 8 and abs(a[3] - b[3]) / a[3] <= 0.15}


@pytest.mark.parametrize("shares", [1, 5])
def test_box_join_of_any_sign_is_exact(spark, shares):
    """Over a value below 0 every difference is within the ratio, over 0 none; dealt out, each pair is met once."""
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 60), rng.choice([0.0, round(rng.uniform(-300, 300), 2), round(rng.uniform(100, 120), 2)])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, s int, p double")
    got = sorted((r.p_id, r.h_id) for r in predict.box_join(df, df, [], {"s": 8}, {"p": 0.15}, signed=True, shares=shares).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if abs(a[1] - b[1]) <= 8 and a[2] and abs(a[2] - b[2]) / a[2] <= 0.15)


def test_box_join_sends_no_side_through_the_driver(spark):
    df = spark.createDataFrame([(1, "a", 3, 2.0)], "id int, t string, s int, p double")
    plan = predict.box_join(df, df, ["t"], {"s": 8}, {"p": 0.15})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_box_profiles_count_copies(spark):
    """Copies are counted, though no two of them are paired; a row without a value has no profile."""
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randint(1, 30), float(rng.randint(20, 40))) for i in range(80)]
    rows = [(i + 100 * k, *r) for i, *r in rows for k in range(rng.choice([1, 1, 7]))] + [(-1, None, 3, 25.0), (-2, "a", 3, None)]
    df = spark.createDataFrame(rows, "id int, t string, s int, p double")
    distance = F.abs(F.col("h_p") - F.col("p_p")) / F.col("p_p") + F.abs(F.col("h_s") - F.col("p_s")) / 32.0
    got = {r["id"]: (r["n"], r["mean"], r["std"]) for r in predict.box_profiles(df, "id", ["t"], {"s": 8}, {"p": 0.15}, "p", distance).collect()}
    whole = [r for r in rows if None not in r]
    assert set(got) == {r[0] for r in whole}
    for i, t, s, p in whole:
        near = [(q, 1 / (0.05 + abs(q - p) / p + abs(z - s) / 32)) for _, u, z, q in whole if u == t and abs(z - s) <= 8 and abs(q - p) / p <= 0.15]
        mean = sum(q * w for q, w in near) / sum(w for _, w in near)
        std = max(0.0, sum(q * q * w for q, w in near) / sum(w for _, w in near) - mean * mean) ** 0.5
        assert got[i] == (len(near), pytest.approx(mean), pytest.approx(std, abs=1e-4))


def test_loglog(spark):
    df = spark.createDataFrame([("f", 1, 60, 10240), ("f", 2, 80, 16384), ("g", 1, 60, 5)], "f string, seq int, q int, size int")
    got = {r["f"]: (r["alpha"], r["c"]) for r in predict.loglog_last3(df, "f", ["seq"], "q", "size").collect()}
    assert got["f"] == (pytest.approx(1.633761, abs=1e-5), pytest.approx(12.741675, abs=1e-4)) and got["g"] == (None, None)


def test_index_buckets(spark):
    df = spark.createDataFrame([("f", i, 10.0) for i in range(5)], "f string, i int, d double")
    got = sorted(map(tuple, search.index_buckets(df, "f", ["i"], 2, "d", "i").collect()))
    assert got == [("f", 0, 0, 20.0), ("f", 1, 2, 20.0), ("f", 2, 4, 20.0)]


def backups(spark, rows):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    return spark.createDataFrame([(i, "d", k, at(t), at(t + 0.5), i) for i, (k, t) in enumerate(rows)], "set_id int, db string, kind string, start timestamp, finish timestamp, media_id int")


@pytest.mark.parametrize(("rows", "base", "logs"), [([("D", 1), ("I", 3), ("L", 2), ("L", 4)], 1, [3]), ([("D", 5), ("I", 3), ("L", 6)], 0, [2])])
def test_recovery(spark, rows, base, logs):
    sets = backups(spark, rows)
    found = recovery.recovery_base(sets)
    r = found.first()
    assert (r["diff_id"] if r["diff_id"] is not None else r["full_id"]) == base
    assert [x["set_id"] for x in recovery.log_chain(sets, found).collect()] == logs


@pytest.mark.parametrize(("text", "want"), [("a\nb\n", ["a", "b"]), ("x" * 8000, ["x" * 4000] * 2), ("a\r\n\nb", ["a", "", "b"])])
def test_script_lines(spark, text, want):
    rows = recovery.script_lines(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("line_no", "part").collect()
    assert [r["line"] for r in rows] == want


def printed(text, width):
    """The print loop, with lengths that don't count the blanks at the end."""
    size = lambda x: len(x.rstrip(" "))
    rest, out = text.replace("\r", ""), []
    while size(rest) > 0:
        at = rest.find("\n")
        line, rest = (rest, "") if at < 0 else (rest[:at], rest[at + 1 :][: size(rest)])
        while size(line) > width:
            out.append(line[:width])
            line = line[width:][: size(line)]
        out.append(line[:width])  # a message holds no more
    return out


def test_script_lines_and_blanks(spark):
    rng = random.Random(1)
    own = ["".join(rng.choice(["a", "bc", " ", "  ", "   ", "\n", "\r\n", "x" * 7, " " * 9]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    own += ["y" * 5 + " " * 20, " " * 30, "\n", "\n\n  ", "\nx" + " " * 12, "ab\n" + " " * 11 + "z" + " " * 9]
    rows = recovery.script_lines(spark.createDataFrame(list(enumerate(own)), "id int, t string"), "id", "t", 5).orderBy("id", "line_no", "part").collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append(r["line"])
    assert [got.get(i, []) for i in range(len(own))] == [printed(t, 5) for t in own]


@pytest.mark.parametrize(("ext", "size", "want"), [(".gif", 15 * 2**20, None), (".gif", int(15.1 * 2**20), "gif"), (".jfif", 1, "jpg"), (".png", 1, "png"), (".jpg", 1022976, None), (".jpg", 1022977, "jpg"), (".webp", 2**20, "webp_static")])
def test_route(spark, ext, size, want):
    assert one(spark, media.route(L(ext), L(size), L(False))) == want


def test_webp_header(spark, tmp_path):
    def chunk(name, data):
        return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)

    moving = b"RIFF\0\0\0\0WEBP" + chunk(b"VP8X", b"\2" + bytes(9))
    later = b"RIFF\0\0\0\0WEBP" + chunk(b"EXIF", b"abc") + chunk(b"ANIM", bytes(6))
    still = b"RIFF\0\0\0\0WEBP" + chunk(b"VP8 ", bytes(10))
    for name, data in (("a.webp", moving), ("b.webp", later), ("c.webp", still), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    assert media.file_count(media.files(spark, str(tmp_path))).first()["n"] == 4
    found = media.images(media.files(spark, str(tmp_path))).select("path", media.animated(F.col("content")).alias("anim")).collect()
    assert sorted((r["path"][-6:], r["anim"]) for r in found) == [("a.webp", True), ("b.webp", True), ("c.webp", False)]


def test_history_json(spark, tmp_path):
    gif = {"palette": 256, "width": 1, "height": 2, "frames": 3, "fast_size": 1.5, "med_size": 2.5, "scale": 0.5, "timestamp": 9.0}
    (tmp_path / "h.json").write_text("﻿" + json.dumps({"_schema_version": 1, "gif_stats": [gif, gif | {"count": 4}]}, indent=2), encoding="utf-8")
    found = history_json.read_history(spark, str(tmp_path / "h.json"))
    assert sorted(str(r["count"]) for r in found["gif_stats"].collect()) == ["4", "None"]
    assert found["video_webp_stats"].count() == 0


def test_video_probe(spark):
    text = '{"streams":[{"width":640,"height":360,"avg_frame_rate":"30000/1001"}],"format":{"duration":"12.5"}}'
    rows = spark.createDataFrame([(text,), ("junk",)], "probe string").select(*history_json.video_probe()).collect()
    assert tuple(rows[0])[:2] == (640, 360) and rows[0]["fps"] == pytest.approx(29.97, abs=0.01) and rows[1]["width"] is None


def test_int_division_before_sum(spark):
    files = spark.createDataFrame([(5, "ROWS", 100), (5, "ROWS", 100), (2, "ROWS", 9999)], "database_id int, type_desc string, size int")
    names = spark.createDataFrame([(5, "d"), (2, "s")], "database_id int, name string")
    assert list(map(tuple, admin.database_sizes(files, names).collect())) == [("d", 0, 0)]


def test_datetime_columns_and_files(spark):
    f = spark.createDataFrame
    got = admin.datetime_index_columns(f([(1, 1, "t", "i")], "object_id int, index_id int, object_name string, index_name string"), f([(1, 1, 1), (1, 1, 2)], "object_id int, index_id int, column_id int"), f([(1, 1, 61, "c"), (1, 2, 56, "n")], "object_id int, column_id int, user_type_id int, column_name string"), f([(61, "datetime"), (56, "int")], "user_type_id int, type_name string"))
    assert list(map(tuple, got.collect())) == [("t", "i", "c", "datetime")]
    rows = admin.database_files(f([(5, 1, "LOG", "p", 8), (1, 1, "ROWS", "q", 8), (9, 1, "ROWS", "r", 8)], "database_id int, data_space_id int, type_desc string, physical_name string, size int"), f([(5, "d"), (1, "master")], "database_id int, name string"), f([(1, "PRIMARY")], "data_space_id int, name string"))
    assert list(map(tuple, rows.collect())) == [("d", "log", "PRIMARY", "p", 8)]
    gained = admin.free_space_gained(f([("C", 1 << 30)], "disk string, free long"), f([("C", 3 << 30)], "disk string, free long")).first()
    assert gained["gained_gb"] == 2.0


def test_size_labels_round_half_even(spark):
    want = {428288: "418.2 KB", 428800: "418.8 KB", 1 << 20: "1.00 MB", 1234567: "1.18 MB", 131072 * 9: "1.12 MB"}
    df = spark.createDataFrame([(n,) for n in want], "n long").select("n", rules.size_label(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == want == {n: f"{n / 2**20:.2f} MB" if n >= 1 << 20 else f"{n / 1024:.1f} KB" for n in want}


def test_tool_version(spark):
    rows = spark.createDataFrame([("import os\nAPP_VERSION = \"1.4.2\"\nAPP_VERSION = \"9\"",), ("APP_VERSION='2'",), (" APP_VERSION = \"3\"",), ("MY_APP_VERSION=\"4\"",), ("x = 1",), (None,)], "value string")
    assert [r["version"] for r in history_json.tool_version(rows).collect()] == ["1.4.2", "", "", "", "", None]
    rows = spark.createDataFrame([("VERSION=\"5 b\"",)], "value string")
    assert history_json.tool_version(rows, name="VERSION").first()["version"] == "5 b"


def test_stream_upsert(spark, tmp_path):
    src, target = tmp_path / "in", tmp_path / "out"
    schema = "k int, ts double, v string"
    for i, rows in enumerate(([(1, 1.0, "a"), (1, 2.0, "b"), (5, 1.0, "e")], [(1, 3.0, "c"), (2, 1.0, "d")], [(1, 2.5, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream_upsert(spark.readStream.schema(schema).parquet(str(src)), str(target), ["k"], ["ts"], str(tmp_path / "cp"), buckets=4).awaitTermination()
    assert sorted(map(tuple, read_upserted(spark, str(target), schema).collect())) == [(1, 3.0, "c"), (2, 1.0, "d"), (5, 1.0, "e")]
    assert read_upserted(spark, str(tmp_path / "none"), schema).count() == 0
    left = sorted(str(p.relative_to(target)) for p in target.glob("v=*/bucket_=*"))
    versions = [json.loads(next((target / "manifest" / str(n)).glob("part*")).read_text()) for n in (1, 2)]
    assert left == sorted({f"v={v}/bucket_={b}" for m in versions for b, v in m.items()})


def test_running_values_over_blocks(spark):
    """A key of most rows, cut into many blocks, with runs that go on over several of them."""
    rng = random.Random(4)
    rows = [(7, i, float(v)) for i, v in enumerate([1] * 40 + [rng.randrange(3) for _ in range(60)] + [2] * 90 + [0])] + [(k, i, float(rng.randrange(3))) for k in (1, None) for i in range(5)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k int, at int, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        runs = {(r["k"], r["at"]): r["run"] for r in search.run_lengths(df, "k", ["at"], "v").collect()}
        hits = {(r["k"], r["at"]): (r["hits"], r["tripped"]) for r in search.guard_hits(df, "k", ["at"], F.col("v") == 2, 4).collect()}
        ends = {(r["k"], r["at"]): (r["under"], r["over"]) for r in search.running_bracket(df, "k", ["at"], "v", 1.5, 1.5).collect()}
        sums = {(r["k"], r["bucket"]): (r["first"], r["duration"]) for r in search.index_buckets(df, "k", ["at"], 7, "v", "at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in (7, 1, None):
        own, run, hit = [(i, v) for x, i, v in rows if x == k], 0, 0
        for n, (i, v) in enumerate(own):
            run = run + 1 if n and own[n - 1][1] == v else 1
            hit = hit + 1 if v == 2 else 0
            seen = [x for _, x in own[: n + 1]]
            assert runs[k, i] == run and hits[k, i] == (hit, hit >= 4)
            assert ends[k, i] == (max((x for x in seen if x < 1.5), default=None), min((x for x in seen if x > 1.5), default=None))
        assert all(sums[k, b] == (own[7 * b][0], max(20.0, sum(v for _, v in own[7 * b : 7 * b + 7]))) for b in range((len(own) + 6) // 7))


def score_of(p, h):
    return sum(abs(float(y) - float(x)) / max(float(x), 1.0) for x, y in zip(p, h))


def test_nearest_by_score(spark):
    """Against all rows: zeros, ties, exact ones, groups without rows, rows far from any probe, nulls."""
    rng = random.Random(6)
    draw = lambda: (rng.choice([0, 1, 7, rng.randrange(3000)]), rng.choice([0.0, 0.5, 2.0, rng.uniform(0, 90)]), rng.randrange(4) * 5)
    own = [(i, rng.choice("ab"), *draw(), i * 7 % 101) for i in range(400)]
    own += [(1000 + i, r[1], *r[2:5], 5) for i, r in enumerate(own[:40])] + [(2000, "a", None, 1.0, 5, 1), (2001, None, 1, 1.0, 5, 1)]
    probes = [(i, rng.choice("ab"), *draw()) for i in range(150)] + [(500 + i, *own[i][1:5]) for i in range(20)] + [(900, "c", 1, 1.0, 5), (901, "a", 10**7, 1e6, 0), (902, None, 1, 1.0, 5)]
    h = spark.createDataFrame(own, "entry long, kind string, w long, f double, d int, quality int").repartition(3)
    p = spark.createDataFrame(probes, "id long, kind string, w long, f double, d int").repartition(3)
    got = {r["id"]: (r["entry"], r["quality"], r["score"]) for r in predict.nearest_by_score(p, h, "kind", ["w", "f", "d"], "entry", ["entry", "quality"]).collect()}
    want = {}
    for i, kind, *x in probes:
        found = min(((score_of(x, r[2:5]), r[0], r[5]) for r in own if kind and r[1] == kind and None not in r[2:5]), default=None)
        if found:
            want[i] = (found[1], found[2], pytest.approx(found[0], abs=1e-12))
    assert got == want and 900 not in got and got[500][2] == 0


def test_nearest_by_score_meets_few_rows(spark, monkeypatch):
    """Probes of equal features are one, and what is stored stays near the size of the tables, whatever the levels."""
    seen, write = {}, predict.stored
    monkeypatch.setattr(predict, "stored", lambda df, name: (out := write(df, name), seen.__setitem__(name, seen.get(name, 0) + out.count()))[0])
    h = spark.range(6000).selectExpr("id as entry", "'a' as kind", "cast(id % 40 * 25 as int) as w", "cast(id * 7 % 50 as double) as f", "cast(id * 13 % 30 as double) as d")
    p = spark.range(3000).selectExpr("id", "'a' as kind", "cast(id % 10 * 100 + 3 as int) as w", "cast(id % 6 * 8 as double) as f", "cast(id % 5 * 6 as double) as d")
    got = predict.nearest_by_score(p, h, "kind", ["w", "f", "d"], "entry", ["entry"]).collect()
    assert len(got) == 3000 and seen["probes"] == 30 and sum(seen.values()) < 2 * 6000
    rows = [(r["entry"], r["w"], r["f"], r["d"]) for r in h.collect()]
    for r in got[::500]:
        x = (r["id"] % 10 * 100 + 3, r["id"] % 6 * 8, r["id"] % 5 * 6)
        assert r["entry"] == min((score_of(x, y[1:]), y[0]) for y in rows)[1]


def test_startup_plan(spark):
    """One probe for each rule: too few observations, a strong match, an exact one, tolerances, the band, sizes to cut to first."""
    cols = "width int, height int, frames int, init_mb double, quality int, method int, result_mb double, count long, timestamp double, resize_count int, final_width int, final_height int"
    rows = [
        (100, 100, 50, 20.0, 61, 1, 14.0, 1, 1.0, 0, None, None),  # strong though seen once
        (102, 98, 51, 20.1, 62, 2, 14.2, 5, 2.0, 0, None, None),
        (200, 100, 50, 20.0, 63, 1, 14.0, 1, 1.0, 0, None, None),  # seen once, near 202
        (300, 100, 50, 20.0, 64, 1, 15.5, 9, 1.0, 0, None, None),  # result out of the band
        (400, 100, 50, 20.2, 65, 1, 14.0, 2, 1.0, 1, 350, 90),
        (400, 100, 50, 20.2, 66, 1, 14.0, 2, 3.0, 2, 450, 90),  # later, but wider than the probe
        (500, 100, 50, 20.0, 67, 1, 13.6, 2, 1.0, 0, None, None),
        (500, 100, 50, 20.0, 68, 1, 14.3, None, 1.0, 0, None, None),  # nearer the middle
    ]
    probes = [(1, 100, 100, 50, 20.1), (2, 103, 100, 50, 20.0), (3, 202, 100, 50, 20.0), (4, 300, 100, 50, 20.0), (5, 400, 100, 50, 20.0), (6, 500, 100, 50, 20.0), (7, 100, 100, 50, 20.36), (8, 100, 100, 52, 20.0)]
    df = spark.createDataFrame(probes, "id int, width int, height int, frames int, init_mb double")
    got = {r["id"]: tuple(r)[1:] for r in predict.startup_plan(df, spark.createDataFrame(rows, cols)).collect()}
    seeded = int((14.245 / 20.0) ** 0.5 * 95 * 1.02)
    none = (seeded, None, False, None, None, None, f"default (no webp match, records=8, ratio-seeded q={seeded})")
    assert got[1] == (61, 1, True, 14.0, None, None, "webp stats (direct-final, records=8, count=1)")
    assert got[2] == (62, 2, False, 14.2, None, None, "webp stats (probe-guided, records=8, count=5)")
    assert got[3] == none and got[4] == none
    assert got[5] == (66, 1, False, 14.0, None, None, "webp stats (direct-final, records=8, count=2)")
    assert got[6] == (68, 1, True, 14.3, None, None, "webp exact stats (direct-final, records=8, count=1)")
    assert got[7][0] == 62  # over the tolerance for the strong one
    assert got[8][0] == 62  # frames within 3 per cent of 52 only there


def test_compact_of_numbers_needs_no_sort(spark):
    """One row is kept whole, also of rows of equal or of no order."""
    rng = random.Random(8)
    rows = [(rng.randrange(9), rng.choice([None, 1, 2, 3]) if i % 2 else None, i, i * 0.5 if i % 3 else None) for i in range(60)]
    got = history.compact(spark.createDataFrame(rows, "k int, at long, x long, y double").repartition(3), ["k"], ["at"])
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        own = [x for x in rows if x[0] == r["k"]]
        assert r["count"] == len(own) and (r["k"], r["at"], r["x"], r["y"]) in own
        assert r["at"] == max((x[1] for x in own if x[1] is not None), default=None)


def test_startup_plan_sends_no_probes_through_the_driver(spark):
    """Probes of one shape share a plan, and neither they nor what fits them is broadcast."""
    cols = "width int, height int, frames int, init_mb double, quality int, method int, result_mb double, count long, timestamp long, resize_count int, final_width int, final_height int"
    rows = [(100, 80, 30, 15.0 + k / 10, 70 + k, 1, 14.0 + k / 50, 2, k, 0, 0, 0) for k in range(4)]
    df = spark.createDataFrame([(i, 100, 80, 30, 15.0 + i % 2 * 0.22) for i in range(40)] + [(-1, 900, 80, 30, 15.0)], "id long, width int, height int, frames int, init_mb double")
    plan = predict.startup_plan(df, spark.createDataFrame(rows, cols))
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert tree.count("BroadcastExchange") <= 1  # the number of records
    got = {r["id"]: (r["quality"], r["direct_final"]) for r in plan.collect()}
    assert got == {i: (70 + i % 2 * 2, True) for i in range(40)} | {-1: (got[-1][0], False)}
