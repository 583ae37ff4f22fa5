"""Every registered query against its SQL, on the smallest fixture."""

import pytest

from marlstone import plans

from .oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, plans.queries()[name], plans.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", ["scale_cascade", "size_cascade"])
def test_parts_stay_out_of_the_driver(spark, name):
    """Neither parts nor their neighbours are broadcast, however small Spark takes them to be."""
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["scale_cascade", "size_cascade"])
def test_parts_meet_their_profiles_once(spark, name):
    """Parts are read and shuffled by shape alone, not once more by key to get what their shape found."""
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("part.parquet") == 1


@pytest.mark.parametrize("name", ["neighbor_profile", "scale_cascade", "size_cascade"])
def test_parts_of_one_key_share_a_profile(spark, name, tmp_path):
    """A key that occurs in several rows has the neighbours of all of them; in the cascades a null key has none."""
    import duckdb

    for t in TABLES:
        if t != "part":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    again = "SELECT p_partkey - 30 AS p_partkey, * EXCLUDE (p_partkey) FROM p WHERE p_partkey BETWEEN 30 AND 90 UNION ALL SELECT * FROM p WHERE p_partkey < 40"
    none = "SELECT CAST(NULL AS BIGINT), * EXCLUDE (p_partkey) FROM p WHERE p_partkey % 7 = 0"
    duckdb.execute(f"COPY (WITH p AS (SELECT * FROM '{SF}/part.parquet') SELECT * FROM p UNION ALL {again} UNION ALL {none}) TO '{tmp_path}/part.parquet'")
    compare(spark, plans.queries()[name], plans.oracle_sql()[name], str(tmp_path))


def test_neighbours_are_parts_of_any_brand_and_type(spark):
    """Every part within the tolerances of size and price is a neighbour, by the reference's rule and not by the SQL."""
    import duckdb

    rows = duckdb.sql(f"SELECT p_partkey, p_size, p_retailprice FROM '{SF}/part.parquet'").fetchall()
    want = {k: sum(abs(z - s) <= 8 and abs(q - p) / p <= 0.15 for _, z, q in rows) for k, s, p in rows}
    assert {r["partkey"]: r["n"] for r in plans.queries()["neighbor_profile"](spark, SF).collect()} == want


def test_neighbours_at_odd_prices(spark, tmp_path):
    """Prices of 0 and below, without a value, not finite, tiny and huge agree with the SQL."""
    import duckdb

    for t in TABLES:
        if t != "part":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    odd = "0.0, -90.0, -95.0, -600.0, NULL, 'nan'::DOUBLE, 'inf'::DOUBLE, 1e-300, 1.1e-300, 1e-12, 1e306, 1.1e306, 20.0, 23.0".split(", ")
    price = "CASE p_partkey " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(odd, 1)) + " ELSE p_retailprice END AS p_retailprice"
    size = "CASE WHEN p_partkey IN (2, 3, 4) THEN 30 WHEN p_partkey = 7 THEN 1000 WHEN p_partkey < 15 THEN 5 WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END::INT AS p_size"
    duckdb.execute(f"COPY (SELECT * REPLACE ({price}, {size}) FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    compare(spark, plans.queries()["neighbor_profile"], plans.oracle_sql()["neighbor_profile"], str(tmp_path))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    def gone(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    assert set(entry.queries()) == set(plans.queries()) and set(entry.oracle_sql()) == set(plans.oracle_sql())
