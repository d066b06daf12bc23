"""The driver contract and plan shapes."""

from datetime import datetime

import pytest

import __spark_entry__ as entry
from meshfield.plans import catalog


def test_names():
    q = entry.queries()
    assert set(catalog.queries()) <= set(q) and set(entry.oracle_sql()) <= set(q)
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert not without


def test_flagship(spark):
    assert entry.entry(spark).columns == ["pid", "v"]


#: Queries with work in Python: files are read by a Python source.
IN_PYTHON = {"classic_cdf_roundtrip", "ugrid_load", "sgrid_load", "sgrid_variables"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plans(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", *(() if name in IN_PYTHON else ("PythonUDF", "MapInPandas", "MapInArrow", "BatchEvalPython", "ArrowEvalPython"))):
        assert bad not in plan


def test_without_training_data(spark, monkeypatch):
    """Where that subpackage, or something that it needs, cannot be imported, all other queries are there."""
    import sys

    for name in [n for n in sys.modules if n.startswith("meshfield.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning, match="no training-data queries"):
        q = entry.queries()
    assert set(q) == set(catalog.queries())


def same_as_sql(spark, name, tmp_path, table, rows, schema):
    """The query's rows and its SQL's, on a table of these rows."""
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = con.execute(entry.oracle_sql()[name]).fetchall()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    return got


def test_trajectory_reaches_all_events(spark, tmp_path):
    """Values beyond the axis and below 0, times outside January, nulls: none is cut or changed to 0."""
    day = [datetime(2024, 1, 5, 7, 30, 1), datetime(2024, 1, 31, 23, 0), datetime(2024, 2, 1), datetime(2024, 2, 9, 3, 20), datetime(2023, 12, 30, 22, 10)]
    values = [0.0, 509.99, 510.0, 510.01, 560.21, 7000.5, -3.25, None]
    rows = [(11 * k + n, t, n % 3, v) for n, t in enumerate(day) for k, v in enumerate(values)] + [(999, None, 1, 5.0)]
    got = same_as_sql(spark, "trajectory_at", tmp_path, "events", rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    assert len(got) == len(rows) and all(v != 0 for *_, v, _ in got)


def test_points_on_shared_edges(spark, tmp_path):
    """On slanted sides and diagonals each face that holds a point by its areas has a row, as in the SQL; beside the mesh the nearest centroid counts."""
    on = [(n, a + 400.0 * i) for n in range(10) for a in (50 * n + 5, 250 * n + 25) for i in range(-5, 25)]
    rows = [(k, n, a) for k, (n, a) in enumerate([*on, (24, 800.0), (12, -999.99), (0, -300.0)])]
    got = same_as_sql(spark, "locate_or_nearest", tmp_path, "customer", rows, "c_custkey long, c_nationkey int, c_acctbal double")
    assert len(got) > len(rows) == len({r[0] for r in got})
