"""Goldens and properties of the mesh operators."""

import math
import warnings
from datetime import datetime, timedelta

import numpy as np
import pyspark.sql.functions as F
import pytest

from meshfield.functions import expressions as ex
from meshfield.functions import timefn
from meshfield.operators import depth, join, rgrid, sgrid, ugrid
from meshfield.operators.field import Dataset, Field, QuadGrid, RectGrid, TriGrid, VectorField, point_rows, regrid
from meshfield.operators.timeaxis import TimeAxis, TimeSeriesError, bracket_join, check_axis
from meshfield.sources import cdf, metadata, verdat
from meshfield.streaming import points as stream

# This mesh, the vectors in test_vectors, the axes in test_rgrid and the text of axes in test_parsers, with the results that they have elsewhere.
NODES = [(0, 0.1, 0.1), (1, 2.1, 0.1), (2, 1.1, 2.1), (3, 3.1, 2.1)]
FACES = [(0, [0, 1, 2]), (1, [1, 3, 2])]


@pytest.fixture(scope="module")
def mesh(spark):
    return spark.createDataFrame(NODES, "node int, lon double, lat double"), spark.createDataFrame(FACES, "face int, nodes array<int>")


def pts(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "pid long, lon double, lat double")


def column(df, *names):
    rows = sorted(df.collect(), key=lambda r: r.pid)
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


# ---- expressions


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_vectors(spark):
    got = [value(spark, ex.vector_sum(F.lit(float(x)), F.lit(float(y)))) for x, y in ((3, 4), (5, 12), (9, 40), (11, 60))]
    assert got == [5, 13, 41, 61]
    x, y = ex.rotate(F.lit(1.0), F.lit(0.0), F.lit(math.pi / 2))
    assert (value(spark, x), value(spark, y)) == pytest.approx((0, 1))
    assert value(spark, ex.bearing(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0))) == pytest.approx(270)
    assert value(spark, ex.wrap_longitude(F.lit(-10.0), positive=True)) == 350
    assert value(spark, ex.pair(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))) == [[1, 3], [2, 4]]


@pytest.mark.parametrize("n", [5, 100])
def test_digitize(spark, n):
    axis = np.cumsum(np.arange(1, n + 1)).astype(float)
    xs = [*axis, *(axis + 0.5), -1.0, 1e9]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for right in (False, True):
        got = [r.v for r in df.select(ex.digitize(F.col("x"), axis, right).alias("v")).collect()]
        assert got == np.searchsorted(axis, xs, "left" if right else "right").tolist()


def test_mask_policies(spark):
    v = lambda *a: [F.lit(x).cast("double") for x in a]
    w = v(0.5, 0.5)
    run = lambda p, *a: value(spark, ex.with_mask_policy(v(*a), w, p))
    assert run("zero", 2, None) == 1 and run("zero", None, None) == 0
    assert run("mask", 2, None) is None and run("mask", 2, 4) == 3
    assert run("skip", None, None) is None and run("skip", 2, None) == 1
    assert run("mirror", 2, None) == 0 and run("mirror", None, None) is None
    with pytest.raises(ValueError):
        ex.with_mask_policy(v(1, 2, 3), v(1, 1, 1), "mirror")
    with pytest.raises(ValueError):
        ex.with_mask_policy(v(1), v(1), "no")


# ---- rectilinear


def test_rgrid(spark):
    xs, ys = (0, 10, 20, 30, 40, 55), (0, 2, 3, 4, 5, 7, 9)
    got = column(rgrid.locate(pts(spark, [(5, 1), (-1, 0), (42, 0), (55, 1), (5, 9)]), xs, ys), "j", "i")
    assert got == [(0, 0), (-1, -1), (0, 4), (-1, -1), (-1, -1)]
    xs, ys = (0, 1, 2, 5, 12), (0, 1, 2, 12)
    field = rgrid.node_points(spark, xs, ys).select("j", "i", F.col("i").cast("double").alias("value"))
    p = pts(spark, [(0.5, 0.5), (3.5, 2), (-1, 0), (13, 0), (12, 12)])
    assert column(rgrid.interpolate(p, field, xs, ys), "value") == [0.5, 2.5, 0, 0, 4]
    assert column(rgrid.interpolate(p, field, xs, ys, "nearest"), "value")[1] == 2
    with pytest.raises(ValueError):
        rgrid.interpolate(p, field, xs, ys, "cubic")
    assert rgrid.orientation(["lat", "lon"], (3, 4), "lon", "lat", 4, 3) == "yx"
    assert rgrid.orientation(None, (4, 3), None, None, 4, 3) == "xy"
    with pytest.raises(ValueError):
        rgrid.orientation(None, (3, 3), None, None, 3, 3)


# ---- unstructured


def test_locate_and_weights(spark, mesh):
    nodes, faces = mesh
    p = pts(spark, [(1.1, 1.0), (2.1, 1.5), (0, 0), (3.0, 0.2)])
    at = ugrid.locate(p, faces, nodes)
    assert column(at, "face") == [0, 1, None, None]
    w = ugrid.weights(at, faces, nodes)
    for r in w.collect():
        if r.face is not None:
            own = {k: (x, y) for k, x, y in NODES}
            assert sum(r[f"w{k}"] for k in range(3)) == pytest.approx(1)
            assert sum(r[f"w{k}"] * own[r[f"n{k}"]][0] for k in range(3)) == pytest.approx(r.lon)
    plan = at._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan and "PythonUDF" not in plan


def test_clockwise_and_masked(spark, mesh):
    nodes, _ = mesh
    faces = spark.createDataFrame([(0, [2, 1, 0]), (1, [2, 3, 1])], "face int, nodes array<int>")
    p = pts(spark, [(1.1, 1.0), (2.1, 1.5), (9, 9)])
    assert column(ugrid.locate(p, faces, nodes), "face") == [0, 1, None]
    field = nodes.select("node", F.when(F.col("node") != 3, F.col("lon") + 2 * F.col("lat")).alias("value"))
    assert column(ugrid.interpolate_nodes(p, faces, nodes, field), "value") == [pytest.approx(3.1), None, 0.0]


def test_topology(spark, mesh):
    nodes, faces = mesh
    assert {(r.n0, r.n1) for r in ugrid.edges(faces).collect()} == {(0, 1), (1, 3), (2, 3), (0, 2), (1, 2)}
    assert {(r.n0, r.n1) for r in ugrid.boundaries(faces).collect()} == {(0, 1), (2, 0), (1, 3), (3, 2)}
    assert {(r.face, r.slot, r.other) for r in ugrid.neighbours(faces).collect()} == {(0, 0, None), (0, 1, 1), (0, 2, None), (1, 0, None), (1, 1, None), (1, 2, 0)}
    edge = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 2, 0), (3, 1, 3), (4, 3, 2)], "edge int, n0 int, n1 int")
    got = {}
    for r in ugrid.face_edge_ids(faces, edge).orderBy("face", "slot").collect():
        got.setdefault(r.face, []).append(r.edge)
    assert got == {0: [0, 1, 2], 1: [3, 4, 1]}
    ragged = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [1, 2, 4])], "face int, nodes array<int>")
    assert ugrid.face_edges(ragged).count() == 7
    assert {(round(r.lon, 3), round(r.lat, 3)) for r in ugrid.centroids(faces, nodes).collect()} == {(1.1, 0.767), (2.1, 1.433)}


def test_face_checks(spark):
    one = spark.createDataFrame([(0, [1, 2, 3])], "face int, nodes array<int>")
    assert ugrid.checked_faces(one, 3).first().nodes == [0, 1, 2]
    assert ugrid.checked_faces(one, 9).first().nodes == [1, 2, 3]
    with pytest.raises(ValueError):
        ugrid.checked_faces(one, 2)
    with pytest.raises(ValueError):
        ugrid.check_connectivity(spark.createDataFrame([(0, 0), (0, 1)], "face int, slot int"), one)
    assert [ugrid.infer_location(n, 4, 2, 5) for n in (4, 2, 5, 7)] == ["node", "face", "boundary", None]


def test_mesh_object(spark, mesh):
    m = ugrid.Mesh(*mesh)
    assert m.drop("nodes").faces is None and m.drop("edges").faces is not None
    assert m.same(ugrid.Mesh(*mesh)) and not m.same(ugrid.Mesh(mesh[0], mesh[1].where("face = 0")))
    assert m.info()["num_vertices"] == 3


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(1)
    n, p = r.normal(0, 5, (200, 2)), r.normal(0, 12, (300, 2))
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(n)], "node long, lon double, lat double")
    want = ((p[:, None] - n[None]) ** 2).sum(2).argmin(1).tolist()
    assert column(join.nearest(pts(spark, p), nodes), "node") == want
    assert column(join.nearest(pts(spark, p[:2]), nodes.limit(0)), "node") == [None, None]
    one = nodes.where("node = 5")
    assert column(join.nearest(pts(spark, p[:3]), one), "node") == [5] * 3


def test_rings(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    seg = [(3, 4), (0, 1), (2, 0), (1, 2), (4, 5), (9, 8), (8, 7)]
    got = {}
    for r in ugrid.order_rings(spark.createDataFrame(seg, "n0 long, n1 long")).orderBy("ring", "place").collect():
        got.setdefault((r.ring, r.closed), []).append(r.node)
    assert got == {(0, True): [0, 1, 2], (3, False): [3, 4, 5], (7, False): [7, 8, 9]}


# ---- curvilinear


def ji(spark, nj, ni):
    return spark.createDataFrame([(j, i) for j in range(nj) for i in range(ni)], "j int, i int")


def test_closed_triangles(spark):
    """Edges and corners belong to every triangle that has them, in any orientation, and to none that has no area; without closed a point has one cell."""
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 0.0, 2.0)], "node int, lon double, lat double")
    faces = spark.createDataFrame([(0, [0, 1, 2]), (1, [0, 3, 2]), (2, [0, 2, 2])], "face int, nodes array<int>")
    points, cells = pts(spark, [(1, 1), (2, 2), (2, 1), (0, 1), (1.5, 0.5), (3, 1), (5, 5)]), ugrid.cells(faces, nodes)
    rows = lambda df: sorted((r.pid, -1 if r.cell is None else r.cell) for r in df.collect())
    want = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, -1), (6, -1)]
    assert rows(join.locate(points, cells, closed=True)) == want
    assert len(rows(join.locate(points, cells))) == 7
    near = ugrid.centroids(faces, nodes).select(F.col("face").cast("long").alias("node"), "lon", "lat").where("node < 2")
    assert rows(join.locate_or_nearest(points, cells, near, closed=True)) == [*want[:7], (5, 0), (6, 0)]
    with pytest.raises(ValueError):
        join.locate(points, spark.sql("select 0L cell, array(named_struct('lon', 0d, 'lat', 0d), named_struct('lon', 1d, 'lat', 0d), named_struct('lon', 1d, 'lat', 1d), named_struct('lon', 0d, 'lat', 1d)) poly"), closed=True)


def test_half_open_cells(spark):
    nodes = ji(spark, 3, 3).select("j", "i", (1 + 2.0 * F.col("i")).alias("lon"), (1 + 2.0 * F.col("j")).alias("lat"))
    cell = sgrid.cells(nodes)
    got = column(sgrid.locate(pts(spark, [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]), cell), "j", "i")
    assert got == [(None, None), (0, 0), (0, 0), (1, 1), (1, 1), (None, None), (None, None)]


def test_inverse_bilinear_is_stable(spark):
    r = np.random.default_rng(2)
    rows, want = [], []
    for k in range(400):
        a = r.uniform(0, 2 * np.pi)
        base = np.array([[0, 0], [0, 1], [1, 1], [1, 0]]) + (r.uniform(-0.2, 0.2, (4, 2)) if k % 2 else 0)
        if k % 4 == 2:
            a = np.pi / 2
        q = base @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + r.uniform(-50, 50, 2)
        ll, m = r.uniform(0.02, 0.98, 2)
        w = np.array([1 - ll - m + ll * m, m - ll * m, ll * m, ll - ll * m])
        x, y = w @ q
        rows.append((k, k, 0, float(x), float(y), *map(float, q[:, 0]), *map(float, q[:, 1])))
        want.append((ll, m))
    df = spark.createDataFrame(rows, "pid long, j int, i int, lon double, lat double, " + ", ".join(f"{c}{k} double" for c in "xy" for k in range(4)))
    co = {}
    for name, c in (("a", "x"), ("b", "y")):
        p = [F.col(f"{c}{k}") for k in range(4)]
        co |= {f"{name}0": p[0], f"{name}1": p[3] - p[0], f"{name}2": p[1] - p[0], f"{name}3": p[0] - p[1] + p[2] - p[3]}
    cell = df.withColumns(co).select("j", "i", *co)
    got = column(sgrid.with_logical(df.select("pid", "j", "i", "lon", "lat"), cell), "l", "m")
    assert np.abs(np.array(got) - np.array(want)).max() < 1e-7


def test_sgrid_inference():
    assert [sgrid.infer_location(s, (5, 7)) for s in ((5, 7), (6, 8), (6, 7), (5, 8), (9, 9))] == ["node", "center", "edge1", "edge2", None]
    assert [sgrid.infer_padding(n, 5) for n in (6, 5, 4)] == ["both", "low", "none"]
    assert [sgrid.shift_for(p) for p in ("none", "low", "high", "both")] == [0, 1, 0, 1]
    with pytest.raises(ValueError):
        sgrid.shift_for("odd")


# ---- time


def test_time_axis(spark):
    t0 = datetime(2023, 11, 28, 12)
    axis = TimeAxis(tuple(t0 + timedelta(minutes=15 * k) for k in range(10)))
    q = [t0, t0 + timedelta(minutes=15), t0 + timedelta(minutes=22.5), t0 + timedelta(minutes=135), t0 - timedelta(1), t0 + timedelta(1)]
    df = spark.createDataFrame(list(enumerate(q)), "pid long, t timestamp_ntz")
    df = df.withColumn("k", axis.index(F.col("t")))
    assert column(df, "k") == [0, 1, 2, 9, 0, 10]
    assert column(df.withColumn("a", axis.alpha(F.col("t"), F.col("k"))), "a") == [0, 1, 0.5, 1, 0, 1]
    assert column(df.withColumn("ok", axis.in_bounds(F.col("t"))), "ok") == [True] * 4 + [False] * 2
    assert column(axis.bracket(df, strict=False), "t_lo", "t_hi", "t_alpha")[2:] == [(1, 2, 0.5), (9, 9, 0), (None, None, None), (None, None, None)]
    assert column(axis.bracket(df, extrapolate=True), "t_lo")[4:] == [0, 9]
    with pytest.raises(Exception, match="out of range"):
        axis.bracket(df).collect()
    with pytest.raises(TimeSeriesError):
        TimeAxis((t0, t0))
    with pytest.raises(TypeError):
        TimeAxis((1,))
    moved = axis.displace(1)
    assert moved.min_time == t0 + timedelta(hours=1)
    with pytest.raises(AttributeError):
        moved.displace(1)
    assert TimeAxis((t0,), -7).with_offset(-3).min_time == t0 + timedelta(hours=4)
    assert axis.with_origin(datetime(2000, 1, 1)).max_time == datetime(2000, 1, 1, 2, 15)
    assert len(TimeAxis.constant()) == 1 and len(TimeAxis(())) == 1
    assert TimeAxis.of(axis.table(spark)).times == axis.times
    check_axis(axis.table(spark))
    with pytest.raises(TimeSeriesError):
        check_axis(axis.table(spark).withColumn("t_idx", -F.col("t_idx")))


def test_bracket_join_over_gaps(spark):
    t0 = datetime(2024, 1, 1)
    s = spark.createDataFrame([(t0 + timedelta(days=d), float(d)) for d in (0, 0.5, 9, 30)], "t timestamp_ntz, value double")
    p = spark.createDataFrame([(k, t0 + timedelta(days=d)) for k, d in enumerate((-1, 0, 0.25, 0.5, 3, 9.5, 31))], "pid long, t timestamp_ntz")
    assert column(bracket_join(p, s), "lo", "hi") == [(None, 0), (None, 0), (0, 0.5), (0, 0.5), (0.5, 9), (9, 30), (30, None)]


@pytest.mark.parametrize(("offset", "units", "name"), [(0, "days since 2024-1-1T00:00:00Z", "UTC"), (0, "days since 2024-1-1T00:00:00+00:00", "UTC"), (None, "days since 2024-1-1T00:00:00", None), (-7, "days since 2024-1-1T00:00:00-7:00", "-07:00"), (3.5, "days since 2024-1-1T00:00:00+3:30", "+03:30"), (0, "hours since 2024-1-1 00:00:00 UTC", "UTC")])
def test_time_offsets(offset, units, name):
    assert timefn.parse_offset(units) == (offset, name)


def test_time_units(spark):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert timefn.parse_offset("days since 2024-1-1T00:00:00 nowhere/land") == (None, None)
    assert seen
    assert timefn.offset_text(None) == "" and timefn.offset_text(-8) == "-08:00"
    assert value(spark, timefn.decode(F.lit(1.5), "days since 2024-1-1T06:00:00.5")) == datetime(2024, 1, 2, 18, 0, 0, 500000)
    with pytest.raises(ValueError):
        timefn.parse_units("fortnights since 2000-1-1")


# ---- depth


def zs(spark, values):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "pid long, z double")


def test_levels(spark):
    up, down = depth.Levels((0, 1, 2, 4, 6, 10), bottom="extrapolate"), depth.Levels((10, 6, 4, 2, 1, 0), bottom="extrapolate")
    df = zs(spark, [20, 10, 4.5, 1, 0.4, 0, -1])
    assert column(df.withColumn("k", down.index(F.col("z"))), "k") == [-1, 0, 1, 4, 4, 5, 5]
    k, a = up.weights(F.col("z"))
    got = column(df.withColumns({"k": k, "a": a}), "k", "a")
    assert got == [(5, 0), (5, 0), (3, 0.25), (1, 0), (0, 0.4), (0, 0), (-1, 1)]
    k, a = depth.Levels((0, 1, 2, 4, 6, 10), surface="mask").weights(F.col("z"))
    assert column(df.withColumn("k", k), "k") == [None, None, 3, 1, 0, 0, None]
    assert depth.Levels.loaded((0.5, 3.0)).depths == (0.0, 3.0)
    assert (down.surface_index, down.bottom_index) == (5, 0)
    with pytest.raises(ValueError):
        depth.Levels((0, 1), bottom="no")


def test_profiles(spark):
    rows = [(0, 60.0, [100.0, 50.0, 20.0, 0.0]), (1, 4.0, [10.0, 5.0, 2.0, 0.0]), (2, 10.0, [40.0, 20.0, 8.0, 0.0]), (3, 5.0, [None, 1.0, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "pid long, z double, p array<double>")
    k, a = depth.in_profile(F.col("z"), F.col("p"))
    got = column(df.withColumns({"k": k, "a": a}), "k", "a")
    assert got[3] == (None, None)
    assert got[:3] == [(0, pytest.approx(0.8)), (1, pytest.approx(1 / 3)), (1, pytest.approx(5 / 6))]
    one = zs(spark, [11, 10, 9, 5, 2, 1, 0, -1]).withColumn("p", F.array(*map(F.lit, (10.0, 5.0, 2.0, 0.0))))
    k, a = depth.in_profile(F.col("z"), F.col("p"), bottom="extrapolate")
    assert column(one.withColumns({"k": k}), "k") == [-1, -1, 0, 0, 1, 2, 2, 3]


def test_boundary_conditions(spark):
    df = spark.createDataFrame([(k, i) for k, i in enumerate((-1, 0, 2, 3, None))], "pid long, i int")
    for s in depth.CONDITIONS:
        for b in depth.CONDITIONS:
            k, a = depth.bounded(F.col("i"), F.lit(0.5), 0, 3, s, b)
            got = column(df.withColumns({"k": k, "a": a}), "k", "a")
            assert got[0] == ((-1, 1.0) if s == "extrapolate" else (None, None))
            assert got[3] == ((3, 0.0) if b == "extrapolate" else (None, None))
            assert got[1:3] == [(0, 0.5), (2, 0.5)] and got[4] == (None, None)
            k, a = depth.bounded(F.col("i"), F.lit(0.5), 3, 0, s, b)
            got = column(df.withColumns({"k": k, "a": a}), "k", "a")
            assert got[3] == ((3, 0.0) if s == "extrapolate" else (None, None))
            assert got[0] == ((-1, 1.0) if b == "extrapolate" else (None, None))


# ---- fields


AXIS = TimeAxis(tuple(datetime(2020, 1, 1) + timedelta(hours=6 * k) for k in range(4)))
LEVELS = depth.Levels((0.0, 5.0, 10.0))


def affine(grid, spark, **kw):
    data = grid.targets(spark).withColumn("t_idx", F.explode(F.array(*map(F.lit, range(4))))).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    return Field("f", grid, data.select("elem", "t_idx", "k", (2 * F.col("lon") - F.col("lat") + 6 * F.col("t_idx") + 5 * F.col("k")).alias("value")), AXIS, LEVELS, **kw)


def grids(spark):
    nodes = ji(spark, 6, 8).select("j", "i", (F.col("i") + 0.3 * F.col("j")).alias("lon"), (F.col("j") - 0.1 * F.col("i")).alias("lat"))
    flat = nodes.select((F.col("j") * 8 + F.col("i")).alias("node"), "lon", "lat")
    faces = [(2 * (j * 7 + i) + s, [j * 8 + i, j * 8 + i + 1, j * 8 + i + 9] if s == 0 else [j * 8 + i, j * 8 + i + 9, j * 8 + i + 8]) for j in range(5) for i in range(7) for s in (0, 1)]
    return [RectGrid(tuple(map(float, range(9))), tuple(map(float, range(6)))), QuadGrid(nodes), TriGrid(spark.createDataFrame(faces, "face int, nodes array<int>"), flat)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_affine_fields_are_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(join, "BROADCAST_ROWS", limit)  # looked up, or shuffled
    r = np.random.default_rng(3)
    rows = [(k, float(r.uniform(2, 5)), float(r.uniform(1, 3)), float(r.uniform(0, 9.9)), datetime(2020, 1, 1) + timedelta(hours=float(r.uniform(0, 18)))) for k in range(50)]
    p = spark.createDataFrame(rows, "pid long, lon double, lat double, z double, t timestamp_ntz")
    want = [2 * x - y + (t - datetime(2020, 1, 1)).total_seconds() / 3600 + z for _, x, y, z, t in rows]
    for g in grids(spark):
        got = column(affine(g, spark).at(p), "f")
        assert got == pytest.approx(want)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_off_grid_and_masks(spark, monkeypatch, limit):
    monkeypatch.setattr(join, "BROADCAST_ROWS", limit)
    p = spark.createDataFrame([(0, 99.0, 99.0, 1.0, datetime(2020, 1, 1)), (1, 3.0, 2.0, 50.0, datetime(2020, 1, 1)), (2, 3.0, 2.0, -5.0, datetime(2020, 1, 1))], "pid long, lon double, lat double, z double, t timestamp_ntz")
    for g, off in zip(grids(spark), (0.0, None, 0.0), strict=True):
        got = column(affine(g, spark).at(p), "f")
        assert got[0] == off and got[1] is None and got[2] == pytest.approx(4.0)
    assert column(affine(grids(spark)[1], spark, fill_value=-1.0).at(p, unmask=True), "f")[0] == -1
    sparse = affine(grids(spark)[0], spark)
    sparse = Field("f", sparse.grid, sparse.data.where("not (t_idx = 1 and k = 0)"), AXIS, LEVELS)
    q = p.withColumns({"lon": F.lit(3.0), "lat": F.lit(2.0), "z": F.lit(1.0), "t": F.expr("t + make_dt_interval(0, pid * 6)")})
    assert column(sparse.at(q), "f") == [pytest.approx(5.0), None, None]  # a bracket on a node reads its other side too


def test_vector_slices_and_info(spark):
    g = grids(spark)[0]
    f = affine(g, spark)
    with pytest.raises(ValueError):
        VectorField({"u": f})
    p = spark.createDataFrame([(0, 1.0, 1.0)], "pid long, lon double, lat double")
    flat = f.sliced(2, 1)
    assert column(flat.at(p), "f") == [2 - 1 + 12 + 5]
    uv = VectorField({"u": flat, "v": flat})
    assert column(uv.at(p), "u", "v") == [(18, 18)] and uv.units is None
    assert f.info()["times"] == 4
    assert column(Field.constant(spark, 7.5).at(p), "constant") == [7.5]
    ds = Dataset(g, {"f": f, "g": Field("g", g, flat.data, attributes={"kind": "x"})}, {"title": "t"})
    assert ds["f"] is f and [v.name for v in ds.by_attribute("kind", "x")] == ["g"] and ds.info()["grid"] == "RectGrid"
    with pytest.raises(ValueError):
        Field("f", g, f.data)


def test_regrid(spark):
    a, b, c = grids(spark)
    for target in (b, c):
        out = regrid(affine(a, spark).sliced(k=0), target, spark)
        own = target.targets(spark).withColumnRenamed("elem", "e")
        for r in out.data.join(own, out.data.elem == own.e).collect():
            assert r.value == pytest.approx(2 * r.lon - r.lat + 6 * r.t_idx)
    with pytest.raises(ValueError):
        regrid(affine(a, spark), RectGrid((100.0, 101.0), (100.0, 101.0)), spark)


def test_point_rows(spark):
    assert point_rows(spark, (1, 2)).count() == 1
    assert point_rows(spark, np.zeros((3, 3))).columns == ["pid", "lon", "lat", "z"]
    assert point_rows(spark, np.zeros((2, 9))).count() == 9
    with pytest.raises(ValueError):
        point_rows(spark, np.zeros((5, 5)))
    with pytest.raises(TypeError):
        point_rows(spark, ["a", "b"])


def test_stream(spark, tmp_path):
    rows = [(k, 1.0 + k, 2.0, 1.0, datetime(2020, 1, 1, k)) for k in range(5)]
    spark.createDataFrame(rows, "pid long, lon double, lat double, z double, t timestamp").write.parquet(str(tmp_path / "in"))
    f = affine(grids(spark)[0], spark)
    live = stream.at(f, stream.read_points(spark, str(tmp_path / "in")))
    stream.write(live, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = column(spark.read.parquet(str(tmp_path / "out")), "f")
    assert got == pytest.approx([2 * x - y + t.hour + z for _, x, y, z, t in rows])


# ---- files


@pytest.mark.parametrize("version", [1, 2, 5])
def test_cdf_round_trip(spark, tmp_path, version):
    path = str(tmp_path / "a.nc")
    t = np.arange(6, dtype="f8").reshape(3, 2)
    cdf.write(path, {"time": None, "x": 2}, {"v": (("time", "x"), t, {"units": "m", "_FillValue": 4.0}), "w": (("time",), np.array([1, 2, 3], "i2"), {}), "x": (("x",), np.array([7, 8]), {"a": [1, 2]}), "s": ((), np.float64(5), {})}, {"title": "T"}, version)
    h = cdf.read_header(path)
    assert h.unlimited == "time" and h.n_records == 3 and h.attrs == {"title": "T"} and h.variables["x"].attrs == {"a": [1, 2]}
    assert (cdf.read_values(path, h, "v") == t).all() and cdf.read_values(path, h, "w").tolist() == [1, 2, 3] and cdf.read_values(path, h, "s") == 5
    got = {tuple(r.idx): r.value for r in cdf.load_variable(spark, path, "v").collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3, (2, 0): None, (2, 1): 5}
    assert cdf.load_variable(spark, path, "v").where("t_idx = 1").count() == 2
    two = cdf.load_variable(spark, [path, path], "w")
    assert sorted((r.t_idx, r.value) for r in two.collect()) == [(k, k % 3 + 1) for k in range(6)]
    dims, variables, attrs = cdf.metadata(spark, path)
    assert {(r.name, r.size, r.unlimited) for r in dims.collect()} == {("time", 3, True), ("x", 2, False)}
    assert variables.where("name = 'v'").first().attrs["units"] == "m" and attrs["title"] == "T"
    with pytest.raises(ValueError):
        cdf.parse_header(b"HDF\x01")


VERDAT = "DOGS FEET\n" + "\n".join(f"{k}, {k * 0.5}, {k * 0.25}, {k * 1.0}" for k in range(1, 12)) + "\n0, 0.0, 0.0, 0.0\n2\n5\n9\n"


def test_verdat(spark, tmp_path):
    units, rows, segments = verdat.parse(VERDAT)
    assert units == "ft" and len(rows) == 11
    assert segments == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 6), (6, 7), (7, 8), (8, 5)]
    assert verdat.parse(VERDAT.replace(" FEET", ""))[0] is None
    with pytest.raises(ValueError):
        verdat.parse("CATS\n")
    (tmp_path / "x.verdat").write_text(VERDAT)
    units, nodes, bounds = verdat.load(spark, str(tmp_path / "x.verdat"))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    rings = ugrid.order_rings(bounds.select(F.col("n0").cast("long"), F.col("n1").cast("long")))
    verdat.save(nodes, rings, str(tmp_path / "out"), units)
    again = verdat.load(spark, str(tmp_path / "out"))
    assert again[0] == "ft" and again[1].orderBy("node").collect() == nodes.orderBy("node").collect() and again[2].count() == 9


# ---- metadata


M = metadata.Meta


def test_grid_types():
    lon1, lon2 = M(("x",), (4,)), M(("y", "x"), (3, 4))
    assert metadata.grid_type({}, grid_type="ROMS") == "S" and metadata.grid_type({}, grid_type="regular") == "R"
    with pytest.raises(ValueError):
        metadata.grid_type({}, grid_type="cube")
    assert metadata.grid_type({}, grid_topology={"faces": "nv"}) == "U" and metadata.grid_type({}, grid_topology={"node_lon": "x"}) == "S"
    assert metadata.grid_type({}, {"grid_type": "UGRID"}) == "U"
    assert metadata.grid_type({"m": M(attrs={"cf_role": "mesh_topology", "node_coordinates": "a b"})}) == "U"
    assert metadata.grid_type({"m": M(attrs={"cf_role": "grid_topology", "node_coordinates": "a b", "node_dimensions": "x y"})}) == "S"
    assert metadata.grid_type({"lon": lon1, "lat": lon1}) == "R" and metadata.grid_type({"lon": lon2, "lat": lon2}) == "S" and metadata.grid_type({"lon": lon1, "lat": lon1, "nv": lon2}) == "U"
    with pytest.raises(ValueError):
        metadata.grid_type({"a": lon1})


def test_finders():
    v = {"lon_psi": M(("y", "x"), attrs={"standard_name": "longitude"}), "lat_psi": M(("y", "x"), attrs={"standard_name": "latitude"}), "lon_rho": M(), "lat_rho": M(), "mask_rho": M(), "u": M(("time", "y"), attrs={"location": "edge1"}), "temp": M(("time", "z"), attrs={"long_name": "Temperature"})}
    assert metadata.node_pair(v) == ("lon_psi", "lat_psi") and metadata.staggered_names(v) == {"center_lon": "lon_rho", "center_lat": "lat_rho", "center_mask": "mask_rho"}
    assert metadata.coordinates_of(v, ("y", "x")) == ("lon_psi", "lat_psi")
    assert metadata.time_variable(v, "u") == "time"
    assert metadata.by_attributes(v, location="edge1") == ["u"]
    assert metadata.search(v, {"T": ["temp9"], "U": ["u"], "Q": ["q"]}, {"T": ["temperature"]}) == {"T": "temp", "U": "u", "Q": None}
    assert metadata.merged({"a": None, "b": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 1}
    assert metadata.default_name(v, ["u"]) == "u"
    with pytest.raises(ValueError):
        metadata.default_name(v, ["none"])
    assert metadata.discovered(v, lambda m: None) == {"u": ("u", "edge1")}
    assert metadata.faces_layout((3, 9), 1, 12, 12) == (True, 1) and metadata.faces_layout((9, 3), 0, 11, 12) == (False, 0)
    mesh = {"m": M(attrs={"cf_role": "mesh_topology", "topology_dimension": 2}), "n": M(attrs={"cf_role": "mesh_topology", "topology_dimension": 3})}
    assert metadata.the_mesh(mesh) == "m"
    with pytest.raises(ValueError):
        metadata.the_mesh({})
    assert metadata.depth_kind({"depth": M()}) == "levels"
    with pytest.warns(RuntimeWarning):
        assert metadata.depth_kind({}) == "surface"
    with pytest.raises(ValueError):
        metadata.depth_kind(dict.fromkeys(["depth", "siglay", "siglev", "h"], M()))


def test_parsers():
    assert metadata.parse_padding("xi_rho: xi_psi (padding: both) eta_rho: eta_psi (padding: low)") == [("xi_rho", "xi_psi", "both"), ("eta_rho", "eta_psi", "low")]
    with pytest.raises(ValueError):
        metadata.parse_padding("nothing")
    assert metadata.parse_axes("X: NMAX Y: MMAXZ Z: KMAX") == ("NMAX", "MMAXZ", "KMAX") and metadata.parse_axes("X: a Y: b")[2] is None
    assert [metadata.parse_vector_axis(s) for s in ("sea_water_x_velocity", "sea_water_y_velocity", "eastward_wind", "salinity")] == ["X", "Y", "X", None]


def test_mask_flags(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((0, 1, 2, 9))], "pid long, c int")
    got = column(df.withColumn("m", metadata.mask_from_flags(F.col("c"), [0, 1, 2], "land WATER Lake")), "m")
    assert got == [True, False, False, True]
    assert column(df.withColumn("m", metadata.mask_from_options(F.col("c"))), "m") == [True, False, True, True]


# ---- registered queries


def test_selected_cells(spark, tmp_path):
    """Every point inside the mesh has its face's corners, whatever its id: against brute force over all faces."""
    from meshfield.plans import catalog

    rows = [(o, n, float(7 * o % 50 + 1), (3 * o + n) % 11 / 100) for o in range(1, 12) for n in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    xy = {n: (2.0 * (n % catalog.NX) + 0.5 * (n // catalog.NX), 2.0 * (n // catalog.NX)) for n in range(catalog.NX * catalog.NY)}
    faces = {}
    for q in range((catalog.NX - 1) * (catalog.NY - 1)):
        n = q // (catalog.NX - 1) * catalog.NX + q % (catalog.NX - 1)
        faces |= {2 * q: (n, n + 1, n + catalog.NX + 1), 2 * q + 1: (n, n + catalog.NX + 1, n + catalog.NX)}
    want = set()
    for o, k, x, y in rows:
        x, y = x + 0.3, y * 100 + 0.1
        for f, ns in faces.items():
            sides = [(xy[a], xy[b]) for a, b in zip(ns, ns[1:] + ns[:1], strict=True)]
            if all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for (ax, ay), (bx, by) in sides):
                want |= {(o * 10 + k, f, n, *xy[n], round(sum(xy[m][0] for m in ns) / 3, 6)) for n in ns}
    got = [tuple(r) for r in catalog.queries()["selected_cells"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {p % 50 for p, *_ in want} > {1}


def test_bracket_join_dense_and_sparse(spark, monkeypatch):
    """Bursts and gaps, times before, at and after the ends, nulls, an empty series; many buckets and one."""
    import random
    from datetime import datetime, timedelta

    from meshfield.operators import timeaxis

    r = random.Random(3)
    start = datetime(2024, 1, 1)
    times = sorted({start + timedelta(microseconds=r.randrange(10_000)) for _ in range(300)} | {start + timedelta(days=k * k) for k in range(30)})
    series = [(x, float(k)) for k, x in enumerate(times)]
    asked = [start - timedelta(days=1), times[0], times[-1], times[-1] + timedelta(days=9), None] + [r.choice(times) + timedelta(microseconds=r.randrange(-3, 4)) for _ in range(80)]
    points = spark.createDataFrame(list(enumerate(asked)), "pid long, t timestamp")
    df = spark.createDataFrame([*series, (None, 1.0)], "t timestamp, value double")
    for buckets, size in ((1_000_000, 32), (1, 1), (7, 1)):
        monkeypatch.setattr(timeaxis, "BUCKETS", buckets)
        monkeypatch.setattr(timeaxis, "IN_BUCKET", size)
        got = {x.pid: (x.lo, x.hi) for x in timeaxis.bracket_join(points, df).collect()}
        for k, x in enumerate(asked):
            before = [v for s, v in series if x is not None and s < x]
            after = [v for s, v in series if x is not None and s >= x]
            assert got[k] == (before[-1] if before else None, after[0] if after else None)
    assert all(x.lo is None and x.hi is None for x in timeaxis.bracket_join(points, df.limit(0)).collect())


def test_check_consistent(spark):
    from meshfield.operators import ugrid

    nodes = spark.createDataFrame([(k, float(k % 2), float(k // 2)) for k in range(4)], "node int, lon double, lat double")
    faces = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 3, 2])], "face int, nodes array<int>")
    ugrid.check_consistent(ugrid.Mesh(nodes, faces, boundaries=ugrid.boundaries(faces)))
    with pytest.raises(ValueError, match="node 3 is used"):
        ugrid.check_consistent(ugrid.Mesh(nodes.where("node < 3"), faces))
    with pytest.raises(ValueError, match="node 0 stands 2"):
        ugrid.check_consistent(ugrid.Mesh(nodes.union(nodes.where("node = 0")), faces))


def test_selected_cells_csv(spark, tmp_path):
    from meshfield.operators import ugrid

    nodes = spark.createDataFrame([(k, 2.0 * (k % 2), 2.0 * (k // 2)) for k in range(4)], "node int, lon double, lat double")
    faces = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 3, 2])], "face int, nodes array<int>")
    points = spark.createDataFrame([(7, 0.2, 0.2), (8, 9.0, 9.0)], "pid long, lon double, lat double")
    out = ugrid.selected_cells(points, faces, nodes, str(tmp_path / "csv"))
    rows = sorted(out.collect(), key=lambda x: (x.pid, x.place))
    assert [(x.pid, x.face, x.place, x.node) for x in rows] == [(7, 0, 0, 0), (7, 0, 1, 1), (7, 0, 2, 2), (8, 1, 0, 1), (8, 1, 1, 3), (8, 1, 2, 2)]
    assert all(x.area == 2.0 and x.n_nodes == 3 for x in rows)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(ugrid.SELECTED) and back.count() == 6


def test_many_corners(spark):
    """Cells of five corners go through the general polygon test, and a large cell among small ones is found."""
    from meshfield.operators import join

    poly = lambda *p: [{"lon": float(a), "lat": float(b)} for a, b in p]
    cells = [(0, poly((0, 0), (4, 0), (5, 3), (2, 5), (0, 4))), (1, poly((100, 0), (900, 0), (900, 700), (100, 700))), (2, poly((6, 0), (7, 0), (7, 1)))]
    df = spark.createDataFrame(cells, "cell long, poly array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(0, 2.0, 2.0), (1, 4.9, 4.9), (2, 500.0, 300.0), (3, 6.9, 0.5), (4, None, 1.0)], "pid int, lon double, lat double")
    assert {x.pid: x.cell for x in join.locate(points, df).collect()} == {0: 0, 1: None, 2: 1, 3: 2, 4: None}
    four = df.where("cell > 0")
    assert {x.pid: x.cell for x in join.locate(points, four).collect()} == {0: None, 1: None, 2: 1, 3: 2, 4: None}
    assert {x.cell for x in join.locate(points, df.limit(0)).collect()} == {None}


def test_many_rings(spark):
    """Closed and open rings of all lengths against a plain walk; segments in any order and direction, some twice."""
    import random

    from meshfield.operators import ugrid

    r = random.Random(5)
    ids = list(range(400))
    r.shuffle(ids)
    segments, want, at = [], set(), 0
    for size in (2, 3, 4, 5, 8, 17, 33, 64, 2, 3, 9):
        own = ids[at : at + size]
        at += size
        closed = size > 2 and r.random() < 0.6
        segments += list(zip(own, own[1:], strict=False)) + ([(own[-1], own[0])] if closed else [])
        k = own.index(min(own) if closed else min(own[0], own[-1]))
        turned = own[k:] + own[:k]
        if closed and turned[-1] < turned[1]:
            turned = turned[:1] + turned[:0:-1]
        if not closed:
            turned = own if own[0] < own[-1] else own[::-1]
        want |= {(min(own), p, n, closed) for p, n in enumerate(turned)}
    segments = [s if r.random() < 0.5 else s[::-1] for s in segments] + segments[:5]
    r.shuffle(segments)
    got = ugrid.order_rings(spark.createDataFrame(segments, "n0 long, n1 long")).collect()
    assert {(x.ring, x.place, x.node, x.closed) for x in got} == want and len(got) == len(want)
    assert ugrid.order_rings(spark.createDataFrame([], "n0 long, n1 long")).count() == 0


def test_points_are_located_once(spark):
    """A located table serves several queries (J-15), with the same values as a query of its own."""
    from meshfield.operators.field import at_points

    nodes = spark.createDataFrame([(j, i, i + 0.1 * j, j - 0.1 * i) for j in range(4) for i in range(5)], "j int, i int, lon double, lat double")
    grid = QuadGrid(nodes)
    fields = {n: Field(n, grid, grid.targets(spark).select("elem", (F.col("lon") * k).alias("value"))) for n, k in (("a", 2), ("b", 3))}
    points = pts(spark, [(1.2, 0.7), (2.5, 1.5), (9, 9)])
    located = grid.located(points, "lon", "lat").cache()
    both = at_points({"a": fields["a"]}, located, located=True)
    both = at_points({"b": fields["b"]}, both, located=True)
    assert column(both, "a", "b") == column(at_points(fields, points), "a", "b")
    assert column(both, "a")[2] is None and column(both, "a")[0] == pytest.approx(2.4)
    other = Field("c", QuadGrid(nodes), fields["a"].data)
    with pytest.raises(ValueError, match="one grid"):
        at_points({"a": fields["a"], "c": other}, located, located=True)
