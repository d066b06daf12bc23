"""Files written and loaded again, and point queries on what they hold."""

from datetime import datetime, timedelta

import numpy as np
import pyspark.sql.functions as F
import pytest

from meshfield.operators.field import Field, QuadGrid, RectGrid, TriGrid
from meshfield.operators.timeaxis import TimeAxis
from meshfield.sources import cdf, dataset

AXIS = TimeAxis(tuple(datetime(2020, 1, 1) + timedelta(hours=k) for k in range(3)), 0.0)


def stepped(grid, spark):
    data = grid.targets(spark).withColumn("t_idx", F.explode(F.array(*map(F.lit, range(3)))))
    return Field("temp", grid, data.select("elem", "t_idx", (2 * F.col("lon") + F.col("lat") + F.col("t_idx")).alias("value")), AXIS, units="degC")


def check(spark, path, kind):
    ds = dataset.load_dataset(spark, path)
    assert isinstance(ds.grid, kind) and set(ds.variables) == {"temp"} and ds["temp"].units == "degC" and ds["temp"].time.times == AXIS.times
    p = spark.createDataFrame([(0, 1.25, 0.75, datetime(2020, 1, 1, 0, 30))], "pid long, lon double, lat double, t timestamp_ntz")
    assert ds["temp"].at(p).first().temp == pytest.approx(2 * 1.25 + 0.75 + 0.5)
    return ds


def test_ugrid_file(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 0.0), (2, 0.0, 3.0), (3, 3.0, 3.0)], "node int, lon double, lat double")
    faces = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 3, 2])], "face int, nodes array<int>")
    grid = TriGrid(faces, nodes)
    dataset.save_ugrid(str(tmp_path / "u.nc"), nodes, faces, {"temp": stepped(grid, spark)})
    ds = check(spark, str(tmp_path / "u.nc"), TriGrid)
    assert [r.nodes for r in ds.grid.faces.orderBy("face").collect()] == [[0, 1, 2], [1, 3, 2]]
    assert ds.attributes["Conventions"].endswith("UGRID-1.0")


def test_sgrid_file(spark, tmp_path):
    nodes = spark.createDataFrame([(j, i, i + 0.1 * j, j - 0.1 * i) for j in range(4) for i in range(5)], "j int, i int, lon double, lat double")
    dataset.save_sgrid(str(tmp_path / "s.nc"), nodes, {"temp": stepped(QuadGrid(nodes), spark)}, version=1)
    check(spark, str(tmp_path / "s.nc"), QuadGrid)


def test_rectangular_files(spark, tmp_path):
    xs, ys = np.arange(4.0), np.arange(3.0)
    for k in range(2):
        v = 2 * xs[None, None] + ys[None, :, None] + np.arange(2 * k, 2 * k + 2)[:, None, None]
        cdf.write(str(tmp_path / f"r{k}.nc"), {"time": None, "lat": 3, "lon": 4}, {"time": (("time",), np.arange(2 * k, 2 * k + 2) * 1.0, {"units": "hours since 2020-1-1 00:00:00"}), "lon": (("lon",), xs, {}), "lat": (("lat",), ys, {}), "temp": (("time", "lat", "lon"), v, {"units": "degC"})})
    f = dataset.load_field(spark, [str(tmp_path / f"r{k}.nc") for k in range(2)], "temp")
    assert isinstance(f.grid, RectGrid) and len(f.time) == 4
    p = spark.createDataFrame([(0, 1.25, 0.75, datetime(2020, 1, 1, 2, 30))], "pid long, lon double, lat double, t timestamp_ntz")
    assert f.at(p).first().temp == pytest.approx(2 * 1.25 + 0.75 + 2.5)


def test_one_based_names_and_levels(spark, tmp_path):
    path = str(tmp_path / "n.nc")
    z = np.array([0.5, 5.0])
    v = np.arange(8.0).reshape(2, 4)
    cdf.write(path, {"node": 4, "nele": 2, "three": 3, "depth": 2}, {"lon": (("node",), np.array([0, 1.5, 0, 1.5]), {}), "lat": (("node",), np.array([0, 0, 1.5, 1.5]), {}), "nv": (("nele", "three"), np.array([[1, 2, 3], [2, 4, 3]], "i4"), {}), "depth": (("depth",), z, {}), "salt": (("depth", "node"), v, {})})
    f = dataset.load_field(spark, path, "salt")
    assert f.depth.depths == (0.0, 5.0)
    assert [r.nodes for r in f.grid.faces.orderBy("face").collect()] == [[0, 1, 2], [1, 3, 2]]
    p = spark.createDataFrame([(0, 0.5, 0.5, 2.5)], "pid long, lon double, lat double, z double")
    assert f.at(p).first().salt == pytest.approx((1 + 2) / 3 + 2)


def test_sigma_layers_are_an_error(spark, tmp_path):
    path = str(tmp_path / "s.nc")
    base = {"lon": (("node",), np.array([0, 1.5, 0, 1.5]), {}), "lat": (("node",), np.array([0, 0, 1.5, 1.5]), {}), "nv": (("nele", "three"), np.array([[1, 2, 3], [2, 4, 3]], "i4"), {})}
    v = np.arange(8.0).reshape(2, 4)
    cdf.write(path, {"node": 4, "nele": 2, "three": 3, "siglay": 2, "one": 1}, {**base, "siglay": (("siglay", "node"), v, {}), "h": (("node",), v[0], {}), "salt": (("siglay", "node"), v, {}), "top": (("one", "node"), v[:1], {})})
    with pytest.raises(ValueError, match="siglay"):
        dataset.load_field(spark, path, "salt")
    assert dataset.load_field(spark, path, "top").data.count() == 4


def roms_file(path):
    """Like the output of ROMS: nodes at psi, centers (rho) on both sides of them, u and v on edges, s levels, h and zeta at rho."""
    nj, ni, nt = 5, 6, 2
    at = {"psi": (0.0, 0.0, nj, ni), "rho": (-0.5, -0.5, nj + 1, ni + 1), "u": (-0.5, 0.0, nj + 1, ni), "v": (0.0, -0.5, nj, ni + 1)}
    dims = {"ocean_time": None, "s_rho": 3, "s_w": 4}
    out = {"ocean_time": (("ocean_time",), np.arange(nt) * 3600.0, {"units": "seconds since 2020-1-1 00:00:00"})}
    spot = {}
    for n, (dj, di, a, b) in at.items():
        j, i = np.meshgrid(np.arange(a) + dj, np.arange(b) + di, indexing="ij")
        spot[n] = (i + 0.1 * j, j - 0.1 * i)
        dims |= {f"eta_{n}": a, f"xi_{n}": b}
        for k, c in enumerate(("lon", "lat")):
            out[f"{c}_{n}"] = ((f"eta_{n}", f"xi_{n}"), spot[n][k], {})
    x, y = spot["rho"]
    out["h"] = (("eta_rho", "xi_rho"), 20 + x + 2 * y, {})
    out["zeta"] = (("ocean_time", "eta_rho", "xi_rho"), np.stack([0.1 * x + k for k in range(nt)]), {"time": "ocean_time"})
    out |= {"s_w": (("s_w",), np.array([-1, -0.6, -0.2, 0.0]), {}), "Cs_w": (("s_w",), np.array([-1, -0.5, -0.1, 0.0]), {}), "s_rho": (("s_rho",), np.array([-0.8, -0.4, -0.1]), {}), "Cs_rho": (("s_rho",), np.zeros(3), {}), "Cs_r": (("s_rho",), np.array([-0.7, -0.3, -0.05]), {})}
    out |= {"hc": ((), np.float64(5.0), {}), "Vtransform": ((), np.int32(2), {})}
    out["temp"] = (("ocean_time", "s_rho", "eta_rho", "xi_rho"), np.stack([np.stack([100 * t + 10 * k + np.round(x) for k in range(3)]) for t in range(nt)]), {"time": "ocean_time"})
    for n in "uv":
        out[n] = (("ocean_time", f"eta_{n}", f"xi_{n}"), np.stack([spot[n][0] * 2 + spot[n][1] * 3 + t for t in range(nt)]), {"time": "ocean_time"})
    mask = np.ones((nj + 1, ni + 1))
    mask[2, 2] = 0
    out["mask_rho"] = (("eta_rho", "xi_rho"), mask, {})
    cdf.write(path, dims, out)
    return out


def test_roms_file(spark, tmp_path):
    path = str(tmp_path / "roms.nc")
    out = roms_file(path)
    grid = dataset.load_grid(spark, path)
    assert grid.padding == {"center": {"j": "both", "i": "both"}, "edge1": {"j": "both"}, "edge2": {"i": "both"}}
    assert grid.places("edge1").count() == 36 and [(r.j, r.i) for r in grid.mask.where("masked").collect()] == [(1, 1)]
    ds = dataset.load_dataset(spark, path)
    assert {n: f.location for n, f in ds.variables.items()} == {"h": "center", "zeta": "center", "temp": "center", "u": "edge1", "v": "edge2"}
    temp = ds["temp"]
    assert temp.layers and len(temp.depth) == 4 and temp.depth.vtransform == 2 and temp.depth.h.location == "node"
    # Cell (j, i) of the nodes, and the place (l, m) in it: lon = i + 0.1 j, lat = j - 0.1 i.
    rows, want = [], []
    rng = np.random.default_rng(4)
    for pid in range(60):
        j, i = rng.uniform(0.02, 3.98), rng.uniform(0.02, 4.98)
        lon, lat, z, hours = i + 0.1 * j, j - 0.1 * i, rng.uniform(0, 30), rng.uniform(0, 1)
        rows.append((pid, float(lon), float(lat), float(z), datetime(2020, 1, 1) + timedelta(hours=float(hours))))
        hours = (rows[-1][4] - datetime(2020, 1, 1)) / timedelta(hours=1)
        h, zeta = 20 + lon + 2 * lat, 0.1 * lon + hours
        s, cs = out["s_w"][1], out["Cs_w"][1]
        p = (zeta + h) * -((5 * s + h * cs) / (5 + h))
        k = int((p > z).sum()) - 1
        cj, ci = int(j), int(i)
        masked = (cj, ci) == (1, 1)
        temp_at = lambda t: out["temp"][1][t, min(k, 2), cj + 1, ci + 1]
        u = out["u"][1]
        ll, m = i - ci, j - cj
        edge = [(1 - ll) * u[t, cj + 1, ci] + ll * u[t, cj + 1, ci + 1] for t in (0, 1)]
        v = [(1 - m) * out["v"][1][t, cj, ci + 1] + m * out["v"][1][t, cj + 1, ci + 1] for t in (0, 1)]
        mix = lambda a, b: a + (b - a) * hours
        want.append((None, None, None) if masked else (None if k < 0 else mix(temp_at(0), temp_at(1)), mix(*edge), mix(*v)))
    points = spark.createDataFrame(rows, "pid long, lon double, lat double, z double, t timestamp_ntz")
    got = {r.pid: r for r in temp.at(points).collect()}
    uv = {r.pid: r for r in dataset.load_vector(spark, path).at(points).collect()}
    assert len(got) == 60 and sum(w[0] is not None for w in want) > 20
    for pid, (a, b, c) in enumerate(want):
        assert got[pid].temp == (None if a is None else pytest.approx(a))
        assert (uv[pid].u, uv[pid].v) == ((None, None) if b is None else (pytest.approx(b), pytest.approx(c)))


def test_fvcom_file(spark, tmp_path):
    """Sigma levels of each node, face velocities, a separate grid file, and a file of variables without a surface."""
    base = {"lon": (("node",), np.array([0, 4.0, 0, 4.0]), {}), "lat": (("node",), np.array([0, 0, 4.0, 4.0]), {})}
    lev = np.array([[0.0] * 4, [-0.4, -0.5, -0.6, -0.5], [-1.0] * 4])
    dims = {"node": 4, "nele": 2, "three": 3, "siglev": 3, "siglay": 2}
    grid_path, data_path = str(tmp_path / "g.nc"), str(tmp_path / "d.nc")
    cdf.write(grid_path, dims, {**base, "nv": (("nele", "three"), np.array([[1, 2, 3], [2, 4, 3]], "i4"), {})})
    data = {"siglev": (("siglev", "node"), lev, {}), "siglay": (("siglay", "node"), (lev[1:] + lev[:-1]) / 2, {}), "h": (("node",), np.array([10, 20.0, 10, 20.0]), {"location": "node"})}
    data |= {"salt": (("siglay", "node"), np.array([[1.0] * 4, [5.0] * 4]), {"location": "node"}), "w": (("siglev", "node"), np.array([[0.0] * 4, [1.0] * 4, [2.0] * 4]), {"location": "node"}), "ua": (("nele",), np.array([3.0, 4.0]), {"location": "face"})}
    cdf.write(data_path, dims, data)
    with pytest.warns(RuntimeWarning, match="zeta"):
        ds = dataset.load_dataset(spark, grid_file=grid_path, variable_files=[data_path])
    assert {n: f.location for n, f in ds.variables.items()} == {"h": "node", "salt": "node", "w": "node", "ua": "face"}
    points = spark.createDataFrame([(0, 1.0, 1.0, 2.0), (1, 3.0, 3.0, 12.0), (2, 3.0, 3.5, 99.0), (3, 9.0, 9.0, 1.0)], "pid long, lon double, lat double, z double")
    from meshfield.operators.field import at_points

    got = {r.pid: r for r in at_points(ds.variables, points).collect()}
    h, s = 12.5, -0.475  # at (1, 1): 0.5, 0.25, 0.25 of nodes 0, 1, 2
    assert got[0].w == pytest.approx(2.0 / (-s * h)) and got[0].salt == 1.0 and got[0].ua == 3.0
    h, s = 17.5, 0.5 * -0.5 + 0.25 * -0.5 + 0.25 * -0.6
    assert got[1].w == pytest.approx(1 + (12.0 + s * h) / (h + s * h)) and got[1].salt == 5.0 and got[1].ua == 4.0
    assert (got[2].w, got[2].salt, got[3].ua) == (None, None, 0.0)
    with pytest.raises(ValueError, match="components"):
        dataset.load_vector(spark, data_path, grid=ds.grid)
    # Bathymetry in the grid file; a field by one of several names.
    both = str(tmp_path / "b.nc")
    bare = {k: v for k, v in data.items() if k != "h"}
    cdf.write(both, dims, {**base, "nv": (("nele", "three"), np.array([[1, 2, 3], [2, 4, 3]], "i4"), {}), "h": (("node",), np.array([10, 20.0, 10, 20.0]), {"standard_name": "sea_floor_depth_below_geoid", "location": "node"})})
    cdf.write(data_path, dims, bare)
    f = dataset.load_field(spark, data_path, ["none", "w"], grid_file=both, location="node")
    assert f.name == "w" and f.at(points.limit(1)).first().w == pytest.approx(2.0 / (0.475 * 12.5))


def test_single_level(spark):
    """A field of one level has that level's value at any depth (I-06)."""
    from meshfield.operators import depth

    grid = RectGrid((0.0, 1.0, 2.0), (0.0, 1.0))
    data = grid.targets(spark).select("elem", F.lit(0).alias("k"), F.col("lon").alias("value"))
    points = spark.createDataFrame([(0, 0.5, 0.5, 0.0), (1, 1.5, 0.5, 99.0)], "pid long, lon double, lat double, z double")
    got = Field("f", grid, data, depth=depth.Levels((0.0,))).at(points).collect()
    assert sorted((r.pid, r.f) for r in got) == [(0, 0.5), (1, 1.5)]


def test_mesh_parts(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 0.0), (2, 0.0, 3.0), (3, 3.0, 3.0)], "node int, lon double, lat double")
    faces = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 3, 2])], "face int, nodes array<int>")
    from meshfield.operators import ugrid
    from meshfield.operators.field import Dataset

    grid = TriGrid(faces, nodes, ugrid.edges(faces), ugrid.boundaries(faces).select("n0", "n1"))
    path = str(tmp_path / "m.nc")
    dataset.save(Dataset(grid, {}), path)
    mesh, _ = dataset.load_mesh(spark, path)
    assert ugrid.same_rows(mesh.edges.select("n0", "n1"), grid.edges) and ugrid.same_rows(mesh.boundaries.select("n0", "n1"), grid.boundaries)
    assert mesh.info() == {"nodes": 4, "faces": 2, "edges": 5, "boundaries": 4, "num_vertices": 3}


def test_pushed_range(spark, tmp_path):
    """The steps that a query needs reach the source as a range."""
    path = str(tmp_path / "p.nc")
    v = np.arange(40.0).reshape(10, 4)
    cdf.write(path, {"time": None, "x": 4}, {"v": (("time", "x"), v, {})})
    for where, want in (("t_idx > 3 and t_idx < 6", [4, 5]), ("t_idx in (2, 3)", [2, 3]), ("t_idx = 9", [9]), ("t_idx < 0", [])):
        df = cdf.load_variable(spark, path, "v").where(where)
        assert sorted({r.t_idx for r in df.collect()}) == want
    r = cdf._Reader({"path": path, "variable": "v"})
    from pyspark.sql.datasource import GreaterThan, LessThan

    assert len(list(r.pushFilters([GreaterThan(("t_idx",), 3), LessThan(("t_idx",), 6)]))) == 2 and (r.lo, r.hi) == (4, 5)
    assert [(p.start, p.stop) for p in r.partitions()] == [(4, 6)]
