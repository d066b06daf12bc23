"""Datasets in classic CDF files: grids and fields from metadata (UGRID, SGRID or by names), and UGRID/SGRID writers.

Headers, axes and terms of the vertical are read on the driver; grid arrays and field values are DataFrames over the file.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefn
from ..operators import depth, rgrid, sgrid, ugrid
from ..operators.field import Dataset, Field, Grid, QuadGrid, RectGrid, Sigma, TriGrid, VectorField
from ..operators.timeaxis import TimeAxis
from . import cdf, metadata

#: Components of vectors by the names that files use (S-33): U and V.
VECTOR_NAMES = (("u", "v"), ("U", "V"), ("water_u", "water_v"), ("air_u", "air_v"), ("current_u", "current_v"))


def variables_of(h: cdf.Header) -> dict[str, metadata.Meta]:
    return {n: metadata.Meta(v.dims, v.shape, v.attrs) for n, v in h.variables.items()}


def _idx(k: int) -> Column:
    return F.element_at("idx", k)


def _read(path: str, h: cdf.Header, name: str) -> np.ndarray:
    """A small array (an axis, terms of the vertical), on the driver."""
    return np.asarray(cdf.read_values(path, h, name), dtype=np.float64)


def _places(spark: SparkSession, path: str, lon: str, lat: str, keys: Mapping[str, int]) -> DataFrame:
    """keys (name -> position of its index), lon, lat of two variables on the same dimensions."""
    one = lambda n, v: cdf.load_variable(spark, path, n).select(*[_idx(k).cast("int").alias(c) for c, k in keys.items()], F.col("value").alias(v))
    return one(lon, "lon").join(one(lat, "lat"), list(keys))


# ---- grids


def load_grid(spark: SparkSession, path: str, topology: Mapping[str, str] | None = None, grid_type: str | None = None) -> Grid:
    """The grid of a file (S-08, S-15, S-16, S-18, S-20). topology: role -> variable name, for files without conventions."""
    h = cdf.read_header(path)
    v = variables_of(h)
    kind = metadata.grid_type(v, h.attrs, grid_type, topology)
    lon, lat = _coordinates(v, kind, topology)
    if kind == "R":
        metadata.require_1d(v, (lon, lat))
        return RectGrid(tuple(_read(path, h, lon).tolist()), tuple(_read(path, h, lat).tolist()))
    return _staggered(spark, path, h, v, lon, lat, topology) if kind == "S" else _triangles(spark, path, h, v, lon, lat, topology)


def _triangles(spark: SparkSession, path: str, h: cdf.Header, v, lon: str, lat: str, topology) -> TriGrid:
    if lon == lat:  # one N x 2 (or 2 x N) variable
        wide = v[lon].shape[-1] == 2
        both = cdf.load_variable(spark, path, lon).select(_idx(1 if wide else 2).cast("int").alias("node"), _idx(2 if wide else 1).alias("c"), "value")
        nodes = both.groupBy("node").agg(F.max(F.when(F.col("c") == 0, F.col("value"))).alias("lon"), F.max(F.when(F.col("c") == 1, F.col("value"))).alias("lat"))
        n = v[lon].shape[0 if wide else 1]
    else:
        nodes, n = _places(spark, path, lon, lat, {"node": 1}), v[lon].shape[0]
    mesh = v[metadata.the_mesh(v)].attrs if metadata.mesh_names(v) else {}
    faces = _connectivity(spark, path, v, _face_variable(v, topology), n, flexible=True)
    faces = faces.select(F.col("row").alias("face"), F.col("to").alias("nodes"))
    pairs = {}
    for part in ("edge", "boundary"):
        name = mesh.get(f"{part}_node_connectivity") or (topology or {}).get("edges" if part == "edge" else "boundaries")
        if name in v:
            own = _connectivity(spark, path, v, name, n)
            pairs[part] = own.select(F.col("row").alias(part), F.col("to")[0].alias("n0"), F.col("to")[1].alias("n1"))
    return TriGrid(faces, nodes, pairs.get("edge"), pairs.get("boundary"))


def load_mesh(spark: SparkSession, path: str, topology: Mapping[str, str] | None = None) -> tuple[ugrid.Mesh, dict[str, DataFrame]]:
    """All parts of a UGRID file (S-15): the mesh with face neighbours, and by name face_edges (face, slot, edge) and the coordinates of faces, edges and boundaries."""
    grid = load_grid(spark, path, topology, "ugrid")
    h = cdf.read_header(path)
    v = variables_of(h)
    mesh = v[metadata.the_mesh(v)].attrs if metadata.mesh_names(v) else {}
    more: dict[str, DataFrame] = {}
    slots = {}
    for part, value in (("face_face", "other"), ("face_edge", "edge")):
        name = mesh.get(f"{part}_connectivity")
        if name in v:
            first = int(v[name].attrs.get("start_index", 0))
            cell = F.when(F.col("value") >= first, (F.col("value") - first).cast("int"))
            slots[part] = cdf.load_variable(spark, path, name).select(_idx(1).alias("face"), _idx(2).alias("slot"), cell.alias(value))
    for part in ("face", "edge", "boundary"):
        names = str(mesh.get(f"{part}_coordinates", "")).split()
        if len(names) == 2 and all(n in v for n in names):
            lon, lat = _lon_lat(v, names)
            more[f"{part}_coordinates"] = _places(spark, path, lon, lat, {part: 1})
    if "face_edge" in slots:
        more["face_edges"] = slots["face_edge"]
    return ugrid.Mesh(grid.nodes, grid.faces, grid.edges, grid.boundaries, slots.get("face_face")), more


def _connectivity(spark: SparkSession, path: str, v, name: str, n_nodes: int, flexible: bool = False) -> DataFrame:
    """row, to (array of node ids from 0) of a table; it may be transposed, and count from 1. Absent corners of a flexible mesh are left out."""
    shape = v[name].shape
    df = cdf.load_variable(spark, path, name)
    lo, hi = df.agg(F.min(F.when(F.col("value") >= 0, F.col("value"))), F.max("value")).first()
    flip, first = metadata.faces_layout(shape, int(lo or 0), int(hi or 0), n_nodes)
    first = int(v[name].attrs.get("start_index", first))
    cell = F.when(F.col("value") >= first, (F.col("value") - first).cast("int"))
    rows = df.select(_idx(2 if flip else 1).cast("int").alias("row"), _idx(1 if flip else 2).alias("slot"), cell.alias("n"))
    rows = rows.where("n is not null") if flexible else rows
    got = rows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("s"))
    return got.select("row", F.transform("s", lambda x: x["n"]).alias("to"))


def _staggered(spark: SparkSession, path: str, h: cdf.Header, v, lon: str, lat: str, topology) -> QuadGrid:
    """Nodes, and what the file has of centers, edges, masks and paddings (S-13, S-18, S-36)."""
    names = {**metadata.staggered_names(v), **(topology or {})}
    top = metadata.topology_variable(v)
    stated = _paddings(v, top) if top else {}
    parts: dict[str, DataFrame] = {}
    padding: dict[str, dict[str, str]] = {}
    shape = v[lon].shape
    for place in ("center", "edge1", "edge2"):
        given = str(v[top].attrs.get(f"{'face' if place == 'center' else place}_coordinates", "")).split() if top else []
        pair = _lon_lat(v, given) if len(given) == 2 and all(n in v for n in given) else (names.get(f"{place}_lon"), names.get(f"{place}_lat"))
        if not all(n in v for n in pair) and top:  # coordinates that only their units or standard names tell (S-36)
            dims = _dimensions(v, top)[place]
            try:
                pair = metadata.coordinates_of(v, dims[::-1]) if len(dims) == 2 else pair
            except ValueError:
                pair = (None, None)
        has = all(n in v for n in pair)
        if has:
            parts[place] = _places(spark, path, *pair, {"j": 1, "i": 2})
        own = stated.get(place, {})
        for k, dim in enumerate(("j", "i")):
            if dim not in own and has and not (place == "edge1" and dim == "i") and not (place == "edge2" and dim == "j"):
                own[dim] = sgrid.infer_padding(v[pair[0]].shape[k], shape[k])
        padding[place] = own
    coast = mask = None
    if names.get("center_mask") in v:
        coast = load_mask(spark, path, h, names["center_mask"])
        shift = {d: sgrid.shift_for(padding["center"].get(d, "none")) for d in ("j", "i")}
        mask = coast.select((F.col("j") - shift["j"]).alias("j"), (F.col("i") - shift["i"]).alias("i"), "masked") if any(shift.values()) else coast
    return QuadGrid(_places(spark, path, lon, lat, {"j": 1, "i": 2}), mask, padding, parts.get("center"), parts.get("edge1"), parts.get("edge2"), None)


def load_mask(spark: SparkSession, path: str, h: cdf.Header, name: str) -> DataFrame:
    """j, i, masked of a mask variable (F-04): by its flags where it has any, else 0 is land."""
    attrs = h.variables[name].attrs
    code = F.col("value")
    if "flag_values" in attrs and "flag_meanings" in attrs:
        values = attrs["flag_values"] if isinstance(attrs["flag_values"], list) else [attrs["flag_values"]]
        code = metadata.mask_from_flags(code, [float(x) for x in values], attrs["flag_meanings"])
    else:
        code = metadata.mask_from_options(code)
    return cdf.load_variable(spark, path, name).select(_idx(1).cast("int").alias("j"), _idx(2).cast("int").alias("i"), code.alias("masked"))


def _dimensions(v, top: str) -> dict[str, list[str]]:
    """Location -> its dimensions, x first, from a topology's attributes."""
    nodes = str(v[top].attrs.get("node_dimensions", "")).split()
    out = {"node": nodes}
    for place, attr in (("center", "face_dimensions"), ("edge1", "edge1_dimensions"), ("edge2", "edge2_dimensions")):
        text = str(v[top].attrs.get(attr, ""))
        own = {node: face for face, node, _ in metadata.parse_padding(text, top)} if "padding" in text else {}
        words = [w.strip(":") for w in re.sub(r"\([^)]*\)", " ", text).split()]
        out[place] = [own.get(n, n) for n in nodes if n in words]
    return out


def describe(path: str, topology: Mapping[str, str] | None = None) -> list[dict]:
    """What a file says of its variables on a staggered grid (F-16, F-17, F-20): name, location, dims, x_axis, y_axis, z_axis, vector_axis, slices that take the padding away."""
    h = cdf.read_header(path)
    v = variables_of(h)
    top = metadata.staggered_topology(v)
    lon, lat = _coordinates(v, "S", topology)
    places, pads = _dimensions(v, top), _paddings(v, top)
    nodes = places["node"]
    vertical = dict.fromkeys(w for w, *_ in metadata.parse_padding(str(v[top].attrs["vertical_dimensions"]), top)) if "vertical_dimensions" in v[top].attrs else {}
    out = []
    for name in (n for n in v if n not in metadata.referenced(v) and len(v[n].dims) >= 2):
        m = v[name]
        place = metadata.variable_location(m, places)
        place = sgrid.LOCATIONS.get(str(place).lower(), place)
        if place is None:
            continue
        padding = {d: pads.get(place, {}).get(("i", "j")[nodes.index(n)], "none") for d, n in zip(places.get(place, ()), nodes, strict=False)}
        x, y, z = metadata.parse_axes(str(m.attrs.get("axes", "")))
        dims = places.get(place, [])
        x, y, z = x or (dims[0] if dims else None), y or (dims[1] if len(dims) > 1 else None), z or next((d for d in m.dims if d in vertical), None)
        slices = metadata.variable_slices(m, padding, sgrid.PADDING)
        out.append({"name": name, "location": place, "dims": list(m.dims), "x_axis": x, "y_axis": y, "z_axis": z, "vector_axis": metadata.parse_vector_axis(str(m.attrs.get("standard_name", ""))), "slices": [f"{a}:{'' if b is None else b}" for a, b in slices]})
    return out


def describe_table(spark: SparkSession, path: str) -> DataFrame:
    """describe() as a table."""
    rows = [tuple(r.values()) for r in describe(path)]
    return spark.createDataFrame(rows, "name string, location string, dims array<string>, x_axis string, y_axis string, z_axis string, vector_axis string, slices array<string>")


def _paddings(v, top: str) -> dict[str, dict[str, str]]:
    """Location -> dimension (j, i) -> padding, from a topology's attributes (F-17)."""
    nodes = str(v[top].attrs.get("node_dimensions", "")).split()
    out: dict[str, dict[str, str]] = {}
    for place, attr in (("center", "face_dimensions"), ("edge1", "edge1_dimensions"), ("edge2", "edge2_dimensions")):
        text = str(v[top].attrs.get(attr, ""))
        if "padding" in text and len(nodes) == 2:
            out[place] = {("i", "j")[nodes.index(node)]: kind for _, node, kind in metadata.parse_padding(text, top) if node in nodes}
    return out


def _lon_lat(v, names: Sequence[str]) -> tuple[str, str]:
    is_lat = lambda n: v[n].attrs.get("standard_name") in ("latitude", "projection_y_coordinate") or "north" in str(v[n].attrs.get("units", ""))
    return (names[1], names[0]) if is_lat(names[0]) else (names[0], names[1])


def _coordinates(v, kind: str, topology) -> tuple[str, str]:
    top = metadata.topology_variable(v)
    named = str(v[top].attrs.get("node_coordinates", "")).split() if top and not topology else []
    if len(named) == 2:
        return _lon_lat(v, named)
    return metadata.required_nodes(v, topology)


def _face_variable(v, topology) -> str:
    if topology and topology.get("faces") in v:
        return topology["faces"]
    if metadata.mesh_names(v):
        return v[metadata.the_mesh(v)].attrs["face_node_connectivity"]
    name = next((n for n in metadata.FACE_NAMES if n in v), None)
    if name is None:
        raise ValueError("no faces found")
    return name


# ---- time, depth


def load_time(path: str, h: cdf.Header, name: str, tz_offset: float | None | str = "file", origin=None, displacement: timedelta | None = None) -> TimeAxis:
    """S-21: a zone that the file does not give counts as UTC; 'naive' leaves it open."""
    units = h.variables[name].attrs["units"]
    size, epoch = timefn.parse_units(units)
    times = tuple(epoch + timedelta(microseconds=round(float(x) * size)) for x in np.atleast_1d(cdf.read_values(path, h, name)))
    given, _ = timefn.parse_offset(units)
    hours = (0.0 if given is None else given) if tz_offset == "file" else None if str(tz_offset).lower() == "naive" else tz_offset
    axis = TimeAxis(times, hours)
    axis = axis.with_origin(origin) if origin is not None else axis
    return axis.displace(displacement) if displacement is not None else axis


def load_sigma(spark: SparkSession, path: str | Sequence[str], grid: Grid, kind: str, grid_file: str | None = None, topology: Mapping[str, str] | None = None, **axis) -> Sigma:
    """S-25: bathymetry and surface (0, with a warning, where the file has none) and the terms of ROMS or FVCOM. Those at centers are averaged to nodes (A-03)."""
    paths = [path] if isinstance(path, str) else list(path)
    h = cdf.read_header(paths[0])
    v = variables_of(h)
    roles, said = {"h": ("h",), "zeta": metadata.ZETA}, {"h": metadata.BATHYMETRY_LONG, "zeta": metadata.ZETA_LONG}
    own = metadata.search(v, roles, said)
    there = metadata.search(variables_of(cdf.read_header(grid_file)), roles, said) if grid_file and grid_file not in paths else {}
    found = metadata.merged(own, there)  # what the data file names, else the grid file (S-32)
    loaded = {}
    for role in ("h", "zeta"):
        if found[role] is None:
            warnings.warn("no zeta found: the undisturbed surface", RuntimeWarning, stacklevel=2)
            loaded[role] = None
            continue
        files = (paths if role == "zeta" else paths[0]) if own[role] is not None else grid_file
        f = load_field(spark, files, found[role], grid, topology, grid_file, **(axis if role == "zeta" else {}))
        loaded[role] = _at_nodes(f) if f.location == "center" and isinstance(grid, QuadGrid) else f
    headers = {p: cdf.read_header(p) for p in dict.fromkeys([paths[0], *([grid_file] if grid_file else [])])}
    home = lambda n: next((p for p, head in headers.items() if n in head.variables), paths[0])
    term = lambda n: _read(home(n), headers[home(n)], n)
    if kind == "roms":
        transform = int(term("Vtransform")) if any("Vtransform" in head.variables for head in headers.values()) else 2
        return Sigma(loaded["h"], loaded["zeta"], tuple(term("s_w").tolist()), tuple(term("Cs_w").tolist()), float(term("hc")), transform)
    levels = cdf.load_variable(spark, home("siglev"), "siglev").select(_idx(2).cast("long").alias("elem"), _idx(1).alias("k"), "value")
    return Sigma(loaded["h"], loaded["zeta"], levels=levels, n_levels=headers[home("siglev")].variables["siglev"].shape[0])


def _at_nodes(f: Field) -> Field:
    """A center field as a node field: the mean of the centers around each node. Rim nodes without four centers have no value."""
    j, i = sgrid.from_id("elem")
    keep = [c for c in ("t_idx", "k") if c in f.data.columns]
    pad = f.grid.padding.get("center", {})
    # Node j lies between centers j - 1 and j; a padding on the low side moves centers one ahead.
    move = {d: 0 if sgrid.shift_for(pad.get(d, "none")) else 1 for d in ("j", "i")}
    rows = sgrid.centers_to_nodes(f.data.select(*keep, j.alias("j"), i.alias("i"), "value"), keep)
    return replace(f, data=rows.select(sgrid.id_of(F.col("j") + move["j"], F.col("i") + move["i"]).alias("elem"), *keep, "value"), location="node")


# ---- fields


def _shape_of(grid: Grid, spark_shape: Mapping[str, tuple[int, ...]]) -> tuple[int, ...] | None:
    return (len(grid.ys), len(grid.xs)) if isinstance(grid, RectGrid) else spark_shape.get("node")


def _shapes(path: str, topology=None) -> dict[str, tuple[int, ...]]:
    """Shapes of the nodes (and faces, edges, boundaries) of a grid file, from its header alone."""
    h = cdf.read_header(path)
    v = variables_of(h)
    kind = metadata.grid_type(v, h.attrs, None, topology)
    lon, lat = _coordinates(v, kind, topology)
    shape = v[lon].shape
    if kind != "U":
        return {"node": tuple(shape)}
    if lon == lat:
        shape = shape[:1] if shape[-1] == 2 else shape[1:]
    faces = v[_face_variable(v, topology)].shape
    mesh = v[metadata.the_mesh(v)].attrs if metadata.mesh_names(v) else {}
    rows = lambda part: v[mesh[part]].shape[0] if mesh.get(part) in v else -1
    flip = len(faces) == 2 and faces[0] in (3, 4) and faces[1] > 4
    return {"node": tuple(shape), "face": (faces[1 if flip else 0],), "boundary": (rows("boundary_node_connectivity"),), "edge": (rows("edge_node_connectivity"),)}


def location_of(meta: metadata.Meta, v, grid: Grid, shapes: Mapping[str, tuple[int, ...]]) -> str | None:
    """Where a variable lies (F-13 to F-16): its attribute, the dimensions that a topology names, else its shape."""
    given = meta.attrs.get("location")
    if given:
        given = str(given).lower()
        return sgrid.LOCATIONS.get(given) if not isinstance(grid, TriGrid) else given
    if isinstance(grid, TriGrid):
        return ugrid.infer_location(meta.shape[-1], shapes["node"][0], shapes["face"][0], shapes["boundary"][0]) if meta.shape else None
    if len(meta.shape) < 2:
        return None
    if isinstance(grid, RectGrid):
        n = (len(grid.ys), len(grid.xs))
        own = tuple(meta.shape[-2:])
        less = (n[0] - 1, n[1] - 1)
        return "node" if own in (n, n[::-1]) else "center" if own in (less, less[::-1]) else None
    top = metadata.topology_variable(v)
    if top:
        found = metadata.variable_location(meta, _dimensions(v, top))
        if found:
            return found
    return sgrid.infer_location(meta.shape, shapes["node"])


def load_field(
    spark: SparkSession, path: str | Sequence[str], name: str | Sequence[str], grid: Grid | None = None, topology: Mapping[str, str] | None = None, grid_file: str | None = None,
    location: str | None = None, tz_offset: float | None | str = "file", origin=None, displacement: timedelta | None = None, fill_value: float = 0.0, sigma: Sigma | None = None,
) -> Field:
    """One field at its location (S-06), of one file or of several along the time dimension (S-01); grid_file: where the grid is in another file (S-02).

    name: of a variable, or names to look for in this order, as long or standard names too (S-33).
    """
    paths = [path] if isinstance(path, str) else list(path)
    h = cdf.read_header(paths[0])
    v = variables_of(h)
    name = name if isinstance(name, str) else metadata.default_name(v, name, name)
    meta = v[name]
    home = grid_file or paths[0]
    grid = grid or load_grid(spark, home, topology)
    location = location or location_of(meta, v, grid, {} if isinstance(grid, RectGrid) else _shapes(home, topology))
    if location is None:
        raise ValueError(f"{name} fits no location of the grid")
    spatial = 1 if isinstance(grid, TriGrid) else 2
    lead = list(meta.dims[:-spatial])
    when = metadata.time_variable(v, name)
    how = {"tz_offset": tz_offset, "origin": origin, "displacement": displacement}
    time = level = None
    if when in lead:
        axis = next((n for n in (when, *v) if n in v and tuple(v[n].dims) == (when,) and "since" in str(v[n].attrs.get("units", ""))), None)
        if axis:
            one = load_time(paths[0], h, axis, tz_offset)
            time = replace(one, times=tuple(t for p in paths for t in load_time(p, cdf.read_header(p), axis).times))
            time = time.with_origin(origin) if origin is not None else time
            time = time.displace(displacement) if displacement is not None else time
    rest = [d for d in lead if d != when]
    layers = False
    size = meta.shape[meta.dims.index(rest[0])] if rest else 1
    if rest and size != 1:
        levels = next((n for n in metadata.DEPTH_LEVELS if n in v and tuple(v[n].dims) == (rest[0],)), None)
        if levels:
            level = depth.Levels.loaded(_read(paths[0], h, levels).tolist())
        else:
            level, layers = sigma, False
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # no depth at all is an error below
                either = {**variables_of(cdf.read_header(home)), **v}
                kind = metadata.depth_kind(either) if level is None else "given"
            if level is None and kind in ("roms", "fvcom"):
                terms = ("s_w", "s_rho") if kind == "roms" else ("siglev", "siglay")
                if size in (either[terms[0]].shape[0], either[terms[1]].shape[0]):
                    level = load_sigma(spark, paths, grid, kind, home, topology, **how)
            if level is not None:
                layers = size == len(level) - 1
                if size not in (len(level), len(level) - 1):
                    raise ValueError(f"{name}: {size} levels fit neither the levels nor the layers of the depth")
    loose = [d for d in (rest[1:] if level is not None else rest) if meta.shape[meta.dims.index(d)] != 1]
    if loose:
        raise ValueError(f"no levels for the dimension {', '.join(loose)}")
    df = cdf.load_variable(spark, paths, name)
    cols = [_element(grid, location, meta).cast("long").alias("elem")]
    if time is not None:
        cols.append(F.col("t_idx"))
    if level is not None:
        cols.append(_idx(1 + lead.index(rest[0])).alias("k"))
    return Field(name, grid, df.select(*cols, "value"), time, level, meta.attrs.get("units"), location, fill_value, {k: str(x) for k, x in meta.attrs.items()}, layers)


def _element(grid: Grid, location: str, meta: metadata.Meta) -> Column:
    if isinstance(grid, TriGrid):
        return _idx(-1)
    if isinstance(grid, QuadGrid):
        return sgrid.id_of(_idx(-2), _idx(-1))
    less = 0 if location == "node" else 1
    n_x, n_y = len(grid.xs) - less, len(grid.ys) - less
    return (_idx(-2) * n_x + _idx(-1)) if rgrid.orientation(None, meta.shape, None, None, n_x, n_y) == "yx" else (_idx(-1) * n_x + _idx(-2))


def load_vector(spark: SparkSession, path: str | Sequence[str], names: Sequence[str] | None = None, grid: Grid | None = None, **kw) -> VectorField:
    """Components of a vector on one grid, each at its own location (S-07). Without names: the first pair of VECTOR_NAMES that the file has."""
    paths = [path] if isinstance(path, str) else list(path)
    v = variables_of(cdf.read_header(paths[0]))
    if names is None:
        names = next((p for p in VECTOR_NAMES if all(n in v for n in p)), None)
        if names is None:
            raise ValueError("no components of a vector found")
    grid = grid or load_grid(spark, kw.get("grid_file") or paths[0], kw.get("topology"))
    fields: dict[str, Field] = {}
    for n in names:
        shared = next((f.depth for f in fields.values() if isinstance(f.depth, Sigma)), None)
        fields[n] = load_field(spark, paths, n, grid, sigma=shared, **kw)
    return VectorField(fields)


def load_dataset(spark: SparkSession, path: str | None = None, topology: Mapping[str, str] | None = None, grid_file: str | None = None, variable_files: Sequence[str] = ()) -> Dataset:
    """Grid, fields at all locations and attributes (S-02, S-03, S-05). One file, or a grid file and files of variables."""
    home = grid_file or path
    if home is None:
        raise ValueError("a file, or a grid file")
    grid = load_grid(spark, home, topology)
    shapes = {} if isinstance(grid, RectGrid) else _shapes(home, topology)
    fields: dict[str, Field] = {}
    attributes: dict[str, str] = {}
    for file in dict.fromkeys([*([path] if path else []), *variable_files]):
        h = cdf.read_header(file)
        v = variables_of(h)
        attributes |= {k: str(x) for k, x in h.attrs.items()}
        names = {n for pairs in (metadata.NODE_PAIRS, metadata.CENTER_PAIRS, metadata.EDGE1_PAIRS, metadata.EDGE2_PAIRS) for pair in pairs for n in pair}
        names |= {n for group in metadata.MASKS.values() for n in group} | set(metadata.FACE_NAMES) | set(metadata.DEPTH_LEVELS) | set((topology or {}).values()) | {"siglay", "siglev"}
        for name in metadata.discovered({n: m for n, m in v.items() if n not in names}, lambda m, v=v: location_of(m, v, grid, shapes)):
            try:
                shared = next((f.depth for f in fields.values() if isinstance(f.depth, Sigma)), None)
                fields[name] = load_field(spark, file, name, grid, topology, home, sigma=shared)
            except ValueError as e:
                warnings.warn(f"{name}: {e}", stacklevel=2)
    return Dataset(grid, fields, attributes)


# ---- writers


def save(dataset: Dataset, path: str, version: int = 2) -> None:
    """K-01: by the kind of its grid."""
    if isinstance(dataset.grid, TriGrid):
        save_ugrid(path, dataset.grid.nodes, dataset.grid.faces, dataset.variables, version, edges=dataset.grid.edges, boundaries=dataset.grid.boundaries)
    elif isinstance(dataset.grid, QuadGrid):
        save_sgrid(path, dataset.grid.nodes, dataset.variables, version, dataset.grid)
    elif isinstance(dataset.grid, RectGrid):
        save_rgrid(path, dataset.grid, dataset.variables, version)
    else:
        raise ValueError("a grid is needed")


def save_ugrid(path: str, nodes: DataFrame, faces: DataFrame, fields: Mapping[str, Field] | None = None, version: int = 2, name: str = "mesh", edges: DataFrame | None = None, boundaries: DataFrame | None = None) -> None:
    """A UGRID file (K-01, K-02, K-03): topology, connectivity from 0, coordinates and fields at nodes and faces. One file, written by the driver from arrays."""
    own = nodes.orderBy("node").select("lon", "lat").toArrow()
    table = faces.orderBy("face").select("nodes").toArrow().column(0).to_pylist()
    width = max((len(x) for x in table), default=3)
    full = np.full((len(table), width), -1, "i4")
    for k, row in enumerate(table):
        full[k, : len(row)] = row
    at = [f"{name}_node_lon", f"{name}_node_lat"]
    dims: dict[str, int | None] = {f"{name}_num_node": own.num_rows, f"{name}_num_face": len(table), f"{name}_num_vertices": width, "two": 2}
    top = {"cf_role": "mesh_topology", "topology_dimension": 2, "node_coordinates": " ".join(at), "face_node_connectivity": f"{name}_face_nodes"}
    out = {name: ((), np.int32(0), top), f"{name}_face_nodes": ((f"{name}_num_face", f"{name}_num_vertices"), full, {"cf_role": "face_node_connectivity", "start_index": 0, "_FillValue": -1})}
    for part, rows in (("edge", edges), ("boundary", boundaries)):
        if rows is not None:
            pairs = rows.orderBy(part if part in rows.columns else "n0").select("n0", "n1").toArrow()
            dims[f"{name}_num_{part}"] = pairs.num_rows
            top[f"{part}_node_connectivity"] = f"{name}_{part}_nodes"
            out[f"{name}_{part}_nodes"] = ((f"{name}_num_{part}", "two"), np.stack([c.to_numpy() for c in pairs.columns], 1).astype("i4"), {"cf_role": f"{part}_node_connectivity", "start_index": 0})
    for k, (n, kind, unit) in enumerate(((at[0], "longitude", "degrees_east"), (at[1], "latitude", "degrees_north"))):
        out[n] = ((f"{name}_num_node",), own.column(k).to_numpy().astype(float), {"standard_name": kind, "units": unit})
    sizes = {"node": own.num_rows, "face": len(table)}
    for n, f in (fields or {}).items():
        if f.location not in sizes:
            raise ValueError(f"{n}: location {f.location} is not written")
        _add_field(out, dims, n, f, (f"{name}_num_{f.location}",), (sizes[f.location],), lambda e: (e,), {"mesh": name, **({"coordinates": " ".join(at)} if f.location == "node" else {})})
    cdf.write(path, dims, out, {"Conventions": "CF-1.6, UGRID-1.0"}, version)


def save_sgrid(path: str, nodes: DataFrame, fields: Mapping[str, Field] | None = None, version: int = 2, grid: QuadGrid | None = None) -> None:
    """An SGRID file (K-04): topology with paddings, coordinates and fields of all locations."""
    grid = grid or QuadGrid(nodes)
    nj, ni = (x + 1 for x in nodes.agg(F.max("j"), F.max("i")).first())
    names = {"node": ("eta_node", "xi_node"), "center": ("eta_cell", "xi_cell"), "edge1": ("eta_edge1", "xi_node"), "edge2": ("eta_node", "xi_edge2")}
    more = {"none": -1, "low": 0, "high": 0, "both": 1}
    pads = {place: {d: grid.padding.get(place, {}).get(d, "none") for d in ("j", "i")} for place in ("center", "edge1", "edge2")}
    shapes = {"node": (nj, ni), "center": (nj + more[pads["center"]["j"]], ni + more[pads["center"]["i"]]), "edge1": (nj + more[pads["edge1"]["j"]], ni), "edge2": (nj, ni + more[pads["edge2"]["i"]])}
    dims: dict[str, int | None] = {}
    for place, shape in shapes.items():
        dims |= dict(zip(names[place], shape, strict=True))
    top = {
        "cf_role": "grid_topology", "topology_dimension": 2, "node_dimensions": "xi_node eta_node", "node_coordinates": "node_lon node_lat",
        "face_dimensions": f"xi_cell: xi_node (padding: {pads['center']['i']}) eta_cell: eta_node (padding: {pads['center']['j']})",
        "edge1_dimensions": f"xi_node eta_edge1: eta_node (padding: {pads['edge1']['j']})", "edge2_dimensions": f"xi_edge2: xi_node (padding: {pads['edge2']['i']}) eta_node",
    }
    out = {"grid": ((), np.int32(0), top)}
    for place, own in (("node", nodes), ("center", grid.centers), ("edge1", grid.edge1), ("edge2", grid.edge2)):
        if own is None:
            continue
        t = own.select("j", "i", "lon", "lat").toArrow()
        if place != "node":
            top[f"{'face' if place == 'center' else place}_coordinates"] = f"{place}_lon {place}_lat"
        for n in ("lon", "lat"):
            a = np.zeros(shapes[place])
            a[t.column("j").to_numpy(), t.column("i").to_numpy()] = t.column(n).to_numpy()
            out[f"{place}_{n}"] = (names[place], a, {"standard_name": {"lon": "longitude", "lat": "latitude"}[n]})
    for n, f in (fields or {}).items():
        place = sgrid.LOCATIONS[f.location]
        _add_field(out, dims, n, f, names[place], shapes[place], lambda e: (e >> 32, e & 0xFFFFFFFF), {"grid": "grid", "location": place})
    cdf.write(path, dims, out, {"Conventions": "CF-1.6, SGRID-0.3"}, version)


def save_rgrid(path: str, grid: RectGrid, fields: Mapping[str, Field] | None = None, version: int = 2) -> None:
    """Axes and fields at nodes of a rectilinear grid."""
    nx, ny = len(grid.xs), len(grid.ys)
    dims: dict[str, int | None] = {"lat": ny, "lon": nx}
    out = {"lon": (("lon",), np.array(grid.xs), {"units": "degrees_east"}), "lat": (("lat",), np.array(grid.ys), {"units": "degrees_north"})}
    for n, f in (fields or {}).items():
        if f.location != "node":
            raise ValueError(f"{n}: location {f.location} is not written")
        _add_field(out, dims, n, f, ("lat", "lon"), (ny, nx), lambda e: (e // nx, e % nx), {})
    cdf.write(path, dims, out, {"Conventions": "CF-1.6", "grid_type": "rectangular"}, version)


def _add_field(out: dict, dims: dict, name: str, f: Field, space: Sequence[str], shape: tuple[int, ...], index, attrs: Mapping) -> None:
    lead: list[tuple[str, int]] = []
    if f.time is not None:
        lead.append(("time", len(f.time)))
        dims.setdefault("time", None)
        out.setdefault("time", (("time",), np.array([(t - f.time.times[0]).total_seconds() for t in f.time.times]), {"units": f"seconds since {f.time.times[0].isoformat()}{timefn.offset_text(f.time.tz_offset)}"}))
    if f.depth is not None:
        if not isinstance(f.depth, depth.Levels) or f.layers:
            raise ValueError(f"{name}: fields on sigma depths and layers are not written")
        lead.append(("depth", len(f.depth.depths)))
        dims["depth"] = len(f.depth.depths)
        out.setdefault("depth", (("depth",), np.array(f.depth.depths), {"units": "m", "positive": "down"}))
    a = np.full((*[n for _, n in lead], *shape), -1e34)
    keys = [c for c in ("t_idx", "k") if c in f.data.columns]
    t = f.data.where("value is not null").select(*keys, "elem", "value").toArrow()
    a[(*[t.column(c).to_numpy() for c in keys], *index(t.column("elem").to_numpy()))] = t.column("value").to_numpy()
    out[name] = ((*[d for d, _ in lead], *space), a, {"location": f.location, "_FillValue": -1e34, **attrs, **({"units": f.units} if f.units else {})})


__all__ = ["describe", "describe_table", "load_dataset", "load_field", "load_grid", "load_mask", "load_mesh", "load_sigma", "load_time", "load_vector", "save", "save_rgrid", "save_sgrid", "save_ugrid"]
