"""Fields on grids: the point query, vector fields, regridding, file loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import digitize, lerp, with_mask_policy
from . import depth as depths
from . import join, rgrid, sgrid, ugrid
from .timeaxis import TimeAxis


@dataclass(frozen=True)
class Stencil:
    """The elements that a value at a point is made of, with their weights, and what a masked one does (I-20)."""

    elems: list[Column]
    weights: list[Column]
    policy: str

    def total(self, values: Sequence[Column]) -> Column:
        return with_mask_policy(values, self.weights, self.policy)


def _unknown(location: str, grid: str) -> ValueError:
    return ValueError(f"location {location} is not on a {grid} grid")


@dataclass(frozen=True)
class RectGrid:
    xs: tuple[float, ...]
    ys: tuple[float, ...]
    off_grid = 0.0

    def located(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """points plus their cell and place in it, null off the grid; the upper ends are included (I-22)."""
        inside = F.col(x).between(float(self.xs[0]), float(self.xs[-1])) & F.col(y).between(float(self.ys[0]), float(self.ys[-1]))
        cut = lambda c, axis: F.when(inside, F.greatest(F.least(digitize(F.col(c), axis) - 1, F.lit(len(axis) - 2)), F.lit(0)))
        out = points.withColumns({"_gi": cut(x, self.xs), "_gj": cut(y, self.ys)})
        at = lambda v, k: F.get(F.array(*[F.lit(float(z)) for z in v]), k)
        share = lambda c, v, k: (F.col(c) - at(v, F.col(k))) / (at(v, F.col(k) + 1) - at(v, F.col(k)))
        return out.withColumns({"_gp": share(x, self.xs, "_gi"), "_gq": share(y, self.ys, "_gj")})

    @property
    def outside(self) -> Column:
        return F.col("_gi").isNull()

    def stencil(self, location: str) -> Stencil:
        n, p, q, i, j = len(self.xs), F.col("_gp"), F.col("_gq"), F.col("_gi").cast("long"), F.col("_gj").cast("long")
        if sgrid.LOCATIONS.get(location) == "center":
            return Stencil([j * (n - 1) + i], [F.lit(1.0)], "mask")
        if location != "node":
            raise _unknown(location, "rectilinear")
        e = j * n + i
        return Stencil([e, e + 1, e + n, e + n + 1], [(1 - p) * (1 - q), p * (1 - q), (1 - p) * q, p * q], "mask")

    def targets(self, spark: SparkSession, location: str = "node") -> DataFrame:
        """elem, lon, lat of the places of a location."""
        if sgrid.LOCATIONS.get(location) == "center":
            return rgrid.centers(spark, self.xs, self.ys).select((F.col("j") * (len(self.xs) - 1) + F.col("i")).cast("long").alias("elem"), "lon", "lat")
        if location != "node":
            raise _unknown(location, "rectilinear")
        return rgrid.node_points(spark, self.xs, self.ys).select((F.col("j") * len(self.xs) + F.col("i")).cast("long").alias("elem"), "lon", "lat")


@dataclass(frozen=True)
class TriGrid:
    faces: DataFrame
    nodes: DataFrame
    edges: DataFrame | None = None
    boundaries: DataFrame | None = None
    off_grid = 0.0

    def located(self, points: DataFrame, x: str, y: str) -> DataFrame:
        out = ugrid.with_weights(points, self.faces, self.nodes, x, y)
        for c in ("face", *(f"{v}{k}" for v in "nw" for k in range(3))):
            out = out.withColumnRenamed(c, f"_g{c}")
        return out

    @property
    def outside(self) -> Column:
        return F.col("_gface").isNull()

    def stencil(self, location: str) -> Stencil:
        if location == "face":
            return Stencil([F.col("_gface").cast("long")], [F.lit(1.0)], "mask")
        if location != "node":
            raise _unknown(location, "triangular")
        return Stencil([F.col(f"_gn{k}") for k in range(3)], [F.col(f"_gw{k}") for k in range(3)], "mask")

    def targets(self, spark: SparkSession, location: str = "node") -> DataFrame:
        if location == "face":
            return ugrid.centroids(self.faces, self.nodes).select(F.col("face").cast("long").alias("elem"), "lon", "lat")
        if location != "node":
            raise _unknown(location, "triangular")
        return self.nodes.select(F.col("node").cast("long").alias("elem"), "lon", "lat")


@dataclass(frozen=True)
class QuadGrid:
    """padding: location -> dimension (j, i) -> none, low, high or both. centers, edge1, edge2: j, i, lon, lat (X-04). coast: j, i, masked at centers (I-19)."""

    nodes: DataFrame
    mask: DataFrame | None = None
    padding: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    centers: DataFrame | None = None
    edge1: DataFrame | None = None
    edge2: DataFrame | None = None
    coast: DataFrame | None = None
    off_grid = None

    def located(self, points: DataFrame, x: str, y: str) -> DataFrame:
        out = sgrid.locate_logical(points, sgrid.cells(self.nodes, self.mask), x, y)
        for c in ("j", "i", "l", "m"):
            out = out.withColumnRenamed(c, f"_g{c}")
        return out

    @property
    def outside(self) -> Column:
        return F.col("_gi").isNull()

    def stencil(self, location: str) -> Stencil:
        location = sgrid.LOCATIONS.get(location, location)
        j, i, ll, m = (F.col(f"_g{c}") for c in ("j", "i", "l", "m"))
        if location == "node":
            return Stencil([sgrid.id_of(j + a, i + b) for a, b in sgrid.CORNERS], [1.0 - ll - m + ll * m, m - ll * m, ll * m, ll - ll * m], "skip")
        if location not in ("center", "edge1", "edge2"):
            raise _unknown(location, "curvilinear")
        pad = self.padding.get(location, {})
        j, i = j + sgrid.shift_for(pad.get("j", "none")), i + sgrid.shift_for(pad.get("i", "none"))
        if location == "center":
            return Stencil([sgrid.id_of(j, i)], [F.lit(1.0)], "mask")
        a, step = (ll, (0, 1)) if location == "edge1" else (m, (1, 0))
        return Stencil([sgrid.id_of(j, i), sgrid.id_of(j + step[0], i + step[1])], [1.0 - a, a], "zero")

    def masked_coast(self, location: str, data: DataFrame) -> DataFrame:
        """data (elem, ..., value) of an edge location without the values of edges between land and water."""
        if self.coast is None or location not in ("edge1", "edge2"):
            return data
        j, i = sgrid.from_id("elem")
        keep = [c for c in data.columns if c != "value"]
        rows = data.withColumns({"j": j, "i": i})
        edges = sgrid.coastal_edges(rows.select("j", "i").distinct(), self.coast, "i" if location == "edge1" else "j")
        out = rows.join(join.small(edges.withColumn("_shore", F.lit(True))), ["j", "i"], "left")
        return out.select(*keep, F.when(F.col("_shore").isNull(), F.col("value")).alias("value"))

    def places(self, location: str) -> DataFrame:
        """X-04: j, i, lon, lat of a location; other names are an error. Centers that no file gives are means of their corners."""
        name = sgrid.LOCATIONS.get(location)
        if name is None:
            raise _unknown(location, "curvilinear")
        if name == "node":
            return self.nodes.select("j", "i", "lon", "lat")
        own = {"center": self.centers, "edge1": self.edge1, "edge2": self.edge2}[name]
        if own is None and name == "center":
            mean = lambda v: F.aggregate("c", F.lit(0.0), lambda a, p: a + p[v]) / 4.0
            return sgrid.gather_corners(self.nodes, ("lon", "lat")).select("j", "i", mean("lon").alias("lon"), mean("lat").alias("lat"))
        if own is None:
            raise ValueError(f"the grid has no coordinates of {name}")
        return own.select("j", "i", "lon", "lat")

    def targets(self, spark: SparkSession, location: str = "node") -> DataFrame:
        return self.places(location).select(sgrid.id_of().alias("elem"), "lon", "lat")


Grid = RectGrid | TriGrid | QuadGrid


@dataclass(frozen=True)
class Field:
    """A scalar field at a location of a grid (X-01): data (elem long, value double), with t_idx and k where it has time and depth.

    location: node, center (face on triangles), edge1 or edge2; elem counts places of that location: node and face ids, rows first on
    rectilinear grids, sgrid.id_of(j, i) on curvilinear ones. layers: values stand for the layer between two levels of depth. Null
    values are masked. data stays lazy.
    """

    name: str
    grid: Grid
    data: DataFrame
    time: TimeAxis | None = None
    depth: depths.Levels | Sigma | None = None
    units: str | None = None
    location: str = "node"
    fill_value: float = 0.0
    attributes: Mapping[str, str] = field(default_factory=dict)
    layers: bool = False

    def __post_init__(self):
        self.grid.stencil(self.location)
        for c, axis in (("t_idx", self.time), ("k", self.depth)):
            if (c in self.data.columns) != (axis is not None):
                raise ValueError(f"column {c} and its axis go together")

    @classmethod
    def constant(cls, spark: SparkSession, value: float, name: str = "constant") -> Field:
        """S-30"""
        xs, ys = (-360.0, 0.0, 360.0), (-89.95, 0.0, 89.95)
        return cls(name, RectGrid(xs, ys), spark.range(9).select(F.col("id").alias("elem"), F.lit(float(value)).alias("value")))

    def at(self, points: DataFrame, lon: str = "lon", lat: str = "lat", z: str = "z", t: str = "t", extrapolate: bool = False, strict: bool = True, unmask: bool = False, name: str | None = None) -> DataFrame:
        """points plus the field's value (I-01): one row per point, whatever its time and depth."""
        return at_points({name or self.name: self}, points, lon, lat, z, t, extrapolate, strict, unmask)

    def sliced(self, t_idx: int | None = None, k: int | None = None) -> Field:
        """F-03: one time step or level; the filter reaches the scan."""
        out = self
        if t_idx is not None:
            out = replace(out, data=out.data.where(F.col("t_idx") == t_idx).drop("t_idx"), time=None)
        if k is not None:
            out = replace(out, data=out.data.where(F.col("k") == k).drop("k"), depth=None, layers=False)
        return out

    def info(self) -> dict:
        """F-22"""
        lo, hi, n = self.data.agg(F.min("value"), F.max("value"), F.count("value")).first()
        return {"name": self.name, "units": self.units, "location": self.location, "min": lo, "max": hi, "values": n, "times": len(self.time) if self.time else 0}


@dataclass(frozen=True)
class Sigma:
    """Depths that follow the bottom and the surface: each point has a water column of its own (I-08 to I-12).

    h and zeta (None: 0) are fields; they may lie at other locations, and on another grid, than the data. With s, cs and hc the levels are
    those of ROMS (bottom first); with levels (elem, k, value at nodes of h's grid, count of them in n_levels) those of FVCOM (surface
    first). The profile is taken at the query's own time, for both steps of a bracket (J-09).
    """

    h: Field
    zeta: Field | None = None
    s: tuple[float, ...] = ()
    cs: tuple[float, ...] = ()
    hc: float = 0.0
    vtransform: int = 2
    levels: DataFrame | None = None
    n_levels: int = 0
    surface: str = "extrapolate"
    bottom: str = "mask"

    def __post_init__(self):
        if (self.levels is None) == (not self.s):
            raise ValueError("s levels or levels at nodes: one of them")
        if self.levels is None and len(self.s) != len(self.cs):
            raise ValueError("s and cs go together")

    def __len__(self) -> int:
        return self.n_levels if self.levels is not None else len(self.s)

    @property
    def surface_index(self) -> int:
        return 0 if self.levels is not None else len(self.s) - 1

    @property
    def bottom_index(self) -> int:
        return len(self) - 1 - self.surface_index

    def weights(self, out: DataFrame, located: Grid, z: str, lon: str, lat: str, t: str, extrapolate: bool, strict: bool, k: str, a: str) -> DataFrame:
        """out plus k and a (I-08), null where no water column is or a boundary condition masks."""
        if len(self) == 1:
            one, none = depths.surface_only()
            return out.withColumns({k: one, a: none})
        taken = set(out.columns)
        fields = {"_sh": self.h} | ({"_sz": self.zeta} if self.zeta is not None else {})
        for name, f in fields.items():
            args = ({name: f}, out, lon, lat, z, t, extrapolate, strict)
            out = _evaluated(*args) if _same(f.grid) == _same(located) else _apart(*args)
        h, zeta = F.col("_sh"), F.col("_sz") if self.zeta is not None else F.lit(0.0)
        if self.levels is None:
            below_mean = depths.roms(self.s, self.cs, self.hc, h, zeta, self.vtransform)
        else:
            if _same(self.h.grid) != _same(located):
                raise ValueError("levels at nodes need data on the grid of h")
            below_mean = depths.sigma(F.col("_slev"), h, zeta)
            out = _columns_at(out, self.levels, located.stencil("node"), len(self), "_slev")
        out = out.withColumn("_sp", depths.profile_below_surface(below_mean, zeta))
        kk, alpha = depths.in_profile(F.col(z), F.col("_sp"), self.surface, self.bottom, surface_first=self.levels is not None)
        out = out.withColumns({k: kk, a: alpha})
        return out.drop(*[c for c in ("_sh", "_sz", "_sp", "_slev") if c not in taken])


def _columns_at(out: DataFrame, levels: DataFrame, stencil: Stencil, n: int, name: str) -> DataFrame:
    """out plus an array over levels, each the weighted sum over the stencil's elements; null where one is missing."""
    table = levels.groupBy("elem").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("_v"))
    table = join.small(table)
    for c, e in enumerate(stencil.elems):
        out = out.join(table.select(F.col("elem").alias(f"_ce{c}"), F.col("_v").alias(f"_cv{c}")), e == F.col(f"_ce{c}"), "left")
    level = lambda k: sum((F.get(F.col(f"_cv{c}"), k) * w for c, w in list(enumerate(stencil.weights))[1:]), F.get(F.col("_cv0"), k) * stencil.weights[0])
    out = out.withColumn(name, F.transform(F.array(*map(F.lit, range(n))), level))
    return out.drop(*[f"_c{v}{c}" for v in "ev" for c in range(len(stencil.elems))])


def at_points(fields: Mapping[str, Field], points: DataFrame, lon: str = "lon", lat: str = "lat", z: str = "z", t: str = "t", extrapolate: bool = False, strict: bool = True, unmask: bool = False, located: bool = False) -> DataFrame:
    """points plus a column per field (I-02). Fields on one grid share the location of the points, and fields that share location, time and depth their lookups too.

    A field within the broadcast bound is looked up element by element, with no shuffle or aggregate of the points. A larger one is
    first cut to the steps, levels and elements that the points touch (F-09); if it is still too large it is joined on (element, time step)
    and summed back per point. Off the grid the value is the grid's own (0 or null), but null where the depth masks; masked elements
    follow the grid (I-20); either side of a bracket that is null makes the value null. located: points are grid.located() of the fields' one
    grid already (cached or written, say), and stay so (J-15).
    """
    out = points
    if located:
        if len({_same(f.grid) for f in fields.values()}) > 1:
            raise ValueError("located points lie on one grid")
        out = _evaluated(fields, out, lon, lat, z, t, extrapolate, strict)
    for key, grid in ({} if located else {_same(f.grid): f.grid for f in fields.values()}).items():
        own = {n: f for n, f in fields.items() if _same(f.grid) == key}
        taken = set(out.columns)
        out = _evaluated(own, grid.located(out, lon, lat), lon, lat, z, t, extrapolate, strict)
        out = out.drop(*[c for c in out.columns if c.startswith("_g") and c not in taken])
    if unmask:
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(float(f.fill_value))) for n, f in fields.items()})
    return out


def _same(grid: Grid) -> object:
    """Equal for equal axes, and for one and the same mesh."""
    return grid if isinstance(grid, RectGrid) else id(grid)


def _apart(fields: Mapping[str, Field], out: DataFrame, lon: str, lat: str, z: str, t: str, extrapolate: bool, strict: bool) -> DataFrame:
    """Fields on another grid than the one that out is located on, whose columns stand aside meanwhile."""
    mine = [c for c in out.columns if c.startswith("_g")]
    for c in mine:
        out = out.withColumnRenamed(c, f"_a{c}")
    out = at_points(fields, out, lon, lat, z, t, extrapolate, strict)
    for c in mine:
        out = out.withColumnRenamed(f"_a{c}", c)
    return out


def _evaluated(fields: Mapping[str, Field], out: DataFrame, lon: str, lat: str, z: str, t: str, extrapolate: bool, strict: bool) -> DataFrame:
    """out (located on the fields' grid) plus a column per field."""
    taken = set(out.columns)
    pre = f"_f{sum(c.startswith('_f') for c in taken)}x"
    groups: list[tuple[tuple, dict[str, Field]]] = []
    for n, f in fields.items():
        key = (f.time, f.depth if isinstance(f.depth, depths.Levels) else id(f.depth), f.location, f.layers)
        found = next((g for k, g in groups if k == key), None)
        if found is None:
            groups.append((key, {n: f}))
        else:
            found[n] = f
    brackets: list[tuple[TimeAxis, str]] = []
    heights: list[tuple[object, str]] = []
    for _, own in groups:
        one = next(iter(own.values()))
        at_t = next((n for axis, n in brackets if axis == one.time), None) if one.time else None
        if one.time is not None and at_t is None:
            at_t = f"{pre}t{len(brackets)}"
            held = {c: f"{pre}{c}" for c in ("t_lo", "t_hi", "t_alpha") if c in out.columns}
            out = one.time.bracket(out.withColumnsRenamed(held), t, extrapolate, strict)
            out = out.withColumnsRenamed({"t_lo": f"{at_t}lo", "t_hi": f"{at_t}hi", "t_alpha": f"{at_t}a"}).withColumnsRenamed({v: k for k, v in held.items()})
            brackets.append((one.time, at_t))
        at_z = next((n for axis, n in heights if axis is one.depth or (isinstance(axis, depths.Levels) and axis == one.depth)), None) if one.depth is not None else None
        if one.depth is not None and at_z is None:
            at_z = f"{pre}z{len(heights)}"
            if isinstance(one.depth, Sigma):
                out = one.depth.weights(out, one.grid, z, lon, lat, t, extrapolate, strict, f"{at_z}k", f"{at_z}a")
            else:
                k, a = one.depth.weights(F.col(z))
                out = out.withColumns({f"{at_z}k": k, f"{at_z}a": a})
            heights.append((one.depth, at_z))
        out = _group_values(out, own, at_t, at_z, pre)
    return out.drop(*[c for c in out.columns if c.startswith(pre) and c not in taken])


def _group_values(out: DataFrame, own: dict[str, Field], at_t: str | None, at_z: str | None, pre: str) -> DataFrame:
    """out plus the values of fields that share location, time and depth."""
    one = next(iter(own.values()))
    names, taken = list(own), set(out.columns)
    n_t = len(one.time) if one.time else 1
    n_k = 1 if one.depth is None else (len(one.depth) if isinstance(one.depth, Sigma) else len(one.depth.depths)) - int(one.layers)
    lerped = n_k > 1 and not one.layers
    times, levels = (("lo", "hi") if n_t > 1 else ("lo",)), (("k0", "k1") if lerped else ("k0",))
    k = F.col(f"{at_z}k") if at_z else F.lit(0)
    cut = lambda c: F.greatest(F.least(c, F.lit(n_k - 1)), F.lit(0))
    at = {f"{pre}_lo": F.col(f"{at_t}lo") if n_t > 1 else F.lit(0), f"{pre}_hi": F.col(f"{at_t}hi") if n_t > 1 else F.lit(0)}
    # greatest and least pass over nulls: a level that is masked stays so.
    at |= {f"{pre}_k0": F.when(k.isNotNull(), cut(k)), f"{pre}_k1": F.when(k.isNotNull(), cut(k + 1))}
    stencil = one.grid.stencil(one.location)
    size = len(stencil.elems)
    at |= {f"{pre}_e{c}": e for c, e in enumerate(stencil.elems)} | {f"{pre}_w{c}": w for c, w in enumerate(stencil.weights)}
    out = out.withColumns(at)
    data = None
    for i, f in enumerate(own.values()):
        rows = f.data if not isinstance(f.grid, QuadGrid) else f.grid.masked_coast(f.location, f.data)
        rows = rows.select("elem", *[c for c in ("t_idx", "k") if c in rows.columns], F.col("value").cast("double").alias(f"v{i}"))
        data = rows if data is None else data.join(rows, [c for c in rows.columns if c != f"v{i}"], "full")
    vals = [f"v{i}" for i in range(len(names))]
    local = Stencil([F.col(f"{pre}_e{c}") for c in range(size)], [F.col(f"{pre}_w{c}") for c in range(size)], stencil.policy)
    small = join.is_small(data)
    if not small:
        data = _touched(data, out, pre, size)
        small = join.is_small(data)
    args = (out, data, vals, local, times, levels)
    out = _planes_by_lookup(*args, n_t, n_k, pre) if small else _planes_by_shuffle(*args, pre)
    off = F.lit(one.grid.off_grid).cast("double")
    rows, values = {}, {}
    for i, n in enumerate(names):
        for tt in times:
            p = [F.col(f"{pre}_p{i}{tt}{kk}") for kk in levels]
            rows[f"{pre}_r{i}{tt}"] = lerp(p[0], p[1], F.col(f"{at_z}a")) if lerped else p[0]
        value = F.col(f"{pre}_r{i}lo")
        if n_t > 1:
            value = F.when(F.col(f"{pre}_lo") == F.col(f"{pre}_hi"), value).otherwise(lerp(value, F.col(f"{pre}_r{i}hi"), F.col(f"{at_t}a")))
        value = F.when(k.isNotNull(), F.when(one.grid.outside, off).otherwise(value))
        values[n] = value
    out = out.withColumns(rows).withColumns(values)
    return out.drop(*[c for c in out.columns if c.startswith(f"{pre}_") and c not in taken])


def _touched(data: DataFrame, out: DataFrame, pre: str, size: int) -> DataFrame:
    """data within the ranges of elements, steps and levels that out needs: plain comparisons, so that they reach the source."""
    e = [F.col(f"{pre}_e{c}") for c in range(size)]
    low, high = (F.least(*e), F.greatest(*e)) if size > 1 else (e[0], e[0])
    r = out.agg(F.min(low), F.max(high), F.min(f"{pre}_lo"), F.max(f"{pre}_hi"), F.min(f"{pre}_k0"), F.max(f"{pre}_k1")).first()
    for c, lo, hi in (("t_idx", r[2], r[3]), ("k", r[4], r[5]), ("elem", r[0], r[1])):
        if c in data.columns and lo is not None:
            data = data.where((F.col(c) >= lo) & (F.col(c) <= hi))
    return data


#: Entries of an element that one row of a lookup holds at most; with more, each step is a row of its own, so that rows stay short.
ROW_ENTRIES = 64


def _planes_by_lookup(out: DataFrame, data: DataFrame, vals: list[str], stencil: Stencil, times, levels, n_t: int, n_k: int, pre: str) -> DataFrame:
    """out plus {pre}_p{field}{time}{level}: the weighted sums. The field is broadcast: a row per element, or per element and step, with an array of its entries."""
    stepped = "t_idx" in data.columns and n_t * n_k > ROW_ENTRIES
    t_of = F.col("t_idx") if "t_idx" in data.columns and not stepped else F.lit(0)
    slot = t_of * n_k + (F.col("k") if "k" in data.columns else F.lit(0))
    entry = F.struct(slot.cast("int").alias("s"), *vals)
    table = data.groupBy("elem", *(["t_idx"] if stepped else [])).agg(F.sort_array(F.collect_list(entry)).alias("m"))
    at = {(tt, kk): (F.lit(0) if stepped else F.col(f"{pre}_{tt}")) * n_k + F.col(f"{pre}_{kk}") for tt in times for kk in levels}
    out = out.withColumns({f"{pre}_s{tt}{kk}": x.cast("int") for (tt, kk), x in at.items()})
    entries: dict[str, Column] = {}
    for c, e in enumerate(stencil.elems):
        for n, group in enumerate([(tt,) for tt in times] if stepped else [times]):
            te, ts, tm = (f"{pre}_{x}{c}_{n}" for x in ("te", "tt", "tm"))
            own = table.select(F.col("elem").alias(te), *([F.col("t_idx").alias(ts)] if stepped else []), F.col("m").alias(tm))
            on = (e == F.col(te)) & (F.col(f"{pre}_{group[0]}") == F.col(ts)) if stepped else e == F.col(te)
            out = out.join(F.broadcast(own), on, "left")
            for tt in group:
                for kk in levels:
                    # At its own index where nothing is missing before it, else searched for.
                    m, k = F.col(tm), F.col(f"{pre}_s{tt}{kk}")
                    entries[f"{pre}_x{c}{tt}{kk}"] = F.when(F.get(m, k)["s"] == k, F.get(m, k)).otherwise(_slot_of(tm, k))
    out = out.withColumns(entries)
    planes = {f"{pre}_p{v[1:]}{tt}{kk}": stencil.total([F.col(f"{pre}_x{c}{tt}{kk}")[v] for c in range(len(stencil.elems))]) for v in vals for tt in times for kk in levels}
    return out.withColumns(planes)


def _planes_by_shuffle(out: DataFrame, data: DataFrame, vals: list[str], stencil: Stencil, times, levels, pre: str) -> DataFrame:
    """The same for a field too large to broadcast: one row per point, element and time, one join on (element, time), one aggregate back."""
    t_of = F.col("t_idx") if "t_idx" in data.columns else F.lit(0)
    k_of = F.col("k") if "k" in data.columns else F.lit(0)
    table = data.groupBy(F.col("elem").alias("_de"), t_of.cast("int").alias("_dt")).agg(F.collect_list(F.struct(k_of.cast("int").alias("s"), *vals)).alias("_m"))
    keep, size = out.columns, len(stencil.elems)
    parts = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(tt).alias("tt"), e.alias("e"), F.col(f"{pre}_{tt}").alias("at")) for c, e in enumerate(stencil.elems) for tt in times])
    spread = out.withColumn("_row", F.monotonically_increasing_id()).withColumn("_c", F.explode(parts))
    got = spread.join(table, (F.col("_c.e") == F.col("_de")) & (F.col("_c.at") == F.col("_dt")), "left")
    for kk in levels:
        got = got.withColumn(f"_x{kk}", _slot_of("_m", F.col(f"{pre}_{kk}")))
    aggs = [F.first(F.struct(*keep)).alias("_keep")]
    for c in range(size):
        for v in vals:
            for tt in times:
                for kk in levels:
                    here = F.when((F.col("_c.tt") == tt) & (F.col("_c.c") == c), F.col(f"_x{kk}")[v])
                    aggs.append(F.max(here).alias(f"_y{c}{v}{tt}{kk}"))
    got = got.groupBy("_row").agg(*aggs)
    planes = {}
    out = got.select("_keep.*", *[c for c in got.columns if c.startswith("_y")])
    for v in vals:
        for tt in times:
            for kk in levels:
                planes[f"{pre}_p{v[1:]}{tt}{kk}"] = stencil.total([F.col(f"_y{c}{v}{tt}{kk}") for c in range(size)])
    return out.withColumns(planes).select(*keep, *planes)


def _slot_of(entries: str, at: Column) -> Column:
    return F.get(F.filter(entries, lambda e: e["s"] == at), F.lit(0))


@dataclass(frozen=True)
class VectorField:
    """Component name -> Field (X-02, J-16). Components may lie at different locations (staggered u and v), and even on different grids."""

    components: Mapping[str, Field]

    def __post_init__(self):
        if len(self.components) < 2:
            raise ValueError("a vector field has two components at least")

    def at(self, points: DataFrame, **kw) -> DataFrame:
        return at_points(self.components, points, **kw)

    @property
    def units(self) -> str | list | None:
        u = [f.units for f in self.components.values()]
        return u[0] if len(set(u)) == 1 else u

    @property
    def locations(self) -> dict[str, str]:
        return {n: f.location for n, f in self.components.items()}


def regrid(source: Field, grid: Grid, spark: SparkSession, location: str = "node") -> Field:
    """The field at the nodes, centers or faces of another grid (R-01, R-03), at each of its times and levels. No overlap is an error; edges are not supported.

    Weights are computed once per target; steps and levels ride along as the values of each element.
    """
    if location.startswith("edge"):
        raise NotImplementedError("fields are not regridded to edges")
    if isinstance(source.depth, Sigma):
        depth = regrid_sigma(source.depth, grid, spark)
    else:
        depth = source.depth
    stencil = source.grid.stencil(source.location)
    targets = source.grid.located(grid.targets(spark, location).withColumnRenamed("elem", "_target"), "lon", "lat").where(~source.grid.outside)
    places = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), e.alias("elem"), w.alias("w")) for c, (e, w) in enumerate(zip(stencil.elems, stencil.weights, strict=True))]))
    w = targets.select("_target", places.alias("_z")).select("_target", "_z.c", "_z.elem", "_z.w")
    rows = source.data if not isinstance(source.grid, QuadGrid) else source.grid.masked_coast(source.location, source.data)
    keys = [c for c in ("t_idx", "k") if c in rows.columns]
    got = join.small(w).join(rows, "elem")
    one = [F.max(F.when(F.col("c") == c, F.col("value"))).alias(f"_v{c}") for c in range(len(stencil.elems))]
    own = [F.max(F.when(F.col("c") == c, F.col("w"))).alias(f"_w{c}") for c in range(len(stencil.elems))]
    out = got.groupBy(*keys, F.col("_target").alias("elem")).agg(*one, *own)
    value = with_mask_policy([F.col(f"_v{c}") for c in range(len(one))], [F.coalesce(F.col(f"_w{c}"), F.lit(0.0)) for c in range(len(one))], stencil.policy)
    data = out.select(*keys, "elem", value.alias("value"))
    if w.isEmpty():
        raise ValueError("grids do not overlap")
    return replace(source, grid=grid, data=data, location=location, depth=depth)


def regrid_sigma(depth: Sigma, grid: Grid, spark: SparkSession) -> Sigma:
    """The same levels over the bathymetry and surface on another grid (R-02). Levels at nodes are regridded too."""
    h = regrid(depth.h, grid, spark)
    zeta = regrid(depth.zeta, grid, spark) if depth.zeta is not None else None
    if depth.levels is None:
        return replace(depth, h=h, zeta=zeta)
    levels = regrid(Field("levels", depth.h.grid, depth.levels, depth=depths.Levels(tuple(map(float, range(len(depth)))))), grid, spark)
    return replace(depth, h=h, zeta=zeta, levels=levels.data)


@dataclass(frozen=True)
class Dataset:
    """A grid, fields and attributes (S-03, S-29)."""

    grid: object = None
    variables: Mapping[str, Field] = field(default_factory=dict)
    attributes: Mapping[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Field:
        return self.variables[name]

    def by_attribute(self, attr: str, value: str) -> list[Field]:
        """F-02"""
        return [v for v in self.variables.values() if v.attributes.get(attr) == value]

    def info(self) -> dict:
        return {"grid": type(self.grid).__name__, "variables": sorted(self.variables), "attributes": dict(self.attributes)}


def point_rows(spark: SparkSession, points: Sequence) -> DataFrame:
    """pid, lon, lat[, z] of an array-like (M-08): one point, rows of points, or columns of coordinates; too wide both ways is an error."""
    import numpy as np

    a = np.asarray(points)
    if a.dtype.kind not in "iuf":
        raise TypeError("points must be numbers")
    a = np.squeeze(a.astype(float))
    if a.ndim == 1:
        a = a.reshape(1, -1)
    if a.shape[1] > 3:
        if a.shape[0] > 3:
            raise ValueError("points are N x 2 or N x 3")
        a = a.T
    if a.shape[1] not in (2, 3):
        raise ValueError("points have 2 or 3 coordinates")
    names = ["lon", "lat", "z"][: a.shape[1]]
    rows = [(k, *map(float, r)) for k, r in enumerate(a)]
    return spark.createDataFrame(rows, "pid long, " + ", ".join(f"{n} double" for n in names))
