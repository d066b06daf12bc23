"""Unstructured grids: node (node, lon, lat), face (face, nodes array<int>), edges and boundaries (id, n0, n1)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import barycentric
from ..sources.scratch import written
from . import join


def with_polygons(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """faces plus poly: their corners' coordinates in order (J-10)."""
    at = faces.select("face", F.posexplode("nodes").alias("_k", "_n"))
    got = at.join(nodes.select(F.col("node").alias("_node"), "lon", "lat"), F.col("_n") == F.col("_node"))
    poly = got.groupBy("face").agg(F.sort_array(F.collect_list(F.struct("_k", "lon", "lat"))).alias("_p"))
    return faces.join(poly.select("face", F.transform("_p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("poly")), "face")


def cells(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_polygons(faces, nodes).select(F.col("face").cast("long").alias("cell"), "poly", "nodes")


def locate(points: DataFrame, faces: DataFrame, nodes: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """points plus face (J-01): the smallest id of the faces that hold it, null off the grid."""
    return join.locate(points, cells(faces, nodes), x, y, "face")


def with_weights(points: DataFrame, faces: DataFrame, nodes: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """points plus face, its nodes n0, n1, n2 and their barycentric weights w0, w1, w2 (I-13): locate() and weights() in one join. Triangles only."""
    out = join.locate(points, cells(faces, nodes).withColumnRenamed("poly", "_poly").withColumn("poly", F.col("_poly")), x, y, "face", keep=("nodes", "_poly"))
    return _weighted(out.withColumnRenamed("nodes", "_nodes"), x, y)


def _weighted(out: DataFrame, x: str, y: str) -> DataFrame:
    p = [(F.get("_poly", F.lit(k))["lon"], F.get("_poly", F.lit(k))["lat"]) for k in range(3)]
    w = barycentric(F.col(x), F.col(y), p)
    return out.withColumns({f"n{k}": F.get("_nodes", F.lit(k)).cast("long") for k in range(3)} | {f"w{k}": w[k] for k in range(3)}).drop("_f", "_nodes", "_poly")


def weights(located: DataFrame, faces: DataFrame, nodes: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """located (with face) plus its nodes n0, n1, n2 and their barycentric weights w0, w1, w2 (I-13, J-15); null off the grid. Triangles only."""
    tri = with_polygons(faces, nodes).select(F.col("face").cast("long").alias("_f"), F.col("nodes").alias("_nodes"), F.col("poly").alias("_poly"))
    return _weighted(located.join(join.small(tri, faces), F.col("face") == F.col("_f"), "left"), x, y)


def face_values(faces: DataFrame, field: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each face the node values in corner order: (*by, face, values). field: (*by, node, value)."""
    at = faces.select("face", F.posexplode("nodes").alias("_k", "_n"))
    got = join.small(at, faces).join(field, F.col("_n") == F.col("node"))
    out = got.groupBy(*by, "face").agg(F.sort_array(F.collect_list(F.struct("_k", F.col("value").alias("v")))).alias("_v"))
    return out.select(*by, F.col("face").cast("long").alias("face"), F.transform("_v", lambda v: v["v"]).alias("values"))


def interpolate_nodes(points: DataFrame, faces: DataFrame, nodes: DataFrame, field: DataFrame, x: str = "lon", y: str = "lat", name: str = "value") -> DataFrame:
    """points plus the linear interpolation of a node field (I-14): 0 off the grid. A null node masks the value."""
    w = with_weights(points, faces, nodes, x, y)
    table = face_values(faces, field).select(F.col("face").alias("_f"), F.col("values").alias("_v"))
    out = w.join(join.small(table, faces), F.col("face") == F.col("_f"), "left")
    value = sum((F.get("_v", F.lit(k)) * F.col(f"w{k}") for k in range(1, 3)), F.get("_v", F.lit(0)) * F.col("w0"))
    return out.withColumn(name, F.when(F.col("face").isNull(), F.lit(0.0)).otherwise(value)).drop("_f", "_v")


def gather_faces(points: DataFrame, faces: DataFrame, nodes: DataFrame, field: DataFrame, x: str = "lon", y: str = "lat", name: str = "value") -> DataFrame:
    """points plus the value of their face (I-14, J-12): 0 off the grid. field: face, value."""
    table = field.select(F.col("face").cast("long").alias("_f"), F.col("value").alias("_v"))
    out = locate(points, faces, nodes, x, y).join(join.small(table), F.col("face") == F.col("_f"), "left")
    return out.withColumn(name, F.when(F.col("face").isNull(), F.lit(0.0)).otherwise(F.col("_v"))).drop("_f", "_v")


def face_edges(faces: DataFrame) -> DataFrame:
    """One row per side of a face: face, slot, p, q in the face's own direction, and lo, hi."""
    n = F.size("nodes")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("nodes", k).alias("p"), F.get("nodes", (k + 1) % n).alias("q")))
    out = faces.select("face", F.posexplode(sides).alias("slot", "_s")).select("face", "slot", "_s.p", "_s.q")
    return out.withColumns({"lo": F.least("p", "q"), "hi": F.greatest("p", "q")})


def edges(faces: DataFrame) -> DataFrame:
    """Distinct edges (A-05, A-07): n0 < n1."""
    return face_edges(faces).select(F.col("lo").alias("n0"), F.col("hi").alias("n1")).distinct()


def boundaries(faces: DataFrame) -> DataFrame:
    """Sides of one face only (A-06), in that face's direction: n0, n1, face."""
    one = face_edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min(F.struct("face", "p", "q")).alias("s")).where("n = 1")
    return one.select(F.col("s.p").alias("n0"), F.col("s.q").alias("n1"), F.col("s.face").alias("face"))


def neighbours(faces: DataFrame) -> DataFrame:
    """face, slot, other: the face across each side (J-14), null at a boundary; of several, the smallest id."""
    sides = face_edges(faces).select("face", "slot", "lo", "hi")
    by = sides.groupBy("lo", "hi").agg(F.sort_array(F.collect_set("face")).alias("_all"))
    out = sides.join(by, ["lo", "hi"])
    return out.select("face", "slot", F.get(F.filter("_all", lambda f: f != F.col("face")), F.lit(0)).alias("other"))


def face_edge_ids(faces: DataFrame, edge: DataFrame) -> DataFrame:
    """face, slot, edge (J-13): the id of the edge along each side, null where edge (edge, n0, n1) has none."""
    own = edge.groupBy(F.least("n0", "n1").alias("lo"), F.greatest("n0", "n1").alias("hi")).agg(F.min("edge").alias("edge"))
    return face_edges(faces).select("face", "slot", "lo", "hi").join(own, ["lo", "hi"], "left").select("face", "slot", "edge")


def centroids(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """face, lon, lat: mean of the corners (A-01)."""
    mean = lambda c: F.aggregate("poly", F.lit(0.0), lambda a, p: a + p[c]) / F.size("poly")
    return with_polygons(faces, nodes).select("face", mean("lon").alias("lon"), mean("lat").alias("lat"))


def midpoints(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge, n0, n1 plus lon, lat of the middle (A-02)."""
    p, q = (nodes.select(F.col("node").alias(k), F.col("lon").alias(f"{k}x"), F.col("lat").alias(f"{k}y")) for k in ("_a", "_b"))
    out = edge.join(join.small(p), F.col("n0") == F.col("_a")).join(join.small(q), F.col("n1") == F.col("_b"))
    return out.withColumns({"lon": (F.col("_ax") + F.col("_bx")) / 2, "lat": (F.col("_ay") + F.col("_by")) / 2}).drop("_a", "_b", "_ax", "_ay", "_bx", "_by")


def extent(nodes: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row: xmin, xmax, ymin, ymax with a margin given as a share of each side (A-08); longitudes over 180 count from -180."""
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360.0).otherwise(F.col("lon"))
    out = nodes.agg(F.min(lon).alias("xmin"), F.max(lon).alias("xmax"), F.min("lat").alias("ymin"), F.max("lat").alias("ymax"))
    dx, dy = (F.col("xmax") - F.col("xmin")) * margin, (F.col("ymax") - F.col("ymin")) * margin
    return out.select((F.col("xmin") - dx).alias("xmin"), (F.col("xmax") + dx).alias("xmax"), (F.col("ymin") - dy).alias("ymin"), (F.col("ymax") + dy).alias("ymax"))


def checked_faces(faces: DataFrame, n_nodes: int) -> DataFrame:
    """Faces with ids from 0 (A-19): one-based ones (largest id n_nodes, none below 1) are decremented; ids beyond the nodes raise."""
    lo, hi = faces.select(F.explode("nodes").alias("n")).agg(F.min("n"), F.max("n")).first()
    if hi is None:
        return faces
    if hi > n_nodes or lo < -1 or (hi == n_nodes and lo < 1):
        raise ValueError(f"face nodes {lo} to {hi} do not fit {n_nodes} nodes")
    return faces.withColumn("nodes", F.transform("nodes", lambda n: n - 1)) if hi == n_nodes else faces


def check_connectivity(connectivity: DataFrame, faces: DataFrame) -> None:
    """Every face has one slot per corner in connectivity (face, slot, ...) and no other face is there (A-20)."""
    have = connectivity.groupBy("face").agg(F.count("*").alias("n"))
    bad = faces.select("face", F.size("nodes").alias("k")).join(have, "face", "full").where("k is null or n is null or k <> n").limit(1).collect()
    if bad:
        raise ValueError(f"connectivity does not fit face {bad[0].face}")


def infer_location(last_dim: int, n_nodes: int, n_faces: int, n_boundaries: int) -> str | None:
    """F-13: by the size of the last dimension; edges are never inferred."""
    return {n_boundaries: "boundary", n_faces: "face"}.get(last_dim) if last_dim != n_nodes else "node"


@dataclass(frozen=True)
class Mesh:
    """An unstructured grid (X-03). Taking a part away takes what depends on it: a new object each time."""

    nodes: DataFrame
    faces: DataFrame | None = None
    edges: DataFrame | None = None
    boundaries: DataFrame | None = None
    neighbours: DataFrame | None = None

    def drop(self, part: str) -> Mesh:
        gone = {"nodes": ("faces", "edges", "boundaries", "neighbours"), "faces": ("faces", "neighbours"), "edges": ("edges",), "boundaries": ("boundaries",), "neighbours": ("neighbours",)}[part]
        return replace(self, **dict.fromkeys(gone))

    def same(self, other: Mesh) -> bool:
        """F-23: equal nodes, faces and boundaries."""
        pairs = ((self.nodes, other.nodes), (self.faces, other.faces), (self.boundaries, other.boundaries))
        return all((a is None) == (b is None) and (a is None or same_rows(a, b)) for a, b in pairs)

    def info(self) -> dict[str, int]:
        count = lambda d: d.count() if d is not None else 0
        return {"nodes": count(self.nodes), "faces": count(self.faces), "edges": count(self.edges), "boundaries": count(self.boundaries), "num_vertices": self.faces.agg(F.max(F.size("nodes"))).first()[0] if self.faces is not None else 0}


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def order_rings(segments: DataFrame, rounds: int = 64) -> DataFrame:
    """segments (n0, n1), each node in two at most -> ring, place, node, closed (A-14).

    A ring's name is its smallest node. It starts there, or at the smaller of its ends, and goes on to the smaller neighbour. Components and places both
    come from pointer doubling (logarithmic rounds, one join each), so no ring has to fit one task.
    """
    both = segments.select("n0", "n1").union(segments.select("n1", "n0")).where("n0 <> n1").distinct()
    label = both.select(F.col("n0").alias("node")).distinct().withColumn("ring", F.col("node"))
    for _ in range(rounds):
        near = both.join(label, both.n1 == label.node).groupBy("n0").agg(F.min("ring").alias("_m"))
        nxt = label.join(near, label.node == near.n0).select("node", F.least("ring", "_m").alias("_r"))
        jump = nxt.select(F.col("node").alias("_k"), F.col("_r").alias("_rr"))
        nxt = written(nxt.join(jump, F.col("_r") == F.col("_k")).select("node", F.least("_r", "_rr").alias("ring")))
        same = nxt.join(label.withColumnRenamed("ring", "_old"), "node").where("ring <> _old").isEmpty()
        label = nxt
        if same:
            break
    else:
        raise RuntimeError("rings did not converge")
    near = written(both.groupBy(F.col("n0").alias("node")).agg(F.sort_array(F.collect_list("n1")).alias("near")).join(label, "node"))
    ends = F.when(F.size("near") == 1, F.struct("node", "near"))
    ring = near.groupBy("ring").agg(F.min(ends).alias("end"), F.min(F.struct("node", "near")).alias("low"), F.count("*").alias("size"))
    first = F.coalesce("end", "low")
    ring = written(ring.select("ring", first["node"].alias("start"), first["near"][0].alias("then"), F.col("end").isNull().alias("closed"), "size"))
    # A step is a directed segment a -> b; the step before it comes to a from a's other neighbour. The first step, and one that starts at an end, is its own.
    step = near.join(ring, "ring").select("ring", "start", "then", "closed", F.col("node").alias("a"), "near", F.explode("near").alias("b"))
    other = F.get(F.filter("near", lambda x: x != F.col("b")), F.lit(0))
    is_first = ((F.col("a") == F.col("start")) & (F.col("b") == F.col("then"))) | other.isNull()
    step = written(step.select("ring", "start", "then", "closed", "a", "b", F.when(is_first, F.col("a")).otherwise(other).alias("pa"), F.when(is_first, F.col("b")).otherwise(F.col("a")).alias("pb"), F.when(is_first, 0).otherwise(1).cast("long").alias("dist")))
    for _ in range(int(ring.agg(F.max("size")).first()[0] or 0).bit_length()):
        up = step.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"), F.col("dist").alias("_d"))
        got = step.join(up, (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")))
        step = written(got.select("ring", "start", "then", "closed", "a", "b", F.col("_pa").alias("pa"), F.col("_pb").alias("pb"), (F.col("dist") + F.col("_d")).alias("dist")))
    walked = step.where((F.col("pa") == F.col("start")) & (F.col("pb") == F.col("then")) & (F.col("b") != F.col("start")))
    walked = walked.select("ring", (F.col("dist") + 1).cast("int").alias("place"), F.col("b").alias("node"), "closed")
    return ring.select("ring", F.lit(0).alias("place"), F.col("start").alias("node"), "closed").union(walked)


def check_consistent(mesh: Mesh) -> None:
    """A-18: every node of a face, edge or boundary is there, and no id stands twice; otherwise an error names the first."""
    ids = mesh.nodes.select(F.col("node").cast("long").alias("node"))
    parts = {"node": ids} | {n: d.select(F.col(n).cast("long").alias("node")) for n, d in (("face", mesh.faces), ("edge", mesh.edges)) if d is not None and n in d.columns}
    for name, own in parts.items():
        twice = own.groupBy("node").count().where("count > 1").orderBy("node").limit(1).collect()
        if twice:
            raise ValueError(f"{name} {twice[0].node} stands {twice[0]['count']} times")
    used = [mesh.faces.select(F.explode(F.col("nodes").cast("array<long>")).alias("node"))] if mesh.faces is not None else []
    used += [d.select(F.explode(F.array("n0", "n1").cast("array<long>")).alias("node")) for d in (mesh.edges, mesh.boundaries) if d is not None]
    for own in used:
        lost = own.join(ids, "node", "left_anti").orderBy("node").limit(1).collect()
        if lost:
            raise ValueError(f"node {lost[0].node} is used and not there")


#: Columns of the table of selected cells, in order.
SELECTED = ("pid", "lon", "lat", "face", "n_nodes", "place", "node", "node_lon", "node_lat", "center_lon", "center_lat", "area")


def selected_cells(points: DataFrame, faces: DataFrame, nodes: DataFrame, path: str | None = None) -> DataFrame:
    """SELECTED for the cells that hold points (pid, lon, lat), or lie nearest (P-08): one row per point and corner; with a path also written there as CSV."""
    own = with_polygons(faces, nodes)
    where = join.locate_or_nearest(points.select("pid", "lon", "lat"), own.select(F.col("face").cast("long").alias("cell"), "poly"), centroids(faces, nodes).select(F.col("face").cast("long").alias("node"), "lon", "lat"), name="face")
    n = F.size("poly")
    after = lambda k: F.get("poly", (k + 1) % n)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, k: a + F.get("poly", k)["lon"] * after(k)["lat"] - after(k)["lon"] * F.get("poly", k)["lat"])
    mean = lambda c: F.aggregate("poly", F.lit(0.0), lambda a, p: a + p[c]) / n
    cell = own.select(F.col("face").cast("long").alias("face"), "nodes", "poly", n.alias("n_nodes"), mean("lon").alias("center_lon"), mean("lat").alias("center_lat"), F.abs(twice / 2).alias("area"))
    out = where.join(cell, "face").select("pid", "lon", "lat", "face", "n_nodes", "center_lon", "center_lat", "area", F.posexplode(F.arrays_zip("nodes", "poly")).alias("place", "z"))
    out = out.withColumns({"node": F.col("z.nodes").cast("long"), "node_lon": F.col("z.poly.lon"), "node_lat": F.col("z.poly.lat")}).select(*SELECTED)
    if path is not None:
        out.write.mode("overwrite").option("header", True).csv(path)
    return out


def face_node_rows(faces: DataFrame, nodes: DataFrame, located: DataFrame) -> DataFrame:
    """For the faces of located (face, lon, lat): one row per corner with its coordinates and the face's centroid (P-08)."""
    corners = with_polygons(faces, nodes).select(F.col("face").alias("_f"), "nodes", "poly")
    mid = centroids(faces, nodes).select(F.col("face").alias("_c"), F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"))
    out = located.join(join.small(corners), F.col("face") == F.col("_f")).join(join.small(mid), F.col("face") == F.col("_c"))
    out = out.withColumn("_z", F.explode(F.arrays_zip("nodes", "poly"))).withColumns({"node": F.col("_z.nodes"), "node_lon": F.col("_z.poly.lon"), "node_lat": F.col("_z.poly.lat")})
    return out.drop("_f", "_c", "_z", "nodes", "poly")
