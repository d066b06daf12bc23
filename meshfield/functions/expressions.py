"""Scalar expressions on columns: geometry, vectors, axes. All are built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd crossing test (F-12). poly: array of (lon, lat). Points on lower and left edges are inside, on upper and right edges outside."""
    n = F.size(poly)

    def crossed(i: Column) -> Column:
        p, q = F.get(poly, i), F.get(poly, (i + 1) % n)
        at = F.try_divide((q["lon"] - p["lon"]) * (y - p["lat"]), q["lat"] - p["lat"]) + p["lon"]
        return ((p["lat"] > y) != (q["lat"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda inside, i: inside != crossed(i))


def in_corners(x: Column, y: Column, corners: Sequence[tuple[Column, Column]]) -> Column:
    """in_polygon for a fixed number of corners, written out; repeated last corners do no harm."""
    out = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        at = F.try_divide((bx - ax) * (y - ay), by - ay) + ax
        out = out != (((ay > y) != (by > y)) & F.coalesce(x < at, F.lit(False)))
    return out


def triangle_area(ax: Num, ay: Num, bx: Num, by: Num, cx: Num, cy: Num) -> Column:
    """Signed area (M-06), positive counter-clockwise."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    return ((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2.0


def in_triangle(x: Column, y: Column, p: Sequence[tuple[Column, Column]]) -> Column:
    """Test by signed areas, in any orientation: edges and corners are inside; nothing is in a degenerate triangle."""
    (ax, ay), (bx, by), (cx, cy) = p
    u, v, w = triangle_area(x, y, bx, by, cx, cy), triangle_area(ax, ay, x, y, cx, cy), triangle_area(ax, ay, bx, by, cx, cy)
    return ((w > 0) & (u >= 0) & (v >= 0) & (w - u - v >= 0)) | ((w < 0) & (u <= 0) & (v <= 0) & (w - u - v <= 0))


def barycentric(x: Column, y: Column, p: Sequence[tuple[Column, Column]]) -> list[Column]:
    """Three weights that sum to 1 (I-13); null for degenerate triangles."""
    (ax, ay), (bx, by), (cx, cy) = p
    whole = triangle_area(ax, ay, bx, by, cx, cy)
    a = F.try_divide(triangle_area(x, y, bx, by, cx, cy), whole)
    b = F.try_divide(triangle_area(ax, ay, x, y, cx, cy), whole)
    return [a, b, 1.0 - a - b]


def digitize(x: Column, axis: Sequence[float], right: bool = False) -> Column:
    """Number of axis values <= x (right: < x) for an ascending axis: comparisons in generated code for short axes, else a binary search."""
    n = len(axis)
    test = (lambda a: a < x) if right else (lambda a: a <= x)
    if n <= 32:
        out = F.lit(0)
        for a in axis:
            out = out + F.when(test(F.lit(float(a))), 1).otherwise(0)
        return out
    values = F.array(*[F.lit(float(a)) for a in axis])
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda pos, s: F.when(F.coalesce(test(F.get(values, pos + s - 1)), F.lit(False)), pos + s).otherwise(pos))


def vector_sum(x: Num | str, y: Num | str) -> Column:
    """Length of a vector (M-01)."""
    return F.sqrt(col(x) * col(x) + col(y) * col(y))


def rotate(x: Num | str, y: Num | str, angle: Num | str) -> tuple[Column, Column]:
    """Vector turned by angle radians, counter-clockwise (M-02)."""
    x, y, a = col(x), col(y), col(angle)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def bearing(lon1: Num | str, lat1: Num | str, lon2: Num | str, lat2: Num | str) -> Column:
    """Initial great-circle bearing in degrees, 0 to 360 (M-03)."""
    lon1, lat1, lon2, lat2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    d = lon2 - lon1
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)))
    return F.pmod(deg + 360.0, F.lit(360.0))


def angle_from_east(bearing_degrees: Column) -> Column:
    """Radians counter-clockwise from true east (M-04)."""
    return F.radians(90.0 - bearing_degrees)


def wrap_longitude(lon: Num | str, positive: bool = False) -> Column:
    """Longitude in -180..180, or 0..360 (M-07)."""
    lon = col(lon)
    return F.when(lon < 0, lon + 360.0).otherwise(lon) if positive else F.when(lon > 180, lon - 360.0).otherwise(lon)


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """M-10."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    return a + (b - a) * alpha


def pair(x: Column, y: Column) -> Column:
    """Elementwise pairs of two array columns (M-05)."""
    return F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: F.array(z["x"], z["y"]))


def with_mask_policy(values: Sequence[Column], weights: Sequence[Column], policy: str) -> Column:
    """Weighted sum of values where null means masked (I-20).

    zero: masked values count 0. mask: any masked value masks the sum. skip: masked values are left out, all masked gives null.
    mirror: of exactly two values, a masked one becomes minus the other (I-21).
    """
    if policy == "mirror":
        if len(values) != 2:
            raise ValueError("mirror needs exactly two values")
        a, b = values
        values, policy = [F.coalesce(a, -b), F.coalesce(b, -a)], "mask"
    if policy == "mask":
        terms = [v * w for v, w in zip(values, weights, strict=True)]
    elif policy in ("zero", "skip"):
        terms = [F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, weights, strict=True)]
    else:
        raise ValueError(f"unknown policy {policy}")
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.when(F.coalesce(*values).isNotNull(), out) if policy == "skip" else out
