"""Rectilinear grids: two ascending axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import digitize
from .join import small


def locate(points: DataFrame, xs: Sequence[float], ys: Sequence[float], x: str = "lon", y: str = "lat") -> DataFrame:
    """points plus i and j of the half-open cell [x_i, x_i+1) x [y_j, y_j+1) (J-03); both -1 outside, at the last nodes, and for nulls."""
    i, j = digitize(F.col(x), xs) - 1, digitize(F.col(y), ys) - 1
    out = points.withColumns({"_i": i, "_j": j})
    ok = F.col("_i").between(0, len(xs) - 2) & F.col("_j").between(0, len(ys) - 2)
    return out.withColumns({"i": F.when(ok, F.col("_i")).otherwise(-1), "j": F.when(ok, F.col("_j")).otherwise(-1)}).drop("_i", "_j")


def _at(values: Sequence[float], k: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), k)


def corner_cells(field: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """(j, i, value) of nodes -> (j, i, v00, v01, v10, v11) of cells; v01 is the next i. One pass, one shuffle of the field."""
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = field.select(*by, "j", "i", F.col(value).alias("_v"), corners.alias("_c"))
    key = [F.col(c) for c in by] + [(F.col("j") - F.col("_c.a")).alias("j"), (F.col("i") - F.col("_c.b")).alias("i")]
    aggs = [F.max(F.when((F.col("_c.a") == a) & (F.col("_c.b") == b), F.col("_v"))).alias(f"v{a}{b}") for a in (0, 1) for b in (0, 1)]
    return spread.groupBy(*key).agg(*aggs)


def interpolate(points: DataFrame, field: DataFrame, xs: Sequence[float], ys: Sequence[float], method: str = "linear", x: str = "lon", y: str = "lat", name: str = "value") -> DataFrame:
    """points plus the field there (I-22): bilinear or nearest, the upper ends included, 0 outside; a null node counts 0.

    field: j, i, value on nodes.
    """
    inside = F.col(x).between(float(xs[0]), float(xs[-1])) & F.col(y).between(float(ys[0]), float(ys[-1]))
    low = lambda c, axis: F.greatest(F.least(digitize(F.col(c), axis) - 1, F.lit(len(axis) - 2)), F.lit(0))
    out = points.withColumns({"_in": F.coalesce(inside, F.lit(False)), "_i": low(x, xs), "_j": low(y, ys)})
    a = (F.col(x) - _at(xs, F.col("_i"))) / (_at(xs, F.col("_i") + 1) - _at(xs, F.col("_i")))
    b = (F.col(y) - _at(ys, F.col("_j"))) / (_at(ys, F.col("_j") + 1) - _at(ys, F.col("_j")))
    out = out.withColumns({"_a": a, "_b": b})
    if method == "nearest":
        out = out.withColumns({"_i": F.col("_i") + F.when(F.col("_a") > 0.5, 1).otherwise(0), "_j": F.col("_j") + F.when(F.col("_b") > 0.5, 1).otherwise(0)})
        table = field.select(F.col("j").alias("_fj"), F.col("i").alias("_fi"), F.coalesce("value", F.lit(0.0)).alias("_v"))
        value = F.col("_v")
    elif method == "linear":
        table = corner_cells(field).select(F.col("j").alias("_fj"), F.col("i").alias("_fi"), *[F.coalesce(c, F.lit(0.0)).alias(f"_{c}") for c in ("v00", "v01", "v10", "v11")])
        v00, v01, v10, v11, p, q = (F.col(c) for c in ("_v00", "_v01", "_v10", "_v11", "_a", "_b"))
        value = v00 * (1 - p) * (1 - q) + v01 * p * (1 - q) + v10 * (1 - p) * q + v11 * p * q
    else:
        raise ValueError(f"method {method}: linear or nearest")
    joined = out.join(small(table, field), F.col("_in") & (F.col("_j") == F.col("_fj")) & (F.col("_i") == F.col("_fi")), "left")
    gone = [c for c in joined.columns if c.startswith("_")]
    return joined.withColumn(name, F.when(F.col("_in"), F.coalesce(value, F.lit(0.0))).otherwise(0.0)).drop(*gone)


def axis_table(spark: SparkSession, values: Sequence[float]) -> DataFrame:
    """(idx, lo, hi, center) of an axis's intervals (A-16)."""
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(values, values[1:], strict=False))]
    return spark.createDataFrame(rows, "idx int, lo double, hi double").withColumn("center", (F.col("lo") + F.col("hi")) / 2)


def centers(spark: SparkSession, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """Centers of all cells: j, i, lon, lat. The shorter axis is a literal array, so no join is planned."""
    lat = F.posexplode(F.array(*[F.lit((a + b) / 2) for a, b in zip(ys, ys[1:], strict=False)]))
    return axis_table(spark, xs).select(F.col("idx").alias("i"), F.col("center").alias("lon"), lat.alias("j", "lat")).select("j", "i", "lon", "lat")


def node_points(spark: SparkSession, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """Nodes: j, i, lon, lat."""
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(xs)], "i int, lon double")
    return rows.select("i", "lon", F.posexplode(F.array(*[F.lit(float(v)) for v in ys])).alias("j", "lat")).select("j", "i", "lon", "lat")


def orientation(dims: Sequence[str] | None, shape: Sequence[int], lon_dim: str | None, lat_dim: str | None, n_lon: int, n_lat: int) -> str:
    """Whether the last two dimensions are 'yx' or 'xy' (I-23): by names, else by shape; a square without names cannot be told."""
    if dims and lon_dim in dims and lat_dim in dims:
        return "yx" if dims.index(lat_dim) < dims.index(lon_dim) else "xy"
    if n_lon == n_lat:
        raise ValueError("square data without dimension names: orientation cannot be told")
    if tuple(shape[-2:]) == (n_lat, n_lon):
        return "yx"
    if tuple(shape[-2:]) == (n_lon, n_lat):
        return "xy"
    raise ValueError(f"shape {tuple(shape)} fits neither orientation")
