"""Verdat text files: soundings in boundary order, then the last sounding of each boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit names as files spell them, and as variables do.
UNITS = {"FEET": "ft", "METERS": "m"}
HEADER = "DOGS"


def parse(text: str) -> tuple[str | None, list[tuple[int, float, float, float]], list[tuple[int, int]]]:
    """(units, rows (node, lon, lat, depth) from 0, boundary segments) (S-28). Without units in the header: None."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    head = lines[0].split()
    if not head or head[0] != HEADER:
        raise ValueError("not a verdat file")
    rows: list[tuple[int, float, float, float]] = []
    at = 1
    for at in range(1, len(lines)):  # noqa: B007
        n, *rest = (float(v) for v in lines[at].split(","))
        if n == 0 and not any(rest):
            break
        rows.append((len(rows), *rest[:3]))
    n = int(lines[at + 1])
    ends = [int(v) - 1 for v in lines[at + 2 : at + 2 + n]]
    segments, start = [], 0
    for end in ends:
        segments += [(k, k + 1) for k in range(start, end)] + [(end, start)]
        start = end + 1
    return (UNITS.get(head[1].upper(), head[1]) if len(head) > 1 else None), rows, segments


def load(spark: SparkSession, path: str) -> tuple[str | None, DataFrame, DataFrame]:
    """(units, node (node, lon, lat, depth), boundary (n0, n1)). The file is one hand-made text, read by Spark so that any store serves."""
    text = spark.read.text(path, wholetext=True).first()[0]
    units, rows, segments = parse(text)
    return units, spark.createDataFrame(rows, "node int, lon double, lat double, depth double"), spark.createDataFrame(segments, "n0 int, n1 int")


def render(nodes: Sequence[tuple[float, float, float]], rings: Sequence[Sequence[int]], units: str | None = "m") -> str:
    """Text of a verdat file (K-06): closed rings in order, then the other nodes."""
    name = next((k for k, v in UNITS.items() if units in (k, v)), None)
    used = [n for r in rings for n in r]
    rest = [n for n in range(len(nodes)) if n not in set(used)]
    out = [HEADER + (f" {name}" if name else "")]
    out += [f"{k:3d}, {nodes[n][0]:.6f}, {nodes[n][1]:.6f}, {nodes[n][2]:.3f}" for k, n in enumerate([*used, *rest], 1)]
    out += ["0, 0.0, 0.0, 0.0", str(len(rings))]
    at = 0
    for r in rings:
        at += len(r)
        out.append(str(at))
    return "\n".join(out) + "\n"


def save(nodes: DataFrame, rings: DataFrame, path: str, units: str | None = "m") -> None:
    """nodes (node, lon, lat, depth) and rings of ugrid.order_rings() as one text file in the folder path; open rings are left out."""
    spark = nodes.sparkSession
    own = [(r.lon, r.lat, r.depth) for r in nodes.orderBy("node").collect()]
    closed = rings.where("closed").groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("r")).orderBy("ring").collect()
    text = render(own, [[x.node for x in r.r] for r in closed], units)
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
