"""What a file's metadata say: grid kinds, topology, coordinates, locations, masks. Runs on the driver over headers alone.

Variables are given as name -> Meta; every function is pure.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that files use, and their order of precedence.
S_NAMES = ("sgrid", "pygrid_s", "staggered", "curvilinear", "roms")
U_NAMES = ("ugrid", "pygrid_u", "triangular", "unstructured")
R_NAMES = ("rgrid", "regular", "rectangular", "rectilinear")
NODE_PAIRS = (("node_lon", "node_lat"), ("lon", "lat"), ("lon_psi", "lat_psi"), ("longitude", "latitude"))
COMPOSITE_NODES = ("nodes", "node")
FACE_NAMES = ("faces", "tris", "nv", "ele", "nele")
CENTER_PAIRS = (("center_lon", "center_lat"), ("lon_rho", "lat_rho"), ("lonc", "latc"))
EDGE1_PAIRS = (("edge1_lon", "edge1_lat"), ("lon_u", "lat_u"))
EDGE2_PAIRS = (("edge2_lon", "edge2_lat"), ("lon_v", "lat_v"))
MASKS = {"node": ("mask_psi", "node_mask"), "center": ("mask_rho", "center_mask"), "edge1": ("mask_u", "edge1_mask"), "edge2": ("mask_v", "edge2_mask")}
DEPTH_LEVELS = ("depth", "depth_levels", "Depth")
ROMS_TERMS = ("Cs_r", "s_rho", "Cs_w", "s_w", "hc", "h")
FVCOM_TERMS = ("siglay", "siglev", "h")
ZETA = ("zeta",)
ZETA_LONG = ("free-surface", "sea_surface_height_above_geoid")
BATHYMETRY_LONG = ("bathymetry at rho-points", "final bathymetry at rho-points", "sea_floor_depth_below_geoid")


@dataclass
class Meta:
    dims: Sequence[str] = ()
    shape: Sequence[int] = ()
    attrs: Mapping = field(default_factory=dict)


Vars = Mapping[str, Meta]


def grid_type(variables: Vars, attrs: Mapping | None = None, grid_type: str | None = None, grid_topology: Mapping | None = None) -> str:
    """'S', 'U' or 'R' (S-09)."""
    if grid_type:
        name = grid_type.lower()
        for names, kind in ((S_NAMES, "S"), (U_NAMES, "U"), (R_NAMES, "R")):
            if name in names:
                return kind
        raise ValueError(f"grid type {grid_type} is not known")
    if grid_topology:
        given = str(grid_topology.get("grid_type", "")).lower()
        return "U" if "faces" in grid_topology or given in U_NAMES else "R" if given in R_NAMES else "S"
    given = str((attrs or {}).get("grid_type", "")).lower()
    if given in U_NAMES or given in S_NAMES:
        return "U" if given in U_NAMES else "S"
    top = topology_variable(variables)
    if top:
        a = variables[top].attrs
        return "U" if "node_coordinates" in a and "node_dimensions" not in a else "S"
    pair = node_pair(variables)
    if pair and any(n in variables for n in FACE_NAMES):
        return "U"
    if pair and all(len(variables[n].dims) == 1 for n in pair):
        return "R"
    if pair:
        return "S"
    raise ValueError("grid type cannot be told")


def topology_variable(variables: Vars) -> str | None:
    """S-10"""
    return next((n for n, v in variables.items() if "topology" in str(v.attrs.get("cf_role", ""))), None)


def node_pair(variables: Vars, topology: Mapping | None = None) -> tuple[str, str] | None:
    """S-11: names of the node coordinates; a composite variable counts for both."""
    if topology and "node_lon" in topology and "node_lat" in topology:
        return topology["node_lon"], topology["node_lat"]
    for pair in NODE_PAIRS:
        if all(n in variables for n in pair):
            return pair
    name = (topology or {}).get("nodes") or next((n for n in COMPOSITE_NODES if n in variables), None)
    return (name, name) if name in variables else None


def required_nodes(variables: Vars, topology: Mapping | None = None) -> tuple[str, str]:
    if not (pair := node_pair(variables, topology)):
        raise ValueError("no node coordinates found")
    return pair


def faces_layout(shape: Sequence[int], lowest: int, highest: int, n_nodes: int) -> tuple[bool, int]:
    """(transposed, first index) of a face table (S-12, S-15, S-20)."""
    return len(shape) == 2 and shape[0] in (3, 4) and shape[1] > 4, int(highest == n_nodes and lowest >= 1)


def staggered_names(variables: Vars) -> dict[str, str]:
    """S-13: names of center and edge coordinates and masks that are there."""
    out: dict[str, str] = {}
    for place, pairs in (("center", CENTER_PAIRS), ("edge1", EDGE1_PAIRS), ("edge2", EDGE2_PAIRS)):
        pair = next((p for p in pairs if all(n in variables for n in p)), None)
        if pair:
            out |= {f"{place}_lon": pair[0], f"{place}_lat": pair[1]}
    for place, names in MASKS.items():
        if name := next((n for n in names if n in variables), None):
            out[f"{place}_mask"] = name
    return out


def require_1d(variables: Vars, pair: tuple[str, str]) -> None:
    """S-14"""
    if any(len(variables[n].dims) != 1 for n in pair):
        raise ValueError("a rectilinear grid needs 1-D coordinates")


def mesh_names(variables: Vars) -> list[str]:
    """S-17"""
    return [n for n, v in variables.items() if v.attrs.get("cf_role") == "mesh_topology" and int(v.attrs.get("topology_dimension", 0)) in (1, 2)]


def the_mesh(variables: Vars, name: str | None = None) -> str:
    names = mesh_names(variables)
    if name is not None:
        if name not in names:
            raise ValueError(f"{name} is no mesh")
        return name
    if len(names) != 1:
        raise ValueError(f"{len(names)} meshes found")
    return names[0]


def staggered_topology(variables: Vars) -> str:
    """S-19"""
    names = [n for n, v in variables.items() if v.attrs.get("cf_role") == "grid_topology"]
    if len(names) != 1 or int(variables[names[0]].attrs.get("topology_dimension", 0)) != 2:
        raise ValueError("one grid topology of two dimensions expected")
    return names[0]


def parse_padding(text: str, variable: str = "") -> list[tuple[str, str, str]]:
    """F-17: (face dimension, node dimension, padding) of 'face: node (padding: kind) ...'."""
    found = re.findall(r"(\w+)\s*:\s*(\w+)\s*\(\s*padding\s*:\s*(\w+)\s*\)", text)
    if not found:
        raise ValueError(f"no padding in {variable or text}")
    return found


def parse_axes(text: str) -> tuple[str | None, ...]:
    """F-17: dimensions named for X, Y and Z in 'X: dim Y: dim Z: dim'."""
    got = dict(re.findall(r"([XYZ])\s*:\s*(\w+)", text))
    return got.get("X"), got.get("Y"), got.get("Z")


def parse_vector_axis(standard_name: str) -> str | None:
    """F-17: X, Y or Z by what a standard name says of its component."""
    m = re.search(r"(?:^|_)([xyz])_|(eastward|grid_eastward)|(northward|grid_northward)|(upward)", standard_name)
    return None if not m else m[1].upper() if m[1] else "X" if m[2] else "Y" if m[3] else "Z"


def by_attributes(variables: Vars, **wanted) -> list[str]:
    """S-36: variables with all these attributes."""
    return [n for n, v in variables.items() if all(k in v.attrs and v.attrs[k] == x for k, x in wanted.items())]


def coordinates_of(variables: Vars, dims: Sequence[str]) -> tuple[str, ...]:
    """S-36: longitude, then latitude variable on exactly these dimensions."""
    out = []
    for kind in ("longitude", "latitude"):
        hit = next((n for n, v in variables.items() if tuple(v.dims) == tuple(dims) and (v.attrs.get("standard_name") == kind or str(v.attrs.get("units", "")).startswith(f"degree{'s' if 's_' in str(v.attrs.get('units', '')) else ''}_{'east' if kind == 'longitude' else 'north'}"))), None)
        if hit is None:
            raise ValueError(f"no {kind} on {tuple(dims)}")
        out.append(hit)
    return tuple(out)


def time_variable(variables: Vars, name: str) -> str | None:
    """S-22"""
    v = variables[name]
    given = v.attrs.get("time")
    return given if given in v.dims else v.dims[0] if v.dims and "time" in v.dims[0] else None


def depth_kind(variables: Vars, ndim: int | None = None) -> str:
    """S-23, S-26: 'roms', 'fvcom', 'levels' or, with a warning, 'surface'. More than one is an error."""
    found = [k for k, ok in (("roms", all(n in variables for n in ROMS_TERMS)), ("fvcom", all(n in variables for n in FVCOM_TERMS)), ("levels", any(n in variables for n in DEPTH_LEVELS))) if ok]
    if len(found) > 1:
        raise ValueError(f"depths of several kinds: {', '.join(found)}")
    if not found:
        warnings.warn("no depth found: the surface alone", RuntimeWarning, stacklevel=2)
        return "surface"
    return found[0]


def search(variables: Vars, names: Mapping[str, Sequence[str]], long_names: Mapping[str, Sequence[str]] | None = None) -> dict[str, str | None]:
    """S-32: role -> variable, by long or standard name first, else by name."""
    out: dict[str, str | None] = {}
    for role, wanted in names.items():
        said = [x.lower() for x in (long_names or {}).get(role, ())]
        hit = next((n for n, v in variables.items() if str(v.attrs.get("long_name", "")).lower() in said or str(v.attrs.get("standard_name", "")).lower() in said), None)
        out[role] = hit or next((n for n in wanted if n in variables), None)
    return out


def merged(data: Mapping, grid: Mapping) -> dict:
    """S-32: what the data file names, else the grid file."""
    return {k: data.get(k) if data.get(k) is not None else grid.get(k) for k in {**grid, **data}}


def default_name(variables: Vars, names: Sequence[str], cf_names: Sequence[str] = ()) -> str:
    """S-33"""
    got = search(variables, {"x": names}, {"x": cf_names})["x"]
    if got is None:
        raise ValueError(f"no variable of {', '.join([*names, *cf_names])}")
    return got


def variable_location(meta: Meta, locations: Mapping[str, Sequence[str]], padding: Mapping[str, str] | None = None) -> str | None:
    """F-16: the location whose dimensions a variable holds."""
    given = meta.attrs.get("location")
    if given:
        return given
    return next((k for k, dims in locations.items() if dims and set(dims) <= set(meta.dims)), None)


def variable_slices(meta: Meta, padding: Mapping[str, str], low: Mapping[str, tuple[int, int]]) -> tuple[tuple[int, int | None], ...]:
    """F-16: first and last index (from the end; None: none left out) per dimension."""
    out = []
    for d in meta.dims:
        lo, hi = low.get(padding.get(d, "none"), (0, 0))
        out.append((lo, -hi if hi else None))
    return tuple(out)


def referenced(variables: Vars) -> set[str]:
    """Variables that topologies name (S-05, F-18)."""
    top = [n for n, v in variables.items() if "topology" in str(v.attrs.get("cf_role", ""))]
    words = {w for n in top for a in variables[n].attrs.values() if isinstance(a, str) for w in re.findall(r"\w+", a)}
    return {n for n in variables if n in words} | set(top)


def discovered(variables: Vars, infer) -> dict[str, tuple[str, str]]:
    """S-05: variable -> (name, location) of what is no part of the grid and has a location; infer(meta) fills in missing ones."""
    out = {}
    for n, v in variables.items():
        if n in referenced(variables):
            continue
        place = v.attrs.get("location") or infer(v)
        if place:
            out[n] = (v.attrs.get("long_name", n), place)
    return out


def vars_by_attribute(nc_variable: DataFrame, attr: str, value: str) -> DataFrame:
    """F-02"""
    return nc_variable.where(F.col("attrs")[attr] == value)


def mask_from_flags(code: Column, flag_values: Sequence, flag_meanings: str) -> Column:
    """F-04: true where masked. Meanings with water or lake are not; codes that are not listed are."""
    table = []
    for v, m in zip(flag_values, flag_meanings.split(), strict=False):
        table += [F.lit(str(v)), F.lit(not re.search("water|lake", m, re.I))]
    return F.coalesce(F.create_map(*table)[code.cast("string")], F.lit(True))


def mask_from_options(code: Column) -> Column:
    """F-04, flags option_0 and so on: 0 is land."""
    return F.when(code == 0, True).when(code == 1, False).otherwise(True)


def mask_plain(code: Column) -> Column:
    return code.cast("boolean")
