"""Vertical coordinates: levels, sigma (per-point profiles), boundary conditions. Depth is positive down."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import digitize, let

CONDITIONS = ("mask", "extrapolate")
OUT = "struct<k:int,alpha:double>"


def _checked(*conditions: str) -> None:
    for c in conditions:
        if c not in CONDITIONS:
            raise ValueError(f"boundary condition {c}: mask or extrapolate")


def surface_only(surface_index: int = 0) -> tuple[Column, Column]:
    """(k, alpha) of a single level, whatever the depth asked for (I-06)."""
    return F.lit(surface_index), F.lit(0.0)


@dataclass(frozen=True)
class Levels:
    """Fixed depths, ascending or descending (I-07, J-08)."""

    depths: tuple[float, ...]
    surface: str = "extrapolate"
    bottom: str = "mask"

    def __post_init__(self):
        _checked(self.surface, self.bottom)

    @classmethod
    def loaded(cls, depths: Sequence[float], **kw) -> Levels:
        """S-24: from a file the shallowest level becomes 0."""
        low = min(depths)
        return cls(tuple(0.0 if d == low else float(d) for d in depths), **kw)

    @property
    def ascending(self) -> bool:
        return self.depths[0] <= self.depths[-1]

    @property
    def surface_index(self) -> int:
        return self.depths.index(min(self.depths))

    @property
    def bottom_index(self) -> int:
        return self.depths.index(max(self.depths))

    def index(self, z: Column) -> Column:
        """Level before z: ascending, the last level <= z (-1 above the surface); descending, the last level >= z... counted from the bottom."""
        n = len(self.depths)
        if self.ascending:
            return digitize(z, self.depths) - 1
        return F.lit(n - 1) - digitize(z, self.depths[::-1], right=True)

    def weights(self, z: Column) -> tuple[Column, Column]:
        """(k, alpha) between levels k and k + 1; null where a boundary condition masks."""
        n, idx = len(self.depths), self.index(z)
        if n == 1:
            return surface_only()
        levels = F.array(*[F.lit(float(d)) for d in self.depths])
        a, b = F.get(levels, idx), F.get(levels, idx + 1)
        inside = (z - a) / (b - a)
        if self.ascending:
            above, below, top, low = idx < 0, idx >= n - 1, (-1, 1.0), (n - 1, 0.0)
        else:
            above, below, top, low = idx >= n - 1, idx < 0, (n - 1, 0.0), (-1, 1.0)
        k, alpha = idx, inside
        ok_top, ok_low = self.surface == "extrapolate", self.bottom == "extrapolate"
        k = F.when(above, F.lit(top[0] if ok_top else None).cast("int")).when(below, F.lit(low[0] if ok_low else None).cast("int")).otherwise(k)
        alpha = F.when(above, F.lit(top[1] if ok_top else None).cast("double")).when(below, F.lit(low[1] if ok_low else None).cast("double")).otherwise(alpha)
        return F.when(z.isNotNull(), k), F.when(z.isNotNull(), alpha)


def bounded(idx: Column, alpha: Column, surface_index: int, bottom_index: int, surface: str, bottom: str) -> tuple[Column, Column]:
    """(k, alpha) after the boundary conditions (I-09). A null idx (no water column) stays null."""
    _checked(surface, bottom)
    if surface_index == 0:
        above, below, top, low = idx < surface_index, idx >= bottom_index, 1.0, 0.0
    else:
        above, below, top, low = idx >= surface_index, idx < bottom_index, 0.0, 1.0
    gone = (above if surface == "mask" else F.lit(False)) | (below if bottom == "mask" else F.lit(False))
    a = F.when(above, F.lit(top)).when(below, F.lit(low)).otherwise(alpha)
    return F.when(idx.isNotNull() & ~gone, idx), F.when(idx.isNotNull() & ~gone, a)


def in_profile(z: Column, profile: Column, surface: str = "extrapolate", bottom: str = "mask", surface_first: bool = False) -> tuple[Column, Column]:
    """(k, alpha) in a profile of one's own (I-08, J-09), bottom first or surface first; a profile with a null has no water column.

    A point on the sea floor lies below it, one on the surface is inside, in either order.
    """
    n = F.size(profile)
    before = F.filter(profile, (lambda d: d <= z) if surface_first else (lambda d: d > z))
    idx = F.when(profile.isNull() | F.exists(profile, lambda d: d.isNull()) | z.isNull(), F.lit(None).cast("int")).otherwise(F.size(before) - 1)

    def weights(p: Column) -> Column:
        a, b = F.get(profile, p), F.get(profile, p + 1)
        first, last = p < 0, p >= n - 1
        above, below = (first, last) if surface_first else (last, first)
        gone = (above if surface == "mask" else F.lit(False)) | (below if bottom == "mask" else F.lit(False))
        alpha = F.when(last, 0.0).when(first, 1.0).otherwise(F.try_divide(z - a, b - a))
        return F.when(p.isNotNull() & ~gone, F.struct(p.alias("k"), alpha.alias("alpha")))

    both = let(idx, weights)
    return both["k"], both["alpha"]


def roms(s: Sequence[float], cs: Sequence[float], hc: float, h: Column, zeta: Column, vtransform: int = 2) -> Column:
    """Depths below the undisturbed surface of each s level (I-11), as an array from the bottom up."""
    if vtransform not in (1, 2):
        raise ValueError("vtransform: 1 or 2")
    out = []
    for sk, ck in zip(s, cs, strict=True):
        if vtransform == 1:
            big = F.lit(hc * sk) + h * ck - F.lit(hc * ck)
            out.append(-(big + zeta * (F.lit(1.0) + F.try_divide(big, h))))
        else:
            big = F.try_divide(F.lit(hc * sk) + h * ck, F.lit(hc) + h)
            out.append(-(zeta + (zeta + h) * big))
    return F.array(*out)


def sigma(levels: Column, h: Column, zeta: Column) -> Column:
    """Depths of sigma levels (array, interpolated to the point before; I-12)."""
    return F.transform(levels, lambda s: -(zeta + (zeta + h) * s))


def profile_below_surface(depths: Column, zeta: Column) -> Column:
    """I-10: positive down from the instantaneous surface."""
    return F.transform(depths, lambda d: d + zeta)
