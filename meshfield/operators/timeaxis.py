"""Time axes: bracketing of query times, interpolation weights, validity."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timefn

_ZERO = datetime(1970, 1, 1)


class TimeSeriesError(ValueError):
    """Times are not ascending or not unique."""


class OutOfTimeRange(ValueError):
    pass


def _us(t: datetime) -> int:
    return int((t - _ZERO) / timedelta(microseconds=1))


@dataclass(frozen=True)
class TimeAxis:
    """Ascending unique times (T-07) and an offset in hours that is only a label (None: unknown)."""

    times: tuple[datetime, ...]
    tz_offset: float | None = None
    displaced: bool = False

    def __post_init__(self):
        if not self.times:
            object.__setattr__(self, "times", (datetime.now().replace(second=0, microsecond=0),))
        if any(not isinstance(t, datetime) for t in self.times):
            raise TypeError("times must be datetimes")
        if any(a >= b for a, b in zip(self.times, self.times[1:], strict=False)):
            raise TimeSeriesError("times must be ascending and unique")

    @classmethod
    def of(cls, df: DataFrame, column: str = "t", tz_offset: float | None = None) -> TimeAxis:
        """From a table of axis values: one value per time step, so it fits the driver."""
        return cls(tuple(r[0] for r in df.select(F.col(column).cast("timestamp_ntz")).orderBy(1).collect()), tz_offset)

    @classmethod
    def constant(cls) -> TimeAxis:
        """S-31: one entry, now."""
        return cls((datetime.now(),))

    def __len__(self) -> int:
        return len(self.times)

    @property
    def min_time(self) -> datetime:
        return self.times[0]

    @property
    def max_time(self) -> datetime:
        return self.times[-1]

    def with_origin(self, origin: datetime) -> TimeAxis:
        """T-04: moved so that it starts at origin."""
        return replace(self, times=tuple(t - self.times[0] + origin for t in self.times))

    def with_offset(self, hours: float | None) -> TimeAxis:
        """T-05"""
        move = timedelta(0) if hours is None or self.tz_offset is None else timedelta(hours=hours - self.tz_offset)
        return replace(self, times=tuple(t + move for t in self.times), tz_offset=hours)

    def displace(self, by: timedelta | float) -> TimeAxis:
        """T-06: once only."""
        if self.displaced:
            raise AttributeError("a time axis is displaced once only")
        by = by if isinstance(by, timedelta) else timedelta(hours=by)
        return replace(self, times=tuple(t + by for t in self.times), displaced=True)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, t, n) for k, (t, n) in enumerate(zip(self.times, [*self.times[1:], None], strict=True))]
        return spark.createDataFrame(rows, "t_idx int, t timestamp_ntz, t_next timestamp_ntz")

    def _micros(self) -> list[int]:
        return [_us(t) for t in self.times]

    def index(self, t: Column) -> Column:
        """First index whose time is >= t (J-07); the axis's length past the end; 0 on an axis of one entry."""
        return F.lit(0) if len(self) == 1 else digitize_long(timefn.micros(t), self._micros())

    def in_bounds(self, t: Column) -> Column:
        """F-10: both ends included."""
        return timefn.micros(t).between(_us(self.min_time), _us(self.max_time))

    def alpha(self, t: Column, index: Column) -> Column:
        """Share of the way from the time before to that at index (I-04): 0 at index 0, 1 past the end."""
        if len(self) == 1:
            return F.lit(0.0)
        us = F.array(*map(F.lit, self._micros()))
        lo, hi = F.get(us, index - 1), F.get(us, index)
        return F.when(index <= 0, 0.0).when(index >= len(self), 1.0).otherwise((timefn.micros(t) - lo) / (hi - lo))

    def bracket(self, points: DataFrame, t: str = "t", extrapolate: bool = False, strict: bool = True) -> DataFrame:
        """points plus t_lo, t_hi (indices) and t_alpha (I-03). Ends stand for themselves; beyond them extrapolate clamps, else strict raises and lax gives null."""
        n = len(self)
        if n == 1:
            return points.withColumns({"t_lo": F.lit(0), "t_hi": F.lit(0), "t_alpha": F.lit(0.0)})
        us = timefn.micros(F.col(t))
        first, last = _us(self.min_time), _us(self.max_time)
        out = points.withColumn("_k", self.index(F.col(t)))
        if extrapolate:
            low, high, bad = us <= first, us >= last, F.lit(False)
        else:
            low, high, bad = us == first, us == last, (us < first) | (us > last)
        inside = ~low & ~high & ~bad
        refuse = F.raise_error(F.concat(F.lit("time out of range: "), F.col(t).cast("string"))).cast("int") if strict else F.lit(None).cast("int")
        pick = lambda lo, hi, mid: F.when(bad, refuse).when(low, lo).when(high, hi).when(inside, mid)
        out = out.withColumns({"t_lo": pick(F.lit(0), F.lit(n - 1), F.col("_k") - 1), "t_hi": pick(F.lit(0), F.lit(n - 1), F.col("_k"))})
        return out.withColumn("t_alpha", F.when(F.col("t_lo") == F.col("t_hi"), 0.0).when(F.col("t_lo").isNotNull(), self.alpha(F.col(t), F.col("_k")))).drop("_k")


def digitize_long(x: Column, axis: list[int]) -> Column:
    """Number of axis values < x."""
    if len(axis) <= 32:
        out = F.lit(0)
        for a in axis:
            out = out + F.when(F.lit(a) < x, 1).otherwise(0)
        return out
    values = F.array(*map(F.lit, axis))
    steps = [1 << k for k in reversed(range(len(axis).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda pos, s: F.when(F.coalesce(F.get(values, pos + s - 1) < x, F.lit(False)), pos + s).otherwise(pos))


#: Buckets of a series at most, and entries that one aims at.
BUCKETS, IN_BUCKET = 1_000_000, 32


def bracket_join(points: DataFrame, series: DataFrame, t: str = "t", value: str = "value") -> DataFrame:
    """points plus lo_us, lo, hi_us, hi: the series' entries before t and at or after it (J-07), for series too long for an expression.

    Buckets of time are as long as IN_BUCKET entries are on average (one aggregate over the series tells), so a dense series has short ones.
    A point meets one bucket and searches it in halves; what lies beyond a bucket's ends is carried over by a window over one row per
    bucket (BUCKETS of them at most), so no window runs over all rows. Points with a null time, and null times of the series, bracket nothing.
    """
    us = lambda c: timefn.micros(F.col(c))
    s = series.select(us(t).alias("_s"), F.col(value).alias("_v")).where("_s is not null")
    first, last, n = s.agg(F.min("_s"), F.max("_s"), F.count("*")).first()
    first, last = first or 0, last or 0
    width = max(1, (last - first) // max(1, min(BUCKETS, n // IN_BUCKET)) + 1)
    bucket = lambda c: F.floor((F.least(F.greatest(c, F.lit(first - 1)), F.lit(last + 1)) - first) / width)
    inner = s.groupBy(bucket(F.col("_s")).alias("_d")).agg(F.sort_array(F.collect_list(F.struct("_s", "_v"))).alias("_own"))
    wanted = points.select(bucket(us(t)).alias("_d")).where("_d is not null").distinct()
    w = Window.orderBy("_d")
    ends = inner.select("_d", F.get("_own", F.lit(0)).alias("_first"), F.element_at("_own", -1).alias("_last"), F.size("_own").alias("_n"))
    longest = ends.agg(F.max("_n")).first()[0] or 0
    spine = ends.join(wanted, "_d", "full").select("_d", F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    table = spine.join(inner, "_d", "left")
    out = points.withColumn("_t", us(t)).withColumn("_d", bucket(F.col("_t"))).join(table, "_d", "left")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, longest.bit_length())))])
    below = F.aggregate(steps, F.lit(0), lambda pos, k: F.when(F.coalesce(F.get("_own", pos + k - 1)["_s"] < F.col("_t"), F.lit(False)), pos + k).otherwise(pos))
    out = out.withColumn("_pos", below)
    known = F.col("_t").isNotNull()
    lo = F.when(known, F.coalesce(F.get("_own", F.col("_pos") - 1), F.col("_before")))
    hi = F.when(known, F.coalesce(F.get("_own", F.col("_pos")), F.col("_after")))
    out = out.withColumns({"_lo": lo, "_hi": hi})
    return out.withColumns({"lo_us": F.col("_lo._s"), "lo": F.col("_lo._v"), "hi_us": F.col("_hi._s"), "hi": F.col("_hi._v")}).drop("_t", "_d", "_before", "_after", "_own", "_pos", "_lo", "_hi")


def check_axis(df: DataFrame, t: str = "t", order: str = "t_idx") -> None:
    """T-07, A-13 for an axis in a table."""
    w = Window.orderBy(order)
    bad = df.select(t, F.lag(t).over(w).alias("_p")).where(F.col(t) <= F.col("_p")).limit(1).collect()
    if bad:
        raise TimeSeriesError(f"{bad[0][0]} does not follow {bad[0][1]}")


__all__ = ["OutOfTimeRange", "TimeAxis", "TimeSeriesError", "bracket_join", "check_axis"]
