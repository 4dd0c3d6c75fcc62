"""Column -> Column scalar functions.

All are compositions of built-in Spark SQL expressions, so they stay inside
whole-stage code generation; none is a Python UDF.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Monday first (weekday 0 = Monday).
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Fixed value: WGS84 equatorial radius in metres used by the Web Mercator projection.
EARTH_RADIUS_M = 6378137.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_as_null(c) -> Column:
    """A numeric 0 (or 0.0) becomes null; null stays null."""
    return F.nullif(_col(c), F.lit(0))


def epoch_seconds(ms) -> Column:
    """Epoch milliseconds -> whole epoch seconds, floored (null-propagating)."""
    return F.floor(_col(ms) / 1000).cast("long")


def from_epoch_ms(ms) -> Column:
    """Epoch milliseconds -> UTC wall time as ``timestamp_ntz``, floored to the second.

    ``timestamp_add`` on a ``timestamp_ntz`` epoch does not consult the session
    time zone, so the result is the same on every cluster.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", epoch_seconds(ms), epoch)


def local_time(ts, tz) -> Column:
    """UTC wall time -> wall time in the zone named by column ``tz``."""
    return F.convert_timezone(F.lit("UTC"), _col(tz), _col(ts))


def year(ts) -> Column:
    """X8."""
    return F.year(_col(ts))


def month(ts) -> Column:
    """X9."""
    return F.month(_col(ts))


def weekday(ts) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(ts))


def hour(ts) -> Column:
    """X11."""
    return F.hour(_col(ts))


def fractional_hour(ts) -> Column:
    """Hour + minute / 60."""
    return F.hour(_col(ts)) + F.minute(_col(ts)) / F.lit(60.0)


def weekday_name(wd) -> Column:
    """0..6 -> Mon..Sun."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.element_at(names, _col(wd).cast("int") + 1)


def day_type(wd, weekend_start: int = 6) -> Column:
    """'weekend' for weekday >= ``weekend_start`` else 'weekday'.

    6 is the hourly tables' cut (Monday-Saturday against Sunday); 5 makes the
    weekend Saturday and Sunday, as the daily heat table's weekend share does.
    """
    return F.when(_col(wd) >= weekend_start, F.lit("weekend")).otherwise(F.lit("weekday"))


def host_flag(host_num, floor: int = 2) -> Column:
    """1 when a group hosted at least ``floor`` events at a venue, else 0."""
    return (_col(host_num) >= floor).cast("int")


def marker_size(host_num) -> Column:
    """ln(host_num) * 3."""
    return F.log(_col(host_num)) * 3


def mercator_x(lon) -> Column:
    """Longitude in degrees -> Web Mercator x in metres."""
    return _col(lon) * (EARTH_RADIUS_M * math.pi / 180.0)


def mercator_y(lat) -> Column:
    """Latitude in degrees -> Web Mercator y in metres; null at or beyond the poles."""
    lat = _col(lat)
    inside = (lat > -90) & (lat < 90)
    return F.when(inside, F.log(F.tan((lat + 90) * (math.pi / 360.0))) * EARTH_RADIUS_M)


def recent(ts, since: str = "2018-01-01 00:00:00") -> Column:
    """activity after a point in time (boolean)."""
    return _col(ts) > F.lit(since).cast("timestamp_ntz")


def nan_median(values) -> Column:
    """Median of the non-null, non-NaN numbers of an array column, rounded
    half-to-even to an int; null when none is left.

    Per row, as the reference's function takes a list; for the median of a
    column over groups of rows see :func:`gatherlens.operators.quantiles.exact_median`.
    """
    vals = F.array_sort(F.filter(_col(values).cast("array<double>"),
                                 lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(vals)
    upper = F.element_at(vals, (n / 2).cast("int") + 1)
    lower = F.element_at(vals, ((n + 1) / 2).cast("int"))
    med = (upper + lower) / 2
    return F.when(n > 0, F.bround(med, 0).cast("int"))


def repeat_by_count(value, count) -> Column:
    """Histogram (value, count) -> array of ``count`` copies of value (explode it)."""
    return F.array_repeat(_col(value), _col(count).cast("int"))


def linspace(start: float, stop: float, num: int) -> Column:
    """``num`` evenly spaced points from start to stop inclusive, as an array."""
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: F.lit(float(start)) + i * F.lit(step))
