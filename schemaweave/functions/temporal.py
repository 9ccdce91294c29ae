"""Calendar features and coordinate rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_of_week_mon0(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def season(month) -> Column:
    """Month bins (0,3], (3,6], (6,9], (9,12] -> winter, spring, summer, fall."""
    m = _c(month)
    return (F.when((m > 0) & (m <= 3), "winter").when((m > 3) & (m <= 6), "spring")
             .when((m > 6) & (m <= 9), "summer").when((m > 9) & (m <= 12), "fall"))


def temporal_columns(ts) -> dict[str, Column]:
    """hour, day_of_week, month, year, is_weekend, is_night, season.

    A null time gives null parts, 0 flags and a null season.
    """
    t = _c(ts)
    hour, dow, month = F.hour(t), day_of_week_mon0(t), F.month(t)
    return {
        "hour": hour,
        "day_of_week": dow,
        "month": month,
        "year": F.year(t),
        "is_weekend": F.coalesce(dow.isin(5, 6), F.lit(False)).cast("int"),
        "is_night": F.coalesce((hour >= 22) | (hour <= 6), F.lit(False)).cast("int"),
        "season": season(month),
    }


def round_half_even(col, digits: int = 2) -> Column:
    """Scale, round half to even, unscale (not F.round, which rounds half up)."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * scale) / scale


def fill_year(year, ts) -> Column:
    """Keep a present year, else take it from the timestamp."""
    return F.coalesce(_c(year).cast("bigint"), F.year(_c(ts)).cast("bigint"))
