"""Row-local feature expressions (no ordering needed).

Two hour sources exist on purpose: the cyclical encodings use the raw
``hour``/``month`` columns of the input, while the flags and ``temp_hour``
use the hour of ``datetime``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltcast.constants import DAY_HOURS, PEAK_HOURS, WEEKEND_FROM


def cyclical(col: str | Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2*pi*col/period``."""
    c = F.col(col) if isinstance(col, str) else col
    angle = F.lit(2.0) * F.pi() * c.cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def add_cyclical(df: DataFrame, hour_col: str = "hour", month_col: str = "month") -> DataFrame:
    hs, hc = cyclical(hour_col, 24)
    ms, mc = cyclical(month_col, 12)
    return df.withColumns({"hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc})


def add_wind(df: DataFrame, wdir_col: str = "wdir") -> DataFrame:
    """Circular wind direction (degrees) as sin/cos; the raw column is kept."""
    s, c = cyclical(wdir_col, 360)
    return df.withColumns({"wdir_sin": s, "wdir_cos": c})


def add_calendar(df: DataFrame, ts_col: str = "datetime") -> DataFrame:
    """weekday (Monday = 0), weekend, is_peak_hour and is_day (inclusive ranges)."""
    ts = F.col(ts_col)
    wd = F.weekday(ts)
    hr = F.hour(ts)
    return df.withColumns({
        "weekday": wd,
        "weekend": (wd >= WEEKEND_FROM).cast("int"),
        "is_peak_hour": hr.between(*PEAK_HOURS).cast("int"),
        "is_day": hr.between(*DAY_HOURS).cast("int"),
    })


def add_interactions(df: DataFrame, ts_col: str = "datetime", temp_col: str = "temp",
                     peak_col: str = "is_peak_hour") -> DataFrame:
    """temp_hour = temp x hour(datetime); temp_x_peak = temp x peak flag."""
    t = F.col(temp_col)
    return df.withColumns({
        "temp_hour": t * F.hour(F.col(ts_col)),
        "temp_x_peak": t * F.col(peak_col),
    })


def nan_to_null(df: DataFrame) -> DataFrame:
    """CSV ``NaN`` reads as a double NaN; the reference treats it as missing."""
    exprs = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            exprs.append(F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) in any column, as ``dropna()`` does."""
    return nan_to_null(df).dropna(how="any")
