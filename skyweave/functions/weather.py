"""Ratios, interactions, calendar and wind expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import as_col

EPSILON = 1e-6


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / (den + 1e-6)``; null, not an error, where that denominator is zero."""
    return F.try_divide(as_col(num), as_col(den) + F.lit(EPSILON))


def zero(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0.0))


def cycle(part: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a calendar part on a circle of ``period`` steps."""
    angle = F.lit(2 * math.pi) * part / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """hour, dayofweek (Monday is 0), month, is_weekend and the two circle encodings."""
    t = as_col(ts)
    hour, dow, month = F.hour(t), F.weekday(t), F.month(t)
    h_sin, h_cos = cycle(hour, 24)
    m_sin, m_cos = cycle(month, 12)
    return {
        "hour": hour,
        "dayofweek": dow,
        "month": month,
        "is_weekend": (dow >= 5).cast("int"),
        "hour_sin": h_sin,
        "hour_cos": h_cos,
        "month_sin": m_sin,
        "month_cos": m_cos,
    }


def season(ts: Column | str) -> Column:
    """Four classes: DJF Winter, MAM Summer, JJAS Monsoon, ON PostMonsoon."""
    m = F.month(as_col(ts))
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.between(3, 5), "Summer")
        .when(m.between(6, 9), "Monsoon")
        .when(m.isin(10, 11), "PostMonsoon")
    )


def wind_columns(speed: Column | str, direction: Column | str) -> dict[str, Column]:
    """u = speed sin(theta), v = speed cos(theta); missing counts as zero."""
    theta = F.radians(zero(direction))
    return {"wind_u": zero(speed) * F.sin(theta), "wind_v": zero(speed) * F.cos(theta)}


def ratio_columns() -> dict[str, Column]:
    return {
        "ratio_pm25_pm10": ratio("PM2_5", "PM10"),
        "ratio_co_no2": ratio("CO", "NO2"),
        "ratio_so2_no2": ratio("SO2", "NO2"),
    }


def interaction_columns() -> dict[str, Column]:
    return {
        "co_x_no2": F.col("CO") * F.col("NO2"),
        "so2_x_no2": F.col("SO2") * F.col("NO2"),
        "aod_x_wind": zero("AOD") * zero("wind_speed"),
        "fire_x_no2": zero("fire_count") * F.col("NO2"),
    }
