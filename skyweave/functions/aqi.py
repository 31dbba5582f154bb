"""Air-quality index expressions (native CASE, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import as_col

# Concentration breakpoints (low, high) and index range (low, high).
PM25_BREAKPOINTS = [
    (0, 30, 0, 50),
    (31, 60, 51, 100),
    (61, 90, 101, 200),
    (91, 120, 201, 300),
    (121, 250, 301, 400),
]
PM10_BREAKPOINTS = [
    (0, 50, 0, 50),
    (51, 100, 51, 100),
    (101, 250, 101, 200),
    (251, 350, 201, 300),
    (351, 430, 301, 400),
]
# Upper concentration, its lower neighbour, index at that neighbour, index rise, width.
PM25_CONTINUOUS = [
    (30, 0, 0, 50, 30),
    (60, 30, 50, 50, 30),
    (90, 60, 100, 100, 30),
    (120, 90, 200, 100, 30),
    (None, 120, 300, 100, 130),
]
# Upper bound (inclusive) and name of each index band.
AQI_BANDS = [
    (50, "Good"),
    (100, "Satisfactory"),
    (200, "Moderate"),
    (300, "Poor"),
    (500, "Very Poor"),
]
AQI_CAP = 500.0


def sub_index(value: Column | str, breakpoints: list[tuple]) -> Column:
    """Piecewise linear sub-index; null unless the concentration is above zero.

    Each piece is the line through its own breakpoints, chosen by upper bound only, so
    a value that falls between two integer breakpoints is extrapolated below the piece.
    """
    v = as_col(value)
    out = None
    for i, (c_lo, c_hi, i_lo, i_hi) in enumerate(breakpoints):
        slope = (i_hi - i_lo) / (c_hi - c_lo + 1e-9)
        line = F.lit(slope) * (v - F.lit(float(c_lo))) + F.lit(float(i_lo))
        if i == len(breakpoints) - 1:
            out = out.otherwise(F.least(line, F.lit(AQI_CAP)))
        else:
            test = v <= F.lit(float(c_hi))
            out = F.when(test, line) if out is None else out.when(test, line)
    return F.when(v > 0, out)


def aqi(pm25: Column | str, pm10: Column | str) -> Column:
    """Worst of the two sub-indices; null when neither counts (greatest skips nulls)."""
    return F.greatest(sub_index(pm25, PM25_BREAKPOINTS), sub_index(pm10, PM10_BREAKPOINTS))


def aqi_pm25(pm25: Column | str) -> Column:
    """Index from PM2.5 alone, continuous over the breakpoints."""
    v = as_col(pm25)
    out = None
    for top, base, index, rise, width in PM25_CONTINUOUS:
        line = F.lit(float(index)) + (v - F.lit(float(base))) / F.lit(float(width)) * F.lit(float(rise))
        if top is None:
            out = out.otherwise(F.least(line, F.lit(AQI_CAP)))
        else:
            out = F.when(v <= top, line) if out is None else out.when(v <= top, line)
    return F.when(v.isNotNull(), out)


def aqi_band(value: Column | str) -> Column:
    """Band name, bands being half open (previous upper, upper]; null outside 0..500."""
    v = as_col(value)
    out = F.when(v < 0, None)
    for top, name in AQI_BANDS:
        out = out.when(v <= top, F.lit(name))
    return out
