"""Lag, rolling and other row-frame features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import aqi
from ..functions.weather import calendar_columns, interaction_columns, ratio_columns, wind_columns
from .series import CHUNK_ROWS, chunk_window, drop_position, home_rows, in_series, with_halo, with_position

# Column groups.
GASES = ["NO2", "SO2", "CO", "O3"]
WEATHER = ["temp_c", "humidity", "wind_speed", "wind_dir", "precip", "pressure", "dewpoint", "cloud_pct"]
POLLUTANTS = ["PM2_5", "PM10", "NO2", "SO2", "CO", "O3"]
LAG_COLUMNS = ["PM2_5", "PM10", "NO2", "SO2", "CO", "AOD"]
LAGS = [1, 6, 24]
ROLL_COLUMNS = ["PM2_5", "PM10", "NO2", "SO2", "CO", "O3", "AQI"]


def lag_exprs(cols: Sequence[str], lags: Sequence[int], w) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags}


def rolling_exprs(cols: Sequence[str], means: Sequence[int], stds: Sequence[int], w) -> dict[str, Column]:
    out = {}
    for c in cols:
        for n in means:
            out[f"{c}_roll{n}_mean"] = F.avg(c).over(w.rowsBetween(1 - n, 0))
        for n in stds:
            out[f"{c}_roll{n}_std"] = F.coalesce(F.stddev_samp(c).over(w.rowsBetween(1 - n, 0)), F.lit(0.0))
    return out


def over_chunks(
    df: DataFrame,
    build,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    chunk_rows: int = CHUNK_ROWS,
    keep_position: bool = False,
) -> DataFrame:
    """Add the columns ``build(window)`` returns; all share one window, so one sort.

    ``before`` and ``after`` bound the rows the frames reach. Rows without a key or time stay, with null columns.
    """
    placed = with_position(df, keys, order)
    haloed = with_halo(placed, before, after, chunk_rows)
    wide = haloed.withColumns({name: F.when(in_series(), c) for name, c in build(chunk_window(keys)).items()})
    out = home_rows(wide, chunk_rows)
    return out if keep_position else drop_position(out)


def lags_and_rolls(
    df: DataFrame,
    lag_cols: Sequence[str] = tuple(LAG_COLUMNS),
    lags: Sequence[int] = tuple(LAGS),
    roll_cols: Sequence[str] = tuple(ROLL_COLUMNS),
    means: Sequence[int] = (6, 24),
    stds: Sequence[int] = (6,),
    **where,
) -> DataFrame:
    """Lags, rolling means and rolling sample deviations in one window."""
    lag_cols = [c for c in lag_cols if c in df.columns]
    roll_cols = [c for c in roll_cols if c in df.columns]
    reach = max([0, *(lags if lag_cols else []), *[n - 1 for n in (*means, *stds)]])

    def build(w):
        return {**lag_exprs(lag_cols, lags, w), **rolling_exprs(roll_cols, means, stds, w)}

    return over_chunks(df, build, before=reach, **where)


def aqi_with_fallback(df: DataFrame) -> DataFrame:
    """Add AQI; where more than half of all rows have none, the gaps take AOD times 200.

    The share is a scalar subquery (one partial aggregate), not a join.
    """
    with_aqi = df.withColumn("AQI", aqi("PM2_5", "PM10"))
    if "AOD" not in df.columns:
        return with_aqi
    missing = with_aqi.agg(F.avg(F.col("AQI").isNull().cast("double")).alias("share")).scalar()
    return with_aqi.withColumn("AQI", F.when(F.col("AQI").isNull() & (missing > 0.5), F.col("AOD") * 200).otherwise(F.col("AQI")))


def pointwise_features(df: DataFrame) -> DataFrame:
    """Ratios, interactions, calendar and wind columns in one projection."""
    return df.withColumns(
        {
            **ratio_columns(),
            **interaction_columns(),
            **calendar_columns("datetime"),
            **wind_columns("wind_speed", "wind_dir"),
        }
    )


def lead_target(df: DataFrame, col: str = "PM2_5", horizon: int = 24, name: str = "target_24h", **where) -> DataFrame:
    """The value ``horizon`` rows ahead."""
    return over_chunks(df, lambda w: {name: F.lead(col, horizon).over(w)}, after=horizon, **where)


def daily_momentum(
    daily: DataFrame,
    cols: Sequence[str] = ("PM2_5",),
    keys: Sequence[str] = ("city",),
    order: str = "date",
    **where,
) -> DataFrame:
    """Daily lags 1/3/7/14/30 and 7/14/30-row mean, deviation and maximum."""

    def build(w):
        out = lag_exprs(cols, (1, 3, 7, 14, 30), w)
        out |= rolling_exprs(cols, (7, 14, 30), (7, 14, 30), w)
        for c in cols:
            for n in (7, 14, 30):
                out[f"{c}_roll{n}_max"] = F.max(c).over(w.rowsBetween(1 - n, 0))
        return out

    return over_chunks(daily, build, before=30, keys=keys, order=order, **where)
