"""Daily decomposition, residuals and spike flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import fixed
from ..session import Stage, lazy, stage_table
from .features import over_chunks
from .fill import carry_fill
from .order_stats import group_quantiles
from .series import CHUNK, CHUNK_ROWS, LEN, POS, densify, drop_position, in_series, join_null_safe, with_position

# Columns that are decomposed.
RESIDUAL_COLUMNS = ["PM2_5", "NO2", "SO2", "AOD"]


def daily_means(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    fill: bool = True,
    stage: Stage = lazy,
    keep_position: bool = False,
) -> DataFrame:
    """Mean per key and day on a complete calendar; gaps carried forward, backward, then 0.

    The rows are read once if ``stage`` stores the daily table, which is small beside them.
    """
    cols = [c for c in cols if c in df.columns]
    daily = df.groupBy(*keys, F.col(order).cast("date").alias("date")).agg(*[F.avg(c).alias(c) for c in cols])
    full = densify(daily, keys, "date", "1 day", stage=stage, keep_position=fill or keep_position)
    out = carry_fill(full, cols, keys, "date") if fill else full
    return out if keep_position else drop_position(out)


def _lines(v: np.ndarray, w: np.ndarray, first: int, at: np.ndarray, size: int, span: int) -> np.ndarray:
    """Weighted local lines over the ``span`` nearest of ``size`` points, of which those from ``first`` on are at hand.

    Where all weights vanish a point's own value stands, and null (NaN) outside of the points.
    """
    left = np.clip(at - span // 2, 0, size - span)
    e = left[:, None] + np.arange(span) - at[:, None]
    where = e + (at - first)[:, None]
    known = (where >= 0) & (where < len(v))
    where = np.clip(where, 0, len(v) - 1)
    d = np.abs(e) / np.abs(e).max(axis=1, keepdims=True)
    k = np.where(d <= 0.001, 1.0, np.where(d <= 0.999, (1 - np.minimum(d, 1) ** 3) ** 3, 0.0)) * np.where(known, w[where], 0.0)
    t = k.sum(axis=1)
    k = k / np.where(t > 0, t, 1.0)[:, None]
    centre, level = (k * e).sum(axis=1), (k * v[where]).sum(axis=1)
    e = e - centre[:, None]
    spread = (k * e * e).sum(axis=1)
    sloped = np.sqrt(spread) > 0.001 * max(size - 1, 1)
    fit = level - np.where(sloped, centre * (k * e * v[where]).sum(axis=1) / np.where(sloped, spread, 1.0), 0.0)
    own = np.where((at >= 0) & (at < size) & (at >= first) & (at < first + len(v)), v[np.clip(at - first, 0, len(v) - 1)], np.nan)
    return np.where(t > 0, fit, own)


def _stl_chunk(chunk: pd.DataFrame, passes: int, period: int, seasonal: int, trend_span: int, low_span: int) -> pd.DataFrame:
    """Inner passes over one chunk and its halo: weekly cycle, low pass, season, trend."""
    chunk = chunk.sort_values(POS, ignore_index=True)
    place, size = chunk[POS].to_numpy(), int(chunk[LEN].iloc[0])
    y, trend = chunk["value"].to_numpy(float), chunk["trend"].to_numpy(float)
    real = np.flatnonzero((place >= 0) & (place < size))
    known = np.isfinite(y[real])
    w = np.where(known, chunk["weight"].to_numpy(float)[real], 0.0)
    y, at, start = np.where(known, y[real], 0.0), place[real], int(place[real[0]]) if len(real) else 0
    trend, season = trend[real], np.zeros(len(real))
    # moving means of period, period and 3 days in one
    moving = np.convolve(np.convolve(np.ones(period) / period, np.ones(period) / period), np.ones(3) / 3)
    for _ in range(passes if len(real) else 0):
        rest, cycle = y - trend, np.zeros(len(place))
        for phase in range(period):
            mine = np.flatnonzero(at % period == phase)
            asked = np.flatnonzero(place % period == phase)
            steps = (size - 1 - phase) // period + 1
            if not len(mine):
                continue
            step = place[asked] // period
            fit = _lines(rest[mine], w[mine], int(at[mine[0]] // period), step, steps, seasonal)
            # beyond an end without weights the smoothed neighbour stands
            for edge, beside in ((0, 1), (-1, -2)):
                if len(fit) > 1 and np.isnan(fit[edge]):
                    fit[edge] = fit[beside]
            cycle[asked] = fit
        low = np.convolve(cycle, moving, "same")[real]
        season = cycle[real] - _lines(low, np.ones(len(low)), start, at, size, low_span)
        trend = _lines(y - season, w, start, at, size, trend_span)
    full = np.full((2, len(place)), np.nan)
    full[0, real], full[1, real] = trend, season
    return chunk.assign(trend=full[0], seasonal=full[1])


def _stl_series(series: pd.DataFrame, outer: int, **spans: int) -> pd.DataFrame:
    """All rounds over a series that one chunk holds, by the same rule for weights as ``_stl_weights``."""
    for step in range(outer + 1):
        if step:
            miss = (series["value"] - series["seasonal"] - series["trend"]).abs()
            limit = 6 * miss.median()
            soft = (1 - (miss / limit).clip(upper=1) ** 2) ** 2 if limit > 0 else (miss <= 0).astype(float)
            soft = soft.mask(miss <= 0.001 * limit, 1.0).mask(miss > 0.999 * limit, 0.0) if limit > 0 else soft
            series["weight"] = soft.fillna(1.0)
        series = _stl_chunk(series, **spans)
    return series


def _stl_weights(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bisquare weights from each row's miss against six times the series' exact median miss."""
    miss = F.abs(F.col("value") - F.col("seasonal") - F.col("trend"))
    state = state.withColumn("_miss", miss)
    median = group_quantiles(state.where("value is not null"), by, "_miss", 0.5).select(*by, (F.col("quantile") * 6).alias("_limit"))
    part = F.col("_miss") / F.col("_limit")
    soft = F.when(part <= 0.001, 1.0).when(part > 0.999, 0.0).otherwise(F.pow(1 - F.pow(part, 2), 2))
    weight = F.when(F.col("_limit") > 0, soft).otherwise(F.when(F.col("_miss") <= 0, 1.0).otherwise(0.0))
    return join_null_safe(state, median, by).withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("_miss", "_limit")


def stl_daily(
    daily: DataFrame,
    cols: Sequence[str] = tuple(RESIDUAL_COLUMNS),
    keys: Sequence[str] = ("city",),
    period: int = 7,
    robust: bool = True,
    min_days: int = 60,
    seasonal: int = 7,
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = stage_table,
) -> DataFrame:
    """(keys, date, series, trend, seasonal, residual) of every daily column by robust seasonal-trend decomposition.

    The published procedure with local lines: 16 rounds of two passes, or, if not ``robust``, one round of five. No task gets more
    than a chunk. A series of at most ``chunk_rows`` days goes through all rounds in one group. Longer ones go round by
    round, all at once: a round works on chunks whose halo holds what its passes can reach, its rows are stored, and
    robustness weights come from the exact median miss of each series. Both give the same numbers.

    Days must follow each other without a gap, as ``daily_means`` gives them; a day without a value has no weight and a null
    residual. ``min_days`` is ``seasonal`` periods at least. A series shorter than ``min_days`` has residual 0 and trend the value. Rows without a key or date have nulls.
    """
    keys = list(keys)
    cols = [c for c in cols if c in daily.columns]
    by = [*keys, "series"]
    inner, outer = (2, 15) if robust else (5, 0)
    trend_span = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    trend_span += 1 - trend_span % 2
    low_span = period + 1 + period % 2
    if min_days < max(seasonal * period, trend_span, low_span):
        raise ValueError("a series must hold the points of every local line")
    halo = inner * (seasonal * period + period + low_span + trend_span)
    if halo > chunk_rows:
        raise ValueError(f"a chunk must hold the reach of a round, {halo} rows")
    placed = with_position(daily, keys, "date", stage=stage)
    ids = [*keys, "date", POS, LEN]
    long = placed.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, "series", "value")
    place, size = F.col(POS), F.col(LEN)
    # the cycle is also fitted one period beyond either end
    none = F.array().cast("array<int>")
    shifts = F.concat(F.array(F.lit(0)), F.when(place == 0, F.sequence(F.lit(-period), F.lit(-1))).otherwise(none), F.when(place == size - 1, F.sequence(F.lit(1), F.lit(period))).otherwise(none))
    at = F.explode(shifts).alias("_shift")
    state = long.where(size >= min_days).select(*by, "date", POS, LEN, "value", at)
    real = F.col("_shift") == 0
    state = state.withColumns({POS: place + F.col("_shift"), "date": F.when(real, F.col("date")), "value": F.when(real, F.col("value")), "trend": F.lit(0.0), "seasonal": F.lit(0.0), "weight": F.lit(1.0)}).drop("_shift")
    own = F.greatest(F.floor(place / chunk_rows), F.lit(0))
    offset = place - own * chunk_rows
    copies = F.array(own, F.when(offset >= chunk_rows - halo, own + 1), F.when((offset < halo) & (own > 0), own - 1))
    spans = {"passes": inner, "period": period, "seasonal": seasonal, "trend_span": trend_span, "low_span": low_span}
    schema = ", ".join(f"`{n}` {t}" for n, t in state.dtypes)

    def all_rounds(series: pd.DataFrame) -> pd.DataFrame:
        return _stl_series(series.sort_values(POS, ignore_index=True), outer, **spans)

    def one_round(chunk: pd.DataFrame) -> pd.DataFrame:
        return _stl_chunk(chunk, **spans)

    state = stage(state, "stl-days")
    whole = state.where(size <= chunk_rows).groupBy(*by).applyInPandas(all_rounds, schema)
    state = state.where(size > chunk_rows)
    if state.isEmpty():
        state = whole
    else:
        for step in range(outer + 1):
            if step:
                state = _stl_weights(state, by)
            state = state.withColumn(CHUNK, F.explode(F.filter(copies, lambda c: c.isNotNull())))
            state = state.groupBy(*by, CHUNK).applyInPandas(one_round, f"{schema}, `{CHUNK}` bigint")
            state = stage(state.where(F.col(CHUNK) == own).drop(CHUNK), "stl-round")
        state = state.unionByName(whole)
    value = F.col("value")
    done = state.where("date is not null").select(*keys, "date", "series", "trend", "seasonal", (value - F.col("seasonal") - F.col("trend")).alias("residual"))
    brief = F.when(in_series(), F.lit(0.0))
    short = long.where((size < min_days) | ~in_series()).select(*keys, "date", "series", F.when(in_series(), value).alias("trend"), brief.alias("seasonal"), brief.alias("residual"))
    return done.unionByName(short)


def classical_daily(
    daily: DataFrame,
    cols: Sequence[str] = tuple(RESIDUAL_COLUMNS),
    keys: Sequence[str] = ("city",),
    min_days: int = 60,
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = stage_table,
) -> DataFrame:
    """The same table by centred 7-day mean trend and weekday means, without Python.

    Long form as in ``stl_daily``. The trend is stored, so that it is computed once; so are the weekday means, a partial
    aggregate whose join then goes by measured size. A series under ``min_days`` days has residual 0.
    """
    keys = list(keys)
    cols = [c for c in cols if c in daily.columns]
    ids = [*keys, "date", *[c for c in (POS, LEN) if c in daily.columns]]
    long = daily.select(*ids, *[F.col(c).cast("double") for c in cols]).unpivot(ids, cols, "series", "value")
    by = [*keys, "series"]
    trended = over_chunks(
        long, lambda w: {"trend": F.avg("value").over(w.rowsBetween(-3, 3))}, 3, 3, by, "date", chunk_rows, keep_position=True
    ).withColumn("_wd", F.weekday("date"))
    trended = stage(trended, "trended")
    means = stage(trended.groupBy(*by, "_wd").agg(F.avg(F.col("value") - F.col("trend")).alias("seasonal")), "weekday-means")
    joined = trended.join(means, [*by, "_wd"], "left")
    residual = F.when(F.col(LEN) < min_days, F.lit(0.0)).otherwise(F.col("value") - F.col("trend") - F.col("seasonal"))
    return joined.select(*keys, "date", "series", "trend", "seasonal", residual.alias("residual"))


def trailing_residual(df: DataFrame, col: str, rows: int = 7, **where) -> DataFrame:
    """Add ``<col>_residual``: value minus the mean of the last ``rows`` rows."""
    return over_chunks(df, lambda w: {f"{col}_residual": F.col(col) - F.avg(col).over(w.rowsBetween(1 - rows, 0))}, before=rows - 1, **where)


def centred_residual(df: DataFrame, col: str, rows: int = 24, **where) -> DataFrame:
    """Add ``<col>_residual``: value minus a centred mean; an even window leans back."""
    lo, hi = -(rows // 2), (rows - 1) // 2
    return over_chunks(df, lambda w: {f"{col}_residual": F.col(col) - F.avg(col).over(w.rowsBetween(lo, hi))}, before=-lo, after=hi, **where)


def residual_sigma(residuals: DataFrame, threshold: float = 2.5, keys: Sequence[str] = ("city", "series"), stage: Stage = stage_table) -> DataFrame:
    """Add residual_sigma and is_shock: distance from the series mean in deviations.

    The residuals and the moments of each series are stored: one decomposition, and a join by measured size.
    """
    residuals = stage(residuals, "residuals")
    stats = stage(residuals.groupBy(*keys).agg(F.avg("residual").alias("_m"), F.stddev_samp("residual").alias("_s")), "moments")
    sigma = F.try_divide(F.col("residual") - F.col("_m"), F.col("_s"))
    joined = residuals.join(stats, list(keys)).withColumn("residual_sigma", sigma).drop("_m", "_s")
    return joined.withColumn("is_shock", F.coalesce(F.col("residual_sigma") > threshold, F.lit(False)))


def attach_residuals(
    df: DataFrame,
    residuals: DataFrame,
    cols: Sequence[str] = tuple(RESIDUAL_COLUMNS),
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
) -> DataFrame:
    """Daily residuals onto the rows of their day as ``<c>_residual``; no match gives 0."""
    wide = residuals.groupBy(*keys, "date").agg(*[F.max(F.when(F.col("series") == c, F.col("residual"))).alias(f"{c}_residual") for c in cols])
    joined = df.withColumn("date", F.col(order).cast("date")).join(wide, [*keys, "date"], "left").drop("date")
    return joined.withColumns({f"{c}_residual": F.coalesce(F.col(f"{c}_residual"), F.lit(0.0)) for c in cols})


def spike_flags(
    df: DataFrame,
    cols: Sequence[str] = tuple(RESIDUAL_COLUMNS),
    sigma: float = 3.0,
    window: int = 72,
    min_periods: int = 12,
    name: str = "stl_spike",
    **where,
) -> DataFrame:
    """Add a flag: some residual above ``sigma`` times its rolling deviation.

    The deviation is 1 until the window holds ``min_periods`` values. Both sides are put on
    a 1e-9 grid first, so that rounding noise around a zero deviation is no spike.
    """
    cols = [c for c in cols if f"{c}_residual" in df.columns]

    def build(w) -> dict[str, Column]:
        frame = w.rowsBetween(1 - window, 0)
        flag = F.lit(False)
        for c in cols:
            r = f"{c}_residual"
            std = F.when(F.count(r).over(frame) >= min_periods, F.stddev_samp(r).over(frame))
            limit = F.lit(sigma) * fixed(F.coalesce(std, F.lit(1.0)), 9)
            flag = flag | F.coalesce(fixed(r, 9) > limit, F.lit(False))
        return {name: flag}

    return over_chunks(df, build, before=window - 1, **where)


def confirm_events(df: DataFrame, score_min: float = 0.82) -> DataFrame:
    """Add confirmed_event: a high anomaly score and a residual spike together."""
    return df.withColumn("confirmed_event", (F.col("anomaly_score") > score_min) & F.col("stl_spike"))


def flag_rates(df: DataFrame, keys: Sequence[str] = ("city",), threshold: float = 0.88) -> DataFrame:
    """Per key: rows, flagged rows and percent, spikes, confirmed rows and percent."""
    n = F.count(F.lit(1))
    flagged, confirmed = F.count_if(F.col("anomaly_score") > threshold), F.count_if("confirmed_event")
    return df.groupBy(*keys).agg(
        n.alias("n_rows"),
        flagged.alias("flagged"),
        (flagged * 100 / n).alias("flagged_pct"),
        F.count_if("stl_spike").alias("spikes"),
        confirmed.alias("confirmed"),
        (confirmed * 100 / n).alias("confirmed_pct"),
    )
