"""Gap filling on keyed series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stage, lazy
from .series import CHUNK_ROWS, POS, drop_position, in_series, neighbours, with_position

GAP_LIMIT = 6


def _linear(c: str, limit: int) -> Column:
    """Value of a missing cell from its nearest neighbours.

    A cell is filled when a known value lies within ``limit`` rows on either side, so a
    gap of up to twice the limit closes fully and a longer one only near its two ends.
    """
    before, after = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
    back, ahead = F.col(POS) - before["pos"], after["pos"] - F.col(POS)
    slope = (after["val"] - before["val"]) / (after["pos"] - before["pos"])
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(before.isNotNull() & after.isNotNull() & ((back <= limit) | (ahead <= limit)), before["val"] + slope * back)
        .when(before.isNull() & (ahead <= limit), after["val"])
        .when(after.isNull() & (back <= limit), before["val"])
    )


def _replace(df: DataFrame, names: Sequence[str], values: dict[str, Column]) -> DataFrame:
    return df.select(*[values[n].alias(n) if n in values else F.col(n) for n in names])


def interpolate(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    limit: int = GAP_LIMIT,
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = lazy,
) -> DataFrame:
    """Linear interpolation by row position, at most ``limit`` rows from a known value; rows without a key or time keep what they have."""
    cols = [c for c in cols if c in df.columns]
    placed = with_position(df, keys, order, stage=stage)
    near = neighbours(placed, cols, keys, chunk_rows, stage)
    return _replace(near, placed.columns, {c: _linear(c, limit) for c in cols})


def carry_fill(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    fill: float | None = 0.0,
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = lazy,
) -> DataFrame:
    """Forward fill, then backward fill, then a constant; rows without a key or time keep what they have."""
    cols = [c for c in cols if c in df.columns]
    placed = with_position(df, keys, order, stage=stage)
    near = neighbours(placed, cols, keys, chunk_rows, stage)
    tail = [] if fill is None else [F.lit(float(fill))]
    values = {c: F.when(in_series(), F.coalesce(F.col(f"_prev_{c}")["val"], F.col(f"_next_{c}")["val"], *tail)).otherwise(F.col(c)) for c in cols}
    return _replace(near, placed.columns, values)


def seasonal_means(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("city",), order: str = "datetime"
) -> DataFrame:
    """Mean of each column by (key, month, hour), over all years."""
    slot = df.withColumns({"_m": F.month(order), "_h": F.hour(order)})
    return slot.groupBy(*keys, "_m", "_h").agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])


def seasonal_fill(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    fill: float | None = 0.0,
    stage: Stage = lazy,
) -> DataFrame:
    """Missing cells take the seasonal mean of their slot, then a constant.

    The means are a partial aggregate (at most 288 rows a key) joined back on the slot, so
    no slot is gathered in one task; the join strategy is left to the optimizer.
    """
    cols = [c for c in cols if c in df.columns]
    means = stage(seasonal_means(df, cols, keys, order), "seasonal")
    joined = df.withColumns({"_m": F.month(order), "_h": F.hour(order)}).join(means, [*keys, "_m", "_h"], "left")
    tail = [] if fill is None else [F.lit(float(fill))]
    return _replace(joined, df.columns, {c: F.coalesce(F.col(c), F.col(f"_mean_{c}"), *tail) for c in cols})


def fill_gaps(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    limit: int = GAP_LIMIT,
    fill: float | None = 0.0,
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = lazy,
    keep_position: bool = False,
) -> DataFrame:
    """Interpolation, then seasonal means of the interpolated column, then a constant.

    The interpolated rows are used twice (means and rows); ``stage`` may write them to a
    table in between so that they are computed once.
    """
    linear = stage(interpolate(df, cols, keys, order, limit, chunk_rows, stage), "interpolated")
    out = seasonal_fill(linear, cols, keys, order, fill, stage)
    return out if keep_position else drop_position(out)
