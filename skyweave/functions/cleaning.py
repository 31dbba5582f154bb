"""Scalar cleaning expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """Missing is null everywhere in this library; NaN is turned into null at ingest."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to ``[lo, hi]``; null stays null (bare greatest/least would skip it)."""
    c = as_col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def lenient_double(c: Column | str, default: float | None = 0.0) -> Column:
    """Text to double; text that is no number gives ``default``."""
    value = nan_to_null(as_col(c).try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def fixed(c: Column | str, places: int = 6) -> Column:
    """Round half up on a decimal grid with the plain IEEE steps any engine repeats."""
    scale = float(10**places)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def decimal_text(c: Column | str, places: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form up instead.
    """
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", as_col(c).cast("double"), F.lit(pattern))


def ensure_columns(df: DataFrame, names: Iterable[str], dtype: str = "double") -> DataFrame:
    """Add the columns that are absent as nulls."""
    absent = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast(dtype) for n in absent}) if absent else df


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN to null in every floating point column."""
    names = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: nan_to_null(n) for n in names}) if names else df
