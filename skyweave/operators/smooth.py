"""Savitzky-Golay smoothing as a window expression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fill import carry_fill
from .series import CHUNK_ROWS, LEN, POS, chunk_window, drop_position, home_rows, in_series, with_halo, with_position


def fit_weights(window: int, poly: int) -> np.ndarray:
    """Row t: the weights that give a least-squares polynomial's value at point t of a window."""
    a = np.vander(np.arange(window, dtype=float) - window // 2, poly + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def _dot(weights: Sequence[float], values: Sequence[Column]) -> Column:
    terms = [F.lit(float(w)) * v for w, v in zip(weights, values)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def savgol(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    window: int = 11,
    poly: int = 2,
    suffix: str = "_smooth",
    prefilled: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    keep_position: bool = False,
) -> DataFrame:
    """Add ``<c><suffix>``: the value of a local least-squares polynomial.

    Rows closer than half a window to an end take the fit of the first or last full window.
    A series shorter than the window gets a centred 5-row mean of the unfilled values. Rows without a key or time get null.
    """
    cols = [c for c in cols if c in df.columns]
    half, edge = window // 2, window - 1
    weights = fit_weights(window, poly)
    placed = with_position(df, keys, order)
    work = placed.withColumns({f"_raw_{c}": F.col(c) for c in cols})
    if not prefilled:
        work = carry_fill(work, cols, keys, order, 0.0, chunk_rows)
    haloed = with_halo(work, edge, edge, chunk_rows)
    w = chunk_window(keys)
    # one struct per row is shifted, not one value per column: 2*edge window functions in all
    haloed = haloed.withColumn("_v", F.struct(*[F.col(c).cast("double").alias(c) for c in cols]))
    shifted = {0: F.col("_v")}
    exprs = {}
    for k in range(1, edge + 1):
        exprs[f"_b{k}"] = F.lag("_v", k).over(w)
        exprs[f"_a{k}"] = F.lead("_v", k).over(w)
        shifted[-k], shifted[k] = F.col(f"_b{k}"), F.col(f"_a{k}")
    for c in cols:
        exprs[f"_mid_{c}"] = F.avg(f"_raw_{c}").over(w.rowsBetween(-2, 2))
    wide = haloed.withColumns(exprs)
    from_end = F.col(LEN) - 1 - F.col(POS)
    out = {}
    for c in cols:
        smooth = F.when(F.col(LEN) < window, F.col(f"_mid_{c}"))
        for p in range(half):
            head = _dot(weights[p], [shifted[j - p][c] for j in range(window)])
            tail = _dot(weights[window - 1 - p], [shifted[p - edge + j][c] for j in range(window)])
            smooth = smooth.when(F.col(POS) == p, head).when(from_end == p, tail)
        middle = _dot(weights[half], [shifted[j - half][c] for j in range(window)])
        out[f"{c}{suffix}"] = F.when(in_series(), smooth.otherwise(middle))
    kept = home_rows(wide, chunk_rows)
    base = [F.col(f"_raw_{n}").alias(n) if n in cols else F.col(n) for n in placed.columns]
    done = kept.select(*base, *[e.alias(n) for n, e in out.items()])
    return done if keep_position else drop_position(done)
