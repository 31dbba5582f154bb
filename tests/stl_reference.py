"""The published STL procedure on one array, which the distributed form must equal."""

from __future__ import annotations

import numpy as np


def _loess(y: np.ndarray, at: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """Local linear fit of equally spaced points, all evaluation points at once."""
    n = len(y)
    q = min(span, n)
    left = np.clip(np.round(at).astype(int) - q // 2, 0, n - q)
    idx = left[:, None] + np.arange(q)[None, :]
    dist = np.abs(idx - at[:, None])
    reach = np.maximum(at - left, left + q - 1 - at)
    if span > n:
        reach = reach + (span - n) // 2
    reach = np.maximum(reach, 1e-12)[:, None]
    w = np.where(dist <= 0.999 * reach, (1 - (dist / reach) ** 3) ** 3, 0.0)
    w = np.where(dist <= 0.001 * reach, 1.0, w) * weights[idx]
    total = w.sum(axis=1)
    safe = np.where(total > 0, total, 1.0)
    w = w / safe[:, None]
    centre = (w * idx).sum(axis=1)
    spread = (w * (idx - centre[:, None]) ** 2).sum(axis=1)
    level = (w * y[idx]).sum(axis=1)
    cross = (w * (idx - centre[:, None]) * y[idx]).sum(axis=1)
    sloped = np.sqrt(spread) > 0.001 * max(n - 1, 1)
    fit = level + np.where(sloped, (at - centre) * cross / np.where(sloped, spread, 1.0), 0.0)
    nearest = y[np.clip(np.round(at).astype(int), 0, n - 1)]
    out = np.where(total > 0, fit, nearest)
    # where all weights vanish the value itself stands, and beyond an end its smoothed neighbour
    if total[0] <= 0 and at[0] < 0:
        out[0] = out[1]
    if total[-1] <= 0 and at[-1] > n - 1:
        out[-1] = out[-2]
    return out


def _moving(y: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], y]))
    return (total[width:] - total[:-width]) / width


def stl_parts(
    y: np.ndarray, period: int = 7, seasonal: int = 7, robust: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and residual of the published STL procedure (degree-one loess)."""
    n = len(y)
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_span += 1 - trend_span % 2
    low_span = period + 1 + period % 2
    inner, outer = (2, 15) if robust else (5, 0)
    ones, t = np.ones(n), np.arange(n, dtype=float)
    weight, trend, season = ones, np.zeros(n), np.zeros(n)
    for step in range(outer + 1):
        for _ in range(inner):
            rest = y - trend
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                part, w = rest[phase::period], weight[phase::period]
                at = np.arange(-1, len(part) + 1, dtype=float)
                cycle[phase::period][: len(at)] = _loess(part, at, seasonal, w)
            low = _moving(_moving(_moving(cycle, period), period), 3)
            season = cycle[period : period + n] - _loess(low, t, low_span, ones)
            trend = _loess(y - season, t, trend_span, weight)
        if step < outer:
            miss = np.abs(y - season - trend)
            limit = 6 * np.median(miss)
            if limit <= 0:
                weight = (miss <= 0).astype(float)
                continue
            weight = (1 - np.minimum(miss / limit, 1.0) ** 2) ** 2
            weight = np.where(miss <= 0.001 * limit, 1.0, np.where(miss > 0.999 * limit, 0.0, weight))
    return trend, season, y - season - trend
