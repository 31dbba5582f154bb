"""Exact order statistics that never gather a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clip, nan_to_null
from ..session import stage_table
from .series import join_null_safe

ACCURACY = 50_000
RANGE_ROWS = 1_000_000


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, q: float, accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, quantile): the exact linear-interpolated quantile of each group's non-null values.

    One mergeable sketch per group gives a band of values around the wanted rank, wider than four times the sketch's error of
    1 / ``accuracy`` of the rows and two rows (at most eight times as wide as that). An exact count below the band and the distinct values inside it then give the rank
    itself: two passes whatever the size, and what is sorted is the band only. Ties are counted, not listed. A group
    without values has no row; null groups are groups.
    """
    by = list(by)
    margins = [4 / accuracy * 8**i for i in range(20) if 4 / accuracy * 8 ** (i - 1) < 1]
    values = df.select(*by, nan_to_null(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    cuts = [*[max(0.0, q - m) for m in margins], *[min(1.0, q + m) for m in margins]]
    sketch = values.groupBy(*by).agg(F.count("_v").alias("n"), F.percentile_approx("_v", cuts, accuracy).alias("_ends"))
    need = 4 / accuracy + 2 / F.col("n")
    chosen = F.lit(len(margins) - 1)
    for i in reversed(range(len(margins) - 1)):
        chosen = F.when(F.lit(margins[i]) >= need, F.lit(i)).otherwise(chosen)
    sketch = sketch.withColumns({"_lo": F.get("_ends", chosen), "_hi": F.get("_ends", chosen + len(margins))}).drop("_ends")
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    held = join_null_safe(values, sketch, by).where(v <= hi)
    counts = held.groupBy(*by, "n", F.when(v >= lo, v).alias("_v")).agg(F.count(F.lit(1)).alias("_rows"))
    run = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    upto, target = F.col("_upto"), F.lit(q) * (F.col("n") - 1)
    first = F.floor(target)
    second = F.ceil(target)
    ranked = counts.withColumn("_upto", F.sum("_rows").over(run))
    # what lies below the band is the row without a value: were a wanted rank there, the sketch would have missed its error
    found = ranked.groupBy(*by, "n").agg(
        F.min(F.when(upto > first, F.struct(upto.alias("u"), "_v"))).alias("_a"), F.min(F.when(upto > second, F.struct(upto.alias("u"), "_v"))).alias("_b")
    )
    a, b = F.col("_a._v"), F.col("_b._v")
    exact = a + (b - a) * (target - first)
    missed = F.raise_error(F.lit("the quantile lies outside the sketch's error band")).cast("double")
    return found.select(*by, "n", F.when(a.isNull() | b.isNull(), missed).otherwise(exact).alias("quantile"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float, accuracy: int = ACCURACY) -> dict[str, float | None]:
    """Linear-interpolated quantile of each column's non-null values; None for an empty one. One number per column is collected."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])
    found = group_quantiles(df.select(F.inline(cells)), ["c"], "v", q, accuracy) if cols else None
    return dict.fromkeys(cols) | ({r["c"]: r["quantile"] for r in found.collect()} if found is not None else {})


def tail_limits(df: DataFrame, cols: Sequence[str], q: float = 0.999, exact: bool = True) -> dict[str, float | None]:
    """Upper clip limit per column over all series.

    ``exact=False`` takes Spark's quantile sketch instead: one pass for all columns.
    """
    cols = [c for c in cols if c in df.columns]
    if exact:
        return exact_quantiles(df, cols, q)
    row = df.agg(*[F.percentile_approx(nan_to_null(c), q, 100_000).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def clip_tail(df: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    """Clip each column to 0 and its limit; a column without a limit is left as it is."""
    return df.withColumns({c: clip(c, 0.0, hi) for c, hi in limits.items() if hi is not None})


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` stored with ``_range``: consecutive stretches of the order by (``by``, ``order``) of about ``rows`` rows each.

    The number of ranges follows the row count, and their borders follow the data, so a group of any size is cut like the
    rest. ``order`` should tell rows apart. What is computed per range and summed over the ranges before it is a prefix sum.
    """
    df = stage_table(df, "unranged")
    ranges = max(1, -(-df.count() // rows))
    return stage_table(df.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def before_ranges(ranged: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(by, _range, ``_o_<name>``...): each aggregate over the group's earlier ranges, and ``_all_<name>`` over all of them."""
    parts = ranged.groupBy(*by, "_range").agg(*[c.alias(f"_s_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    return parts.select(*by, "_range", *offsets, *[F.sum(f"_s_{n}").over(group).alias(f"_all_{n}") for n in sums])


def below_counts(df: DataFrame, value: str, weights: Sequence[str], group: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Sum of each weight over the rows with a smaller value, per distinct value.

    Rows are reduced to distinct values per group and cut into ranges; running sums are taken inside a range and offset by
    those of the ranges before it, so the work is even whatever the distribution and the size.
    """
    by = [group] if group else []
    keyed = df.groupBy(*by, value).agg(*[F.sum(w).alias(w) for w in weights])
    ranged = in_ranges(keyed, by, [value], rows)
    offsets = before_ranges(ranged, by, {w: F.sum(w) for w in weights}).drop(*[f"_all_{w}" for w in weights])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_null_safe(ranged, offsets, [*by, "_range"])
    return joined.select(
        *by,
        value,
        *weights,
        *[(F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_below") for w in weights],
    )
