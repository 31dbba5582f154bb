"""Reproducible sampling, splits and folds by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import RANGE_ROWS, before_ranges, in_ranges
from .series import join_null_safe

HASH_RANGE = 1 << 30


def hash_of(cols: Sequence[str], seed: int = 42) -> Column:
    """Uniform integer in [0, 2^30) that depends on the row's identity alone.

    A row keeps its draw when a lost task runs again or the partitioning changes, which a
    random generator does not promise.
    """
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(HASH_RANGE))


def training_sample(
    df: DataFrame,
    ids: Sequence[str] = ("city", "datetime"),
    code: str = "event_code",
    normal_fraction: float = 0.08,
    seed: int = 42,
    draw: Column | None = None,
    draw_range: int = HASH_RANGE,
) -> DataFrame:
    """Every event row and ``normal_fraction`` of the Normal rows."""
    draw = hash_of(ids, seed) if draw is None else draw
    return df.filter((F.col(code) > 0) | (draw < F.lit(int(normal_fraction * draw_range))))


def stratified_rank(df: DataFrame, stratum: str, draw: Column, ids: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_rank`` (1-based, in draw order, ties by ``ids``) and ``_size`` within each stratum.

    One class may hold nearly all rows: classes are cut into ranges of draws of about ``rows`` rows, counts run over the
    ranges, and a row number inside each. The dealt rows are stored.
    """
    ranged = in_ranges(df.withColumn("_draw", draw), [stratum], ["_draw", *ids], rows)
    counts = before_ranges(ranged, [stratum], {"n": F.count(F.lit(1))})
    local = Window.partitionBy(stratum, "_range").orderBy("_draw", *ids)
    ranked = join_null_safe(ranged, counts, [stratum, "_range"]).withColumn("_rank", F.col("_o_n") + F.row_number().over(local))
    return ranked.withColumnRenamed("_all_n", "_size").drop("_draw", "_range", "_o_n")


def stratified_split(
    df: DataFrame,
    stratum: str,
    ids: Sequence[str],
    test: float = 0.2,
    seed: int = 42,
    draw: Column | None = None,
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``is_test``: the same share of every class, to the row."""
    draw = hash_of(ids, seed) if draw is None else draw
    ranked = stratified_rank(df, stratum, draw, ids, rows)
    return ranked.withColumn("is_test", F.col("_rank") <= F.floor(F.col("_size") * F.lit(test) + F.lit(0.5))).drop("_rank", "_size")


def random_split(df: DataFrame, ids: Sequence[str], test: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``is_test`` by an independent draw per row; no shuffle."""
    return df.withColumn("is_test", hash_of(ids, seed) < F.lit(int(test * HASH_RANGE)))


def stratified_folds(
    df: DataFrame,
    stratum: str,
    ids: Sequence[str],
    folds: int = 5,
    seed: int = 42,
    draw: Column | None = None,
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``fold``; every class is dealt out evenly."""
    draw = hash_of(ids, seed) if draw is None else draw
    ranked = stratified_rank(df, stratum, draw, ids, rows)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank", "_size")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and inverse-frequency weight (largest count / count) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))  # one row per class from here on
    return counts.withColumn("weight", F.max("n").over(Window.partitionBy()) / F.col("n"))
