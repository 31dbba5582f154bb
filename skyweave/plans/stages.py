"""The two batch stages: raw hourly table -> features -> results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import clean_doubles, clip, ensure_columns
from ..operators.decompose import RESIDUAL_COLUMNS, attach_residuals, classical_daily, confirm_events, daily_means, spike_flags, stl_daily
from ..operators.events import label_events
from ..operators.features import GASES, POLLUTANTS, WEATHER, aqi_with_fallback, lags_and_rolls, pointwise_features
from ..operators.fill import fill_gaps
from ..operators.forest import anomaly_scores
from ..operators.models import (
    CLASSIFIER_FEATURES,
    FORECAST_FEATURES,
    apply_classifier,
    apply_forecast,
    fit_classifier,
    fit_forecast,
    forecast_rows,
    save_model,
)
from ..operators.order_stats import clip_tail, tail_limits
from ..operators.sampling import random_split, stratified_split, training_sample
from ..operators.series import CHUNK_ROWS, drop_position, with_position
from ..operators.smooth import savgol
from ..session import lazy, stage_table
from ..sources.files import read_table, write_table


def pm_proxies(df: DataFrame) -> DataFrame:
    """Clip AOD to 0..5 and estimate particulates from it; without AOD they are null."""
    if "AOD" not in df.columns:
        return ensure_columns(df.drop("PM2_5", "PM10"), ["PM2_5", "PM10"])
    depth = clip("AOD", 0, 5)
    return df.withColumns({"AOD": depth, "PM2_5": clip(depth * 120, 0, 1500), "PM10": clip(depth * 195, 0, 3000)})


def build_features(
    raw: DataFrame,
    events: DataFrame,
    keys: Sequence[str] = ("city",),
    chunk_rows: int = CHUNK_ROWS,
    staged: bool = True,
    limits: dict[str, float | None] | None = None,
) -> DataFrame:
    """Clean, fill, smooth, derive and label an hourly table.

    ``staged`` writes the positioned and the interpolated rows to the shared folder, since
    later steps read them more than once. ``limits`` are the gases' clip limits, measured
    on ``raw`` when not given.
    """
    keys = list(keys)
    stage = stage_table if staged else lazy
    raw = ensure_columns(clean_doubles(raw), [*GASES, *WEATHER, "AOD", "fire_count"])
    limits = tail_limits(raw, GASES) if limits is None else limits
    clean = stage(with_position(clip_tail(pm_proxies(raw), limits), keys, stage=stage), "positioned")
    filled = fill_gaps(clean, [*POLLUTANTS, *WEATHER], keys, chunk_rows=chunk_rows, stage=stage, keep_position=True)
    smooth = stage(savgol(filled, POLLUTANTS, keys, prefilled=True, chunk_rows=chunk_rows, keep_position=True), "smoothed")
    derived = pointwise_features(aqi_with_fallback(smooth))
    wide = lags_and_rolls(derived, keys=keys, chunk_rows=chunk_rows, keep_position=True)
    return drop_position(label_events(wide, events, keys[0], stage=stage))


def detect(
    features: DataFrame,
    keys: Sequence[str] = ("city",),
    method: str = "stl",
    trees: int = 300,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add anomaly score, residuals, spikes and confirmed events."""
    keys = list(keys)
    features = stage_table(with_position(features, keys, stage=stage_table), "features")
    scored = anomaly_scores(features, keys=keys, ids=[*keys, "datetime"], trees=trees)
    daily = stage_table(daily_means(features, RESIDUAL_COLUMNS, keys, stage=stage_table, keep_position=True), "daily")
    residuals = stage_table((stl_daily if method == "stl" else classical_daily)(daily, RESIDUAL_COLUMNS, keys), "residuals")
    joined = attach_residuals(scored, residuals, RESIDUAL_COLUMNS, keys)
    return confirm_events(spike_flags(joined, RESIDUAL_COLUMNS, keys=keys, chunk_rows=chunk_rows))


def classifier_parts(features: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    """The classifier's rows with ``is_test``, a fifth of every class."""
    ids = [*keys, "datetime"]
    return stratified_split(training_sample(features, ids), "event_code", ids)


def forecast_parts(features: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    """The forecast's rows with ``is_test``, about 15 in a hundred."""
    return random_split(forecast_rows(features, FORECAST_FEATURES, keys=keys), [*keys, "datetime"])


def train(
    features: DataFrame, keys: Sequence[str] = ("city",), algo: str = "gbt", classifier_trees: int = 500, forecast_trees: int = 500
):
    """Fit both models on their training parts: (classifier, forecast, parts of each with ``is_test``)."""
    sample, rows = classifier_parts(features, keys), forecast_parts(features, keys)
    classifier = fit_classifier(sample.filter(~F.col("is_test")), CLASSIFIER_FEATURES, algo=algo, trees=classifier_trees)
    forecast = fit_forecast(rows.filter(~F.col("is_test")), FORECAST_FEATURES, trees=forecast_trees)
    return classifier, forecast, sample, rows


def run_features(spark: SparkSession, raw_path: str, events: DataFrame, out_path: str, keys: Sequence[str] = ("city",)) -> None:
    write_table(build_features(read_table(spark, raw_path), events, keys), out_path, keys[:1])


def run_model(spark: SparkSession, features_path: str, out_path: str, model_path: str, keys: Sequence[str] = ("city",), **options) -> None:
    """Score, train, apply and write results and both models."""
    features = read_table(spark, features_path)
    found = stage_table(detect(features, keys), "detected")
    classifier, forecast, _, _ = train(features, keys, **options)
    save_model(classifier, f"{model_path}/classifier")
    save_model(forecast, f"{model_path}/forecast")
    write_table(apply_forecast(apply_classifier(found, classifier), forecast), out_path, keys[:1])
