"""Validation of fitted models: predictions are stored once, every table of the report is an aggregate of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.events import detection_total, validate_events
from ..operators.models import apply_forecast, class_probabilities, cross_validate, feature_importance, fit_classifier, input_features, load_model
from ..session import stage_table
from ..sources.files import read_table, write_table
from .stages import classifier_parts, forecast_parts

IMPORTANCE_SCHEMA = "feature string, importance double"


def class_predictions(parts: DataFrame, model, ids: Sequence[str] = ("city", "datetime"), label: str = "event_code") -> DataFrame:
    """(ids, part, label, pred, prob) of training and test rows; ``parts`` carries ``is_test``."""
    part = F.when(F.col("is_test"), "test").otherwise("train").alias("part")
    return class_probabilities(parts, model).select(*ids, part, F.col(label).alias("label"), F.col("model_code").alias("pred"), "prob")


def forecast_predictions(parts: DataFrame, model, ids: Sequence[str] = ("city", "datetime")) -> DataFrame:
    """(ids, target_24h, prediction) of the held-out rows."""
    return apply_forecast(parts.filter("is_test"), model, name="prediction").select(*ids, "target_24h", "prediction")


def train_test(predicted: DataFrame) -> DataFrame:
    """Per metric: value on the training and the test part, their gap and what it says."""
    long = metrics.classification_metrics(predicted, ["part"]).unpivot(["part"], ["accuracy", "f1_macro", "f1_weighted"], "metric", "v")
    side = {p: F.max(F.when(F.col("part") == p, F.col("v"))).alias(p) for p in ("train", "test")}
    gap = F.col("train") - F.col("test")
    return long.groupBy("metric").agg(*side.values()).withColumns({"gap": gap, "verdict": metrics.overfit_verdict(gap, True)})


def validation_tables(predicted: DataFrame, forecast: DataFrame) -> dict[str, DataFrame]:
    """The report's tables from stored predictions: train against test, and of the test part report, confusion and areas; forecast errors."""
    test = predicted.filter(F.col("part") == "test")
    return {
        "train_test": train_test(predicted),
        "report": metrics.classification_report(test),
        "confusion": metrics.confusion_matrix(test),
        "auc": metrics.roc_auc_ovr(test),
        "forecast": metrics.regression_metrics(forecast),
    }


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, value): the figures one looks at first. Of ``folds`` and ``events``, which may be missing, only what is there."""

    def long(name: str, wanted: dict[str, object]) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("metric"), F.expr(e).cast("double").alias("value")) for n, e in wanted.items()]
        return tables[name].select(F.inline(F.array(*pairs)))

    accuracy = tables["train_test"].filter("metric = 'accuracy'")
    rows = [accuracy.select(F.inline(F.array(*[F.struct(F.lit(f"{n}_accuracy" if n != "gap" else "overfit_gap").alias("metric"), F.col(n).alias("value")) for n in ("train", "test", "gap")])))]
    rows.append(metrics.macro_auc(tables["auc"]).select(F.lit("macro_auc").alias("metric"), F.col("macro_auc").alias("value")))
    rows.append(long("forecast", {"forecast_mae": "mae", "forecast_r2": "r2"}))
    if "folds" in tables:
        cv = tables["folds"].filter("metric IN ('accuracy', 'f1_macro')")
        rows += [cv.select(F.concat(F.lit("cv_"), "metric", F.lit(end)).alias("metric"), F.col(c).alias("value")) for c, end in (("test", ""), ("std", "_std"))]
    if "events" in tables:
        total = detection_total(tables["events"])
        rows += [total.select(F.lit(f"events_{n}").alias("metric"), F.col(c).cast("double").alias("value")) for n, c in (("detected", "detected"), ("known", "events"))]
    return reduce(DataFrame.unionByName, rows)


def run_validation(
    spark: SparkSession,
    features_path: str,
    results_path: str | None,
    model_path: str,
    events: DataFrame,
    out_path: str,
    keys: Sequence[str] = ("city",),
    folds: int = 5,
    fit: Callable | None = None,
) -> dict[str, DataFrame]:
    """Validate the stored models and write one folder per table; gives the tables as stored.

    Splits are hashes of a row's identity, so the test rows are those that the stored models did not see. ``fit`` makes the models of
    the folds; by default it boosts as the stored classifier was made. Without results the check of known events is left out.
    """
    ids = [*keys, "datetime"]
    features = read_table(spark, features_path)
    classifier, forecast = load_model(f"{model_path}/classifier"), load_model(f"{model_path}/forecast")

    def put(name: str, df: DataFrame) -> DataFrame:
        write_table(df, f"{out_path}/{name}", ())
        return read_table(spark, f"{out_path}/{name}")

    parts = stage_table(classifier_parts(features, keys), "parts")
    predicted = put("predictions", class_predictions(parts, classifier, ids))
    ahead = put("forecast_predictions", forecast_predictions(forecast_parts(features, keys), forecast, ids))
    tables = {name: put(name, df) for name, df in validation_tables(predicted, ahead).items()}
    again = fit or (lambda df, names: fit_classifier(df, names, algo="gbt"))
    tables["folds"] = put("folds", cross_validate(parts.drop("is_test"), input_features(classifier), ids, folds=folds, fit=again))
    tables["importance"] = put("importance", spark.createDataFrame(feature_importance(classifier), IMPORTANCE_SCHEMA))
    if results_path is not None:
        tables["events"] = put("events", validate_events(read_table(spark, results_path), events))
    return {**tables, "predictions": predicted, "forecast_predictions": ahead, "summary": put("summary", summary(tables))}
