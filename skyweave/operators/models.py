"""Event classifier and forecast on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import clip
from ..functions.labels import CLASSES, label_of
from ..session import Stage, stage_table
from .boosting import Boosted, boosted_scores, fit_boosted
from .features import lead_target
from .forest import ANOMALY_FEATURES
from .metrics import classification_metrics, fold_summary
from .sampling import stratified_folds

# Model inputs.
CLASSIFIER_FEATURES = ANOMALY_FEATURES + [
    "PM2_5_lag1", "PM2_5_lag6", "PM2_5_lag24",
    "NO2_lag1", "NO2_lag6", "NO2_lag24",
    "SO2_lag1", "SO2_lag6", "CO_lag1", "CO_lag6", "AOD_lag1", "AOD_lag24",
    "AQI_roll6_mean", "AQI_roll24_mean",
    "temp_c", "humidity", "wind_speed", "wind_u", "wind_v", "precip", "pressure", "is_weekend",
]
FORECAST_FEATURES = [
    "PM2_5_lag1", "PM2_5_lag6", "PM2_5_lag24",
    "PM2_5_roll6_mean", "PM2_5_roll24_mean", "PM2_5_roll6_std",
    "AOD_lag1", "AOD_lag24", "NO2_lag1", "SO2_lag1", "CO_lag1", "fire_count",
    "temp_c", "humidity", "wind_speed", "wind_u", "wind_v", "precip", "pressure", "cloud_pct",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "is_weekend",
]


def available(df: DataFrame, feats: Sequence[str]) -> list[str]:
    return [f for f in feats if f in df.columns]


def zero_filled(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Model input: every feature as a double, missing as 0, beside the original columns."""
    return df.withColumns({f"_x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats})


def _drop_inputs(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_x_")], "_features")


def with_class_weights(df: DataFrame, label: str = "event_code") -> DataFrame:
    """Add ``_weight`` = largest class count / count of the row's class."""
    counts = {row[0]: row[1] for row in df.groupBy(label).count().collect()}  # one row per class
    most = max(counts.values(), default=1)
    weight = F.lit(1.0)
    for code, n in sorted(counts.items()):
        weight = F.when(F.col(label) == code, F.lit(most / n)).otherwise(weight)
    return df.withColumn("_weight", weight)


def fit_classifier(
    df: DataFrame,
    feats: Sequence[str] = tuple(CLASSIFIER_FEATURES),
    label: str = "event_code",
    algo: str = "rf",
    trees: int | None = None,
    depth: int = 6,
    rate: float = 0.04,
    subsample: float = 0.8,
    columns: float = 0.75,
    seed: int = 42,
) -> PipelineModel | Boosted:
    """A fitted model that gives one probability per class; classes weigh inversely to their counts.

    ``rf`` is a forest (100 trees), ``gbt`` one boosting over all classes by softmax (500 rounds), each tree on a
    share ``columns`` of the features.
    """
    feats = available(df, feats)
    if algo == "gbt":
        return fit_boosted(with_class_weights(df, label), feats, label, len(CLASSES), "_weight", rounds=trees or 500, depth=depth, rate=rate, subsample=subsample, columns=columns, seed=seed)
    if algo != "rf":
        raise ValueError("algo is 'rf' or 'gbt'")
    assemble = VectorAssembler(inputCols=[f"_x_{f}" for f in feats], outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=trees or 100, maxDepth=depth,
        subsamplingRate=subsample, seed=seed, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
    )
    return Pipeline(stages=[assemble, forest]).fit(with_class_weights(zero_filled(df, feats), label))


def input_features(model: PipelineModel | Boosted) -> list[str]:
    """The feature names a fitted (or loaded) model reads."""
    if isinstance(model, Boosted):
        return list(model.feats)
    return [c.removeprefix("_x_") for c in model.stages[0].getInputCols()]


def class_probabilities(df: DataFrame, model: PipelineModel | Boosted) -> DataFrame:
    """Add ``prob`` (array in class order) and ``model_code`` (its largest, first on a tie)."""
    if isinstance(model, Boosted):
        out = boosted_scores(df, model)
    else:
        known = vector_to_array("_prob")
        prob = F.array(*[F.coalesce(F.get(known, F.lit(i)), F.lit(0.0)) for i in range(len(CLASSES))])
        out = _drop_inputs(model.transform(zero_filled(df, input_features(model))).withColumn("prob", prob)).drop("_prob", "_raw", "_pred")
    return out.withColumn("model_code", (F.array_position("prob", F.array_max("prob")) - 1).cast("int"))


def event_override(code: Column, confirmed: Column) -> Column:
    """Rows without a confirmed event are Normal whatever the model says."""
    return F.when(F.coalesce(confirmed, F.lit(False)), code).otherwise(F.lit(0))


def apply_classifier(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add pred_code, pred_label and prob_<class>; unconfirmed rows are set to Normal."""
    out = class_probabilities(df, model).withColumn("pred_code", event_override(F.col("model_code"), F.col("confirmed_event")))
    out = out.withColumns({"pred_label": label_of("pred_code"), **{f"prob_{n}": F.get("prob", F.lit(i)) for i, n in enumerate(CLASSES)}})
    return out.drop("prob", "model_code")


def forecast_rows(df: DataFrame, feats: Sequence[str] = tuple(FORECAST_FEATURES), horizon: int = 24, **where) -> DataFrame:
    """Training rows of the forecast: target known, every feature known."""
    feats = available(df, feats)
    return lead_target(df, "PM2_5", horizon, **where).na.drop(subset=["target_24h", *feats])


def fit_forecast(
    train: DataFrame,
    feats: Sequence[str] = tuple(FORECAST_FEATURES),
    trees: int = 500,
    depth: int = 5,
    rate: float = 0.04,
    subsample: float = 0.8,
    columns: float = 0.75,
    seed: int = 42,
) -> Boosted:
    """Boosted regression of the value a day ahead."""
    return fit_boosted(train, available(train, feats), "target_24h", rounds=trees, depth=depth, rate=rate, subsample=subsample, columns=columns, seed=seed)


def apply_forecast(df: DataFrame, model: Boosted, lo: float = 0.0, hi: float = 1500.0, name: str = "forecast_pm25_24h") -> DataFrame:
    """Add the forecast, clipped to a plausible range."""
    out = boosted_scores(df, model, "_forecast").withColumn("_forecast", F.col("_forecast")[0])
    return out.withColumn(name, clip("_forecast", lo, hi)).drop("_forecast")


def feature_importance(model: PipelineModel | Boosted, k: int | None = 20) -> list[tuple[str, float]]:
    """(feature, importance), largest first: mean gain of a boosting's splits, impurity in a forest."""
    values = model.importance() if isinstance(model, Boosted) else [float(v) for v in model.stages[1].featureImportances.toArray()]
    ranked = sorted(zip(input_features(model), values), key=lambda p: (-p[1], p[0]))
    return ranked if k is None else ranked[:k]


def cross_validate(df: DataFrame, feats: Sequence[str] = tuple(CLASSIFIER_FEATURES), ids: Sequence[str] = ("city", "datetime"), label: str = "event_code", folds: int = 5, seed: int = 42, fit=fit_classifier, stage: Stage = stage_table) -> DataFrame:
    """Mean train and test metrics over stratified folds, with the test deviation.

    The dealt rows are stored, since every fold reads them.
    """
    dealt = stage(stratified_folds(df, label, ids, folds, seed), "folds")
    parts = None
    for fold in range(folds):
        model = fit(dealt.filter(F.col("fold") != fold), feats)
        scored = class_probabilities(dealt, model).select(
            F.lit(fold).alias("fold"),
            F.when(F.col("fold") == fold, "test").otherwise("train").alias("part"),
            F.col(label).alias("label"),
            F.col("model_code").alias("pred"),
        )
        measured = classification_metrics(scored, ("fold", "part"))
        parts = measured if parts is None else parts.unionByName(measured)
    return fold_summary(parts)


def save_model(model: PipelineModel | Boosted, path: str) -> None:
    if isinstance(model, Boosted):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | Boosted:
    try:
        return Boosted.load(SparkSession.active(), path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return PipelineModel.load(path)
