"""Registered queries: sampling, metrics, models and reading scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.aqi import aqi
from ..functions.labels import CLASSES, label_of
from ..operators import metrics, models, sampling
from ..operators.decompose import stl_daily
from ..operators.features import POLLUTANTS, WEATHER, lags_and_rolls, pointwise_features
from ..operators.fill import fill_gaps
from ..operators.forest import ANOMALY_FEATURES, anomaly_scores, score_forest
from ..operators.metrics import min_max_score
from ..session import shared_path, stage_table
from ..sources import views
from . import reports, stages, validation
from .oracle_views import BASE
from .queries_clean import _CODE, _CONTINUOUS, _READINGS, daily_series, staged_base
from .registry import query, sql

MIX = 1000003  # range of the arithmetic draw



def _shares(terms: list[str]) -> str:
    total = " + ".join(f"({t})" for t in terms)
    return "[" + ", ".join(f"({t}) / ({total})" for t in terms) + "]"


_PROB = _shares([f"(event_id * {7 + 4 * c} + user_id * 13) % 97 + CASE WHEN label = {c} THEN 40 ELSE 1 END" for c in range(5)])
PREDICTIONS = f"""
labelled AS (SELECT event_id, user_id, CASE WHEN user_id % 10 < 6 THEN 0 ELSE user_id % 10 - 5 END AS label FROM events),
predictions AS (
  SELECT event_id AS row_id, label, CASE WHEN event_id % 7 = 0 THEN (label + event_id % 5) % 5 ELSE label END AS pred,
         {_PROB} AS prob, (event_id * 7919 + 104729) % {MIX} AS draw, event_id % 5 AS fold
  FROM labelled)"""


def _predictions(spark, sf):
    return views.predictions(spark, sf).withColumn("draw", F.col("mix") % MIX)


# ------------------------------------------------------------------ sampling


@query("event_sample", "T-04", sql([PREDICTIONS, f"x AS (SELECT row_id, label FROM predictions WHERE label > 0 OR draw < {int(0.08 * MIX)})"], "row_id n:label", "x"))
def event_sample(spark, sf):
    return sampling.training_sample(_predictions(spark, sf), code="label", draw=F.col("draw"), draw_range=MIX).select("row_id", "label")


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw, row_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM predictions)"


@query("stratified_split", "T-05", sql([PREDICTIONS, _RANKED, "x AS (SELECT row_id, label, r <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM ranked)"], "row_id n:label is_test", "x"))
def stratified_split(spark, sf):
    return sampling.stratified_split(_predictions(spark, sf), "label", ["row_id"], draw=F.col("draw")).select("row_id", "label", "is_test")


@query("stratified_folds", "T-06", sql([PREDICTIONS, _RANKED, "x AS (SELECT row_id, label, (r - 1) % 5 AS fold FROM ranked)"], "row_id n:label n:fold", "x"))
def stratified_folds(spark, sf):
    rows = _predictions(spark, sf).drop("fold")
    return sampling.stratified_folds(rows, "label", ["row_id"], draw=F.col("draw")).select("row_id", "label", "fold")


@query("random_split_share", "T-05")
def random_split_share(spark, sf):
    rows = sampling.random_split(_predictions(spark, sf), ["row_id"], 0.15)
    return rows.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ metrics

_CELLS = """
cell AS (SELECT {by} label, pred, count(*) AS n FROM predictions GROUP BY ALL),
side AS (SELECT {by} label AS cls, n AS support, 0 AS predicted, CASE WHEN label = pred THEN n ELSE 0 END AS tp FROM cell
         UNION ALL SELECT {by} pred, 0, n, 0 FROM cell),
tot AS (SELECT {by} cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM side GROUP BY ALL),
pr AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS pre, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS rec FROM tot),
cls AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f FROM pr)"""
_SUMMARY = "CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(f) AS f1_macro, sum(f * support) / sum(support) AS f1_weighted"


@query("classification_metrics", "M-09", sql([PREDICTIONS, _CELLS.format(by=""), f"x AS (SELECT {_SUMMARY} FROM cls)"], "f:accuracy f:f1_macro f:f1_weighted", "x"))
def classification_metrics(spark, sf):
    return metrics.classification_metrics(_predictions(spark, sf))


_NAMES = "['Normal', 'Fire', 'Dust', 'Gas', 'Industrial']"


@query(
    "classification_report",
    "M-10",
    sql(
        [
            PREDICTIONS,
            _CELLS.format(by=""),
            f"x AS (SELECT {_NAMES}[cls + 1] AS name, pre AS precision, rec AS recall, f AS f1, support FROM cls "
            "UNION ALL SELECT 'accuracy', NULL, NULL, CAST(sum(tp) AS DOUBLE) / sum(support), sum(support) FROM cls "
            "UNION ALL SELECT 'macro avg', avg(pre), avg(rec), avg(f), sum(support) FROM cls "
            "UNION ALL SELECT 'weighted avg', sum(pre * support) / sum(support), sum(rec * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM cls)",
        ],
        "name f:precision f:recall f:f1 n:support",
        "x",
    ),
)
def classification_report(spark, sf):
    return metrics.classification_report(_predictions(spark, sf))


@query(
    "confusion_matrix",
    "M-11",
    sql(
        [
            PREDICTIONS,
            "x AS (SELECT label, " + ", ".join(f"count(*) FILTER (WHERE pred = {c}) AS pred_{c}" for c in range(5)) + ", CAST(count(*) FILTER (WHERE pred = label) AS DOUBLE) / greatest(count(*), 1) AS recall FROM predictions GROUP BY 1)",
        ],
        "n:label " + " ".join(f"n:pred_{c}" for c in range(5)) + " f:recall",
        "x",
    ),
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_predictions(spark, sf))


_AUC = (
    "long AS (SELECT c AS cls, prob[c + 1] AS score, CASE WHEN label = c THEN 1 ELSE 0 END AS pos FROM predictions, (SELECT unnest(range(5)) AS c)), "
    "rk AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2 AS r FROM long), "
    f"auc AS (SELECT cls, {_NAMES}[cls + 1] AS name, (sum(r) FILTER (WHERE pos = 1) - sum(pos) * (sum(pos) + 1) / 2) / (CAST(sum(pos) AS DOUBLE) * (count(*) - sum(pos))) AS auc FROM rk GROUP BY cls)"
)


@query("roc_auc", "M-12", sql([PREDICTIONS, _AUC], "n:cls name f:auc", "auc"))
def roc_auc(spark, sf):
    return metrics.roc_auc_ovr(_predictions(spark, sf))


@query("macro_auc", "M-12", sql([PREDICTIONS, _AUC, "x AS (SELECT avg(auc) AS macro_auc FROM auc)"], "f:macro_auc", "x"))
def macro_auc(spark, sf):
    return metrics.macro_auc(metrics.roc_auc_ovr(_predictions(spark, sf)))


@query(
    "fold_summary",
    "M-13 M-14",
    sql(
        [
            PREDICTIONS.replace("event_id % 5 AS fold", "event_id % 5 AS fold, CASE WHEN event_id % 10 < 5 THEN 'test' ELSE 'train' END AS part"),
            _CELLS.format(by="fold, part,"),
            f"per AS (SELECT fold, part, {_SUMMARY} FROM cls GROUP BY 1, 2)",
            "l AS (UNPIVOT per ON accuracy, f1_macro, f1_weighted INTO NAME metric VALUE v)",
            "x AS (SELECT metric, avg(v) FILTER (WHERE part = 'train') AS train, avg(v) FILTER (WHERE part = 'test') AS test, stddev_pop(v) FILTER (WHERE part = 'test') AS std FROM l GROUP BY 1)",
            "y AS (SELECT *, CASE WHEN train - test < 0.03 THEN 'none' WHEN train - test < 0.08 THEN 'mild' ELSE 'significant' END AS verdict, CASE WHEN train - test < 0.03 THEN 'none' ELSE 'some' END AS split_verdict FROM x)",
        ],
        "metric f:train f:test f:std verdict split_verdict",
        "y",
    ),
)
def fold_summary(spark, sf):
    part = F.when(F.col("row_id") % 10 < 5, "test").otherwise("train")
    per = metrics.classification_metrics(_predictions(spark, sf).withColumn("part", part), ("fold", "part"))
    gap = F.col("train") - F.col("test")
    return metrics.fold_summary(per).withColumns({"verdict": metrics.overfit_verdict(gap), "split_verdict": metrics.overfit_verdict(gap, True)})


@query(
    "forecast_error",
    "M-07",
    sql(
        [
            BASE,
            "p AS (SELECT PM2_5 AS prediction, lead(PM2_5, 24) OVER (PARTITION BY city ORDER BY datetime) AS target FROM base)",
            "q AS (SELECT * FROM p WHERE prediction IS NOT NULL AND target IS NOT NULL)",
            "x AS (SELECT avg(abs(target - prediction)) AS mae, 1 - sum((target - prediction) * (target - prediction)) / sum((target - m) * (target - m)) AS r2 FROM q, (SELECT avg(target) AS m FROM q))",
        ],
        "f:mae f:r2",
        "x",
    ),
)
def forecast_error(spark, sf):
    from ..operators.features import lead_target

    rows = lead_target(staged_base(spark, sf).select("city", "datetime", "PM2_5", "_pos", "_len"), chunk_rows=256).drop("_len")
    return metrics.regression_metrics(rows.na.drop(), value="PM2_5")


# ------------------------------------------------------------------ models


def model_features(spark, sf):
    """Features of the hourly city table without gaps, written once."""
    rows = fill_gaps(staged_base(spark, sf), [*POLLUTANTS, *WEATHER, "AOD"], stage=stage_table, keep_position=True)
    rows = pointwise_features(rows.withColumn("AQI", aqi("PM2_5", "PM10")))
    rows = rows.withColumn("event_code", sum((F.when(F.col("event_label") == n, i).otherwise(0) for i, n in enumerate(CLASSES)), F.lit(0)))
    return stage_table(lags_and_rolls(rows), "features")


@query("isolation_forest", "M-01 M-02")
def isolation_forest(spark, sf):
    rows = pointwise_features(staged_base(spark, sf).drop("anomaly_score"))
    rows = stage_table(lags_and_rolls(rows, [], [], ["PM2_5", "NO2", "SO2"], means=()), "points")
    return anomaly_scores(rows, ANOMALY_FEATURES).select("city", "datetime", "anomaly_score", "is_anomaly")


_FOREST_FEATURES = ["NO2", "SO2", "CO", "O3", "PM2_5", "PM10", "AOD", "fire_count"]


@query(
    "forest_scores",
    "M-01 M-02",
    sql(
        [
            BASE,
            f"v AS (SELECT city, datetime, [{', '.join(f'coalesce({f}, 0)' for f in _FOREST_FEATURES)}] AS x FROM base)",
            "d AS (SELECT city, datetime, avg(CASE WHEN x[t % 8 + 1] <= t % 50 * 2.5::DOUBLE THEN 1 + t % 3 WHEN x[(t + 3) % 8 + 1] <= t % 7 * 1.5::DOUBLE THEN 2 + t % 2 ELSE 3.5::DOUBLE END) AS depth "
            "FROM v, (SELECT unnest(range(300)) AS t) GROUP BY 1, 2)",
            "r AS (SELECT city, datetime, 0.5::DOUBLE - pow(2.0::DOUBLE, -depth / (2 * (ln(255.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * 255.0::DOUBLE / 256)) AS raw FROM d)",
            "x AS (SELECT *, 1 - (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w + 1e-9::DOUBLE) AS anomaly_score FROM r WINDOW w AS (PARTITION BY city))",
        ],
        "city t:datetime f:raw f:anomaly_score",
        "x",
    ),
)
def forest_scores(spark, sf):
    """All rows through 300 trees of three levels whose nodes follow a rule, so that SQL can say the depth."""
    rows = staged_base(spark, sf).select("city", "datetime", *_FOREST_FEATURES)
    t = F.col("tree")
    numbers = {"feature": [t % 8, -1, (t + 3) % 8, -1, -1], "left": [1, 1, 3, 3, 4], "right": [2, 1, 4, 3, 4]}
    decimals = {"threshold": [t % 50 * 2.5, 0, t % 7 * 1.5, 0, 0], "depth": [0, 1 + t % 3, 0, 2 + t % 2, 3.5]}
    nodes = [F.array(*[(F.lit(v) if not isinstance(v, Column) else v).cast(kind) for v in vs]).alias(n) for kind, group in (("int", numbers), ("double", decimals)) for n, vs in group.items()]
    trees = rows.select("city").distinct().withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(299))))
    trees = stage_table(trees.select("city", "tree", F.lit(256).alias("rows"), *nodes), "trees")
    scored = stage_table(score_forest(rows, trees, _FOREST_FEATURES), "scored")
    return min_max_score(scored, "raw", name="anomaly_score", stage=stage_table).select("city", "datetime", "raw", "anomaly_score")


@query("stl_residual", "M-03")
def stl_residual(spark, sf):
    return stl_daily(daily_series(spark, sf), ["PM2_5", "PM10", "NO2"])


@query("event_classifier", "M-05 M-06 T-04 T-05")
def event_classifier(spark, sf):
    feats = model_features(spark, sf)
    sample = sampling.stratified_split(sampling.training_sample(feats), "event_code", ["city", "datetime"])
    model = models.fit_classifier(sample.filter("NOT is_test"), trees=30)
    applied = models.apply_classifier(feats.withColumn("confirmed_event", F.col("anomaly_score") > 0.6), model)
    return applied.select("city", "datetime", "event_label", "pred_code", "pred_label", *[f"prob_{n}" for n in CLASSES])


@query(
    "label_override",
    "M-06",
    sql(
        [
            BASE,
            f"x AS (SELECT city, datetime, CASE WHEN anomaly_score > 0.6 THEN {_CODE.format('event_label')} ELSE 0 END AS pred_code FROM base)",
            f"y AS (SELECT *, {_NAMES}[pred_code + 1] AS pred_label FROM x)",
        ],
        "city t:datetime n:pred_code pred_label",
        "y",
    ),
)
def label_override(spark, sf):
    from ..functions.labels import code_of

    from .queries_clean import base

    code = models.event_override(code_of("event_label"), F.col("anomaly_score") > 0.6)
    return base(spark, sf).select("city", "datetime", code.alias("pred_code")).withColumn("pred_label", label_of("pred_code"))


@query("boosted_classifier", "M-05 M-09")
def boosted_classifier(spark, sf):
    feats = model_features(spark, sf)
    model = models.fit_classifier(feats, algo="gbt", trees=5)
    pred = models.class_probabilities(feats, model).select(F.col("event_code").alias("label"), F.col("model_code").alias("pred"))
    return metrics.classification_metrics(pred)


@query("pm25_forecast", "M-07 M-08 T-05")
def pm25_forecast(spark, sf):
    feats = model_features(spark, sf)
    rows = sampling.random_split(models.forecast_rows(feats), ["city", "datetime"])
    model = models.fit_forecast(rows.filter("NOT is_test"), trees=5)
    return models.apply_forecast(feats, model).select("city", "datetime", "PM2_5", "forecast_pm25_24h")


@query("cross_validation", "M-13 T-06")
def cross_validation(spark, sf):
    feats = stage_table(sampling.training_sample(model_features(spark, sf), normal_fraction=0.5), "sample")

    def fit(df, names):
        return models.fit_classifier(df, names, trees=5, depth=4)

    return models.cross_validate(feats, ANOMALY_FEATURES, fit=fit)


@query("model_validation", "M-05 M-07 M-08 M-09 M-12 M-14")
def model_validation(spark, sf):
    """Both models fitted on their training parts and the figures of the held-out rows."""
    feats = model_features(spark, sf)
    classes, ahead = stage_table(stages.classifier_parts(feats), "parts"), stage_table(stages.forecast_parts(feats), "parts")
    classifier = models.fit_classifier(classes.filter("NOT is_test"), trees=20)
    forecast = models.fit_forecast(ahead.filter("NOT is_test"), trees=5)
    predicted = stage_table(validation.class_predictions(classes, classifier), "predicted")
    return validation.summary(validation.validation_tables(predicted, validation.forecast_predictions(ahead, forecast)))


@query("feature_importance", "M-15 T-02")
def feature_importance(spark, sf):
    model = models.fit_classifier(model_features(spark, sf), trees=20)
    ranked = models.feature_importance(model, None)
    return reports.top_k(spark.createDataFrame(ranked, "feature string, importance double"), "importance", 20, ["feature"])


@query("model_round_trip", "S-21")
def model_round_trip(spark, sf):
    feats = model_features(spark, sf)
    path = shared_path(spark, "model")
    models.save_model(models.fit_classifier(feats, ANOMALY_FEATURES, trees=5), path)
    applied = models.class_probabilities(feats, models.load_model(path))
    return applied.groupBy("event_code", "model_code").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ reading scores

# Names, thresholds and sentences of the rules in the SQL below.
_SYNTH_NAMES = [
    "ratio_pm25_pm10", "ratio_co_no2", "ratio_so2_no2", "co_x_no2", "so2_x_no2", "aod_x_wind", "fire_x_no2",
    "PM2_5_roll6_std", "NO2_roll6_std", "SO2_roll6_std", "hour_sin", "hour_cos", "month_sin", "month_cos",
    "PM2_5_lag1", "PM2_5_lag24", "NO2_lag6", "SO2_lag6", "CO_lag1", "AOD_lag24", "AQI_roll6_mean", "AQI_roll24_mean",
    "wind_u", "wind_v", "temp_c", "humidity", "precip", "pressure",
]

# Names, thresholds and sentences of the rules in the SQL below.
_BACK = """
back AS (
  SELECT *, least(NO2 * 0.15::DOUBLE, 50) AS bg_NO2, least(SO2 * 0.05::DOUBLE, 20) AS bg_SO2, least(CO * 0.12::DOUBLE, 1.2::DOUBLE) AS bg_CO,
         least(PM2_5 * 0.18::DOUBLE, 70) AS bg_PM2_5, least(PM10 * 0.12::DOUBLE, 100) AS bg_PM10, least(AOD * 0.2::DOUBLE, 0.4::DOUBLE) AS bg_AOD
  FROM readings)"""


@query("background_levels", "R-01", sql([_READINGS, _BACK], "reading_id f:bg_NO2 f:bg_SO2 f:bg_CO f:bg_PM2_5 f:bg_PM10 f:bg_AOD", "back"))
def background_levels(spark, sf):
    return views.readings(spark, sf).select("reading_id", *[scoring.background(n).alias(f"bg_{n}") for n in scoring.BACKGROUND])


# Names, thresholds and sentences of the rules in the SQL below.
_SYNTH = """
synth AS (
  SELECT reading_id, PM2_5 / (PM10 + 1e-6::DOUBLE) AS ratio_pm25_pm10, CO / (NO2 + 1e-6::DOUBLE) AS ratio_co_no2, SO2 / (NO2 + 1e-6::DOUBLE) AS ratio_so2_no2,
         CO * NO2 AS co_x_no2, SO2 * NO2 AS so2_x_no2, AOD * wind_speed AS aod_x_wind, fire_count * NO2 AS fire_x_no2,
         CASE WHEN is_spike THEN (PM2_5 - bg_PM2_5) * 0.4::DOUBLE ELSE 0 END AS PM2_5_roll6_std, CASE WHEN is_spike THEN (NO2 - bg_NO2) * 0.4::DOUBLE ELSE 0 END AS NO2_roll6_std,
         CASE WHEN is_spike THEN (SO2 - bg_SO2) * 0.4::DOUBLE ELSE 0 END AS SO2_roll6_std,
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
         CASE WHEN is_spike THEN bg_PM2_5 ELSE PM2_5 END AS PM2_5_lag1, CASE WHEN is_spike THEN bg_PM2_5 ELSE PM2_5 END AS PM2_5_lag24,
         CASE WHEN is_spike THEN bg_NO2 ELSE NO2 END AS NO2_lag6, CASE WHEN is_spike THEN bg_SO2 ELSE SO2 END AS SO2_lag6,
         CASE WHEN is_spike THEN bg_CO ELSE CO END AS CO_lag1, CASE WHEN is_spike THEN bg_AOD ELSE AOD END AS AOD_lag24,
         CASE WHEN is_spike THEN (PM2_5 + bg_PM2_5) / 2 ELSE PM2_5 END * 1.5::DOUBLE AS AQI_roll6_mean, CASE WHEN is_spike THEN (PM2_5 + bg_PM2_5) / 2 ELSE PM2_5 END * 1.2::DOUBLE AS AQI_roll24_mean,
         wind_speed * sin(radians(wind_dir)) AS wind_u, wind_speed * cos(radians(wind_dir)) AS wind_v, 30.0 AS temp_c, 60.0 AS humidity, 0.0 AS precip, 1013.0 AS pressure
  FROM back)"""


@query("synthetic_features", "R-02", sql([_READINGS, _BACK, _SYNTH], "reading_id " + " ".join(f"f:{n}" for n in _SYNTH_NAMES), "synth"))
def synthetic_features(spark, sf):
    return scoring.synthesize_features(views.readings(spark, sf)).select("reading_id", *_SYNTH_NAMES)


# model output by integer arithmetic, so that the rules can be checked without a fit
_LEVELS = [f"(reading_id * {7 + 4 * c} + 31 * {c}) % 97 + 1" for c in range(5)]
MODELLED = f"""
leveled AS (SELECT *, [{', '.join(_LEVELS)}] AS lv, {_shares(_LEVELS)} AS prob FROM readings),
modelled AS (SELECT * EXCLUDE (lv), list_position(lv, list_max(lv)) - 1 AS model_code FROM leveled)"""
# Names, thresholds and sentences of the rules in the SQL below.
_RULED = """
ruled AS (
  SELECT *, CASE WHEN SO2 > 200 THEN CASE WHEN SO2 > 500 THEN 3 ELSE 4 END
                 WHEN PM10 > 400 AND PM2_5 / (PM10 + 1e-6::DOUBLE) < 0.25 AND CO < 2 THEN 2
                 WHEN PM2_5 > 200 AND CO > 3 THEN 1
                 WHEN PM2_5 > 300 OR (PM2_5 > 150 AND fire_count > 5) THEN 1
                 WHEN PM10 > 300 AND PM2_5 / (PM10 + 1e-6::DOUBLE) < 0.35 THEN 2
                 ELSE model_code END AS code FROM modelled)"""
# Names, thresholds and sentences of the rules in the SQL below.
_SCORED = f"""
conf AS (
  SELECT *, CASE WHEN code <> model_code THEN CASE
      WHEN code = 3 AND SO2 > 500 THEN least(95.0::DOUBLE, 60 + SO2 / 20)
      WHEN code = 2 AND PM10 > 400 THEN least(95.0::DOUBLE, 55 + PM10 / 30)
      WHEN code = 1 AND CO > 3 THEN least(95.0::DOUBLE, 55 + CO * 5)
      ELSE 70 END ELSE prob[model_code + 1] * 100 END AS c, {_CONTINUOUS} AS a FROM ruled),
named AS (SELECT *, {_NAMES}[code + 1] AS label FROM conf),
scored AS (
  SELECT reading_id, label, round_even(c, 1) AS confidence, round_even(a, 1) AS AQI,
         CASE WHEN label = 'Normal' THEN 'LOW' WHEN label = 'Gas' OR (label = 'Industrial' AND SO2 > 300) THEN 'HIGH'
              WHEN label IN ('Fire', 'Industrial') OR c > 80 THEN CASE WHEN label = 'Fire' AND PM2_5 < 300 THEN 'MEDIUM' ELSE 'HIGH' END
              ELSE 'MEDIUM' END AS danger,
         CASE label WHEN 'Fire' THEN printf('PM2.5=%.0f + CO=%.2f together signal active combustion. PM2.5/PM10 ratio=%.2f (high = fine particles from fire).', PM2_5, CO, PM2_5 / (PM10 + 1e-6::DOUBLE))
              WHEN 'Dust' THEN printf('PM10=%.0f dominates. PM2.5/PM10 ratio=%.2f (low = coarse mineral dust, not combustion). CO/NO2 are quiet.', PM10, PM2_5 / (PM10 + 1e-6::DOUBLE))
              WHEN 'Gas' THEN printf('SO2=%.0f µg/m³ is %.0f× the safe limit — sudden chemical/industrial release signature.', SO2, SO2 / 20)
              WHEN 'Industrial' THEN printf('SO2=%.0f + NO2=%.0f elevated together — characteristic of industrial stack emissions sustained over time.', SO2, NO2)
              ELSE printf('All pollutants within expected urban ranges. AQI≈%.0f.', a) END AS explanation
  FROM named)"""


def modelled(df):
    """Readings with arithmetic class probabilities in the place of a model's."""
    levels = [(F.col("reading_id") * (7 + 4 * c) + 31 * c) % 97 + 1 for c in range(5)]
    total = levels[0] + levels[1] + levels[2] + levels[3] + levels[4]
    array = F.array(*levels)
    return scoring.with_defaults(df).withColumns(
        {"prob": F.array(*[x / total for x in levels]), "model_code": (F.array_position(array, F.array_max(array)) - 1).cast("int")}
    )


@query("rule_classes", "R-03", sql([_READINGS, MODELLED, _RULED], "reading_id n:code", "ruled"))
def rule_classes(spark, sf):
    return modelled(views.readings(spark, sf)).select("reading_id", scoring.rule_code(F.col("model_code")).alias("code"))


SCORE_SQL = sql([_READINGS, MODELLED, _RULED, _SCORED], "reading_id label f:confidence f:AQI danger explanation", "scored")
SCORE_COLUMNS = ["reading_id", "label", "confidence", "AQI", "danger", "explanation"]


@query("reading_scores", "R-03 R-04 R-05 R-07 P-05", SCORE_SQL)
def reading_scores(spark, sf):
    return scoring.score_columns(modelled(views.readings(spark, sf))).select(*SCORE_COLUMNS)


_LIMIT_ROWS = " UNION ALL ".join(
    f"SELECT reading_id, {i} AS o, '{n}' AS pollutant, {n} AS value, {n} / {v}::DOUBLE AS times FROM readings WHERE {n} > {v}::DOUBLE * 2" for i, (n, v) in enumerate(scoring.SAFE_LIMITS.items())
)


@query(
    "above_limits",
    "R-06",
    sql([_READINGS, f"x AS (SELECT reading_id, pollutant, value, times, printf('%s=%.1f (%.1f× safe limit)', pollutant, value, times) AS text FROM ({_LIMIT_ROWS}))"], "reading_id pollutant f:value f:times text", "x"),
)
def above_limits(spark, sf):
    rows = views.readings(spark, sf).select("reading_id", scoring.above_limits().alias("l"))
    rows = rows.withColumn("s", scoring.above_safe_text(F.col("l")))
    pairs = F.arrays_zip(F.col("l"), F.col("s"))
    flat = rows.select("reading_id", F.explode(pairs).alias("z"))
    return flat.select("reading_id", "z.l.pollutant", "z.l.value", "z.l.times", F.col("z.s").alias("text"))


@query(
    "ranked_probabilities",
    "R-08 T-07",
    sql(
        [
            _READINGS,
            MODELLED,
            f"l AS (SELECT reading_id, {_NAMES}[i + 1] AS label, round_even(prob[i + 1] * 100, 1) AS pct FROM modelled, (SELECT unnest(range(5)) AS i))",
            "x AS (SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY pct DESC, label) - 1 AS place FROM l)",
        ],
        "reading_id n:place label f:pct",
        "x",
    ),
)
def ranked_probabilities(spark, sf):
    rows = modelled(views.readings(spark, sf)).select("reading_id", scoring.probability_map(F.col("prob")).alias("all_probs"))
    flat = rows.select("reading_id", F.posexplode(scoring.ranked_probabilities(F.col("all_probs"))).alias("place", "e"))
    return flat.select("reading_id", "place", "e.label", "e.pct")


@query("model_scores", "R-08 S-21")
def model_scores(spark, sf):
    feats = model_features(spark, sf)
    names = [f for f in models.CLASSIFIER_FEATURES if f in feats.columns]
    scored = scoring.score_readings(views.readings(spark, sf), models.fit_classifier(feats, names, trees=5, depth=4))
    return scored.select("reading_id", "label", "confidence", "danger", "AQI", F.size("above_safe").alias("over"))
