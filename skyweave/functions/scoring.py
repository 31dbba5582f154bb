"""Rules that score a reading: expressions over a batch or a stream of readings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aqi import aqi_pm25
from .cleaning import decimal_text
from .labels import CLASSES, label_of
from .weather import cycle, ratio

# Safe limit per pollutant.
SAFE_LIMITS = {"NO2": 40.0, "SO2": 20.0, "CO": 2.0, "O3": 100.0, "PM2_5": 60.0, "PM10": 100.0, "AOD": 0.3}
# Share of the reading and ceiling of the background level before an event.
BACKGROUND = {
    "NO2": (0.15, 50.0),
    "SO2": (0.05, 20.0),
    "CO": (0.12, 1.2),
    "PM2_5": (0.18, 70.0),
    "PM10": (0.12, 100.0),
    "AOD": (0.20, 0.4),
}
# What an optional input is when it is not given.
DEFAULTS = {
    "fire_count": 0.0,
    "temp_c": 30.0,
    "humidity": 60.0,
    "wind_speed": 3.0,
    "wind_dir": 180.0,
    "precip": 0.0,
    "pressure": 1013.0,
    "hour": 12,
    "month": 6,
    "is_weekend": 0,
    "is_spike": True,
}
# Explanation formats.
EXPLANATIONS = {
    "Fire": "PM2.5=%s + CO=%s together signal active combustion. PM2.5/PM10 ratio=%s (high = fine particles from fire).",
    "Dust": "PM10=%s dominates. PM2.5/PM10 ratio=%s (low = coarse mineral dust, not combustion). CO/NO2 are quiet.",
    "Gas": "SO2=%s µg/m³ is %s× the safe limit — sudden chemical/industrial release signature.",
    "Industrial": "SO2=%s + NO2=%s elevated together — characteristic of industrial stack emissions sustained over time.",
    "Normal": "All pollutants within expected urban ranges. AQI≈%s.",
}
LIMIT_FORMAT = "%s=%s (%s× safe limit)"
CONFIDENCE_CAP = 95.0

NORMAL, FIRE, DUST, GAS, INDUSTRIAL = range(len(CLASSES))


def with_defaults(df: DataFrame) -> DataFrame:
    """Optional inputs that are absent or null take their defaults."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v) for n, v in DEFAULTS.items()})


def background(name: str) -> Column:
    """Level assumed before a sudden event: a share of the reading, up to a ceiling."""
    share, ceiling = BACKGROUND[name]
    # least() skips nulls: a missing reading has no background
    return F.when(F.col(name).isNotNull(), F.least(F.col(name) * F.lit(share), F.lit(ceiling)))


def synthetic_columns() -> dict[str, Column]:
    """Model features of a reading without a history.

    A spike is taken to start from the background, a steady reading to have been there all
    along, so lags, deviations and means follow from one number per pollutant.
    """
    spike = F.col("is_spike")
    past = {n: F.when(spike, background(n)).otherwise(F.col(n)) for n in BACKGROUND}
    mean = (F.col("PM2_5") + past["PM2_5"]) / 2
    out = {
        "ratio_pm25_pm10": ratio("PM2_5", "PM10"),
        "ratio_co_no2": ratio("CO", "NO2"),
        "ratio_so2_no2": ratio("SO2", "NO2"),
        "co_x_no2": F.col("CO") * F.col("NO2"),
        "so2_x_no2": F.col("SO2") * F.col("NO2"),
        "aod_x_wind": F.col("AOD") * F.col("wind_speed"),
        "fire_x_no2": F.col("fire_count") * F.col("NO2"),
    }
    for n in ("PM2_5", "NO2", "SO2"):
        out[f"{n}_roll6_std"] = (F.col(n) - past[n]) * 0.4
    out["hour_sin"], out["hour_cos"] = cycle(F.col("hour"), 24)
    out["month_sin"], out["month_cos"] = cycle(F.col("month"), 12)
    for n, lags in (("PM2_5", (1, 6, 24)), ("NO2", (1, 6, 24)), ("SO2", (1, 6)), ("CO", (1, 6)), ("AOD", (1, 24))):
        out.update({f"{n}_lag{k}": past[n] for k in lags})
    out["AQI_roll6_mean"], out["AQI_roll24_mean"] = mean * 1.5, mean * 1.2
    theta = F.radians("wind_dir")
    out["wind_u"], out["wind_v"] = F.col("wind_speed") * F.sin(theta), F.col("wind_speed") * F.cos(theta)
    return out


def synthesize_features(readings: DataFrame) -> DataFrame:
    return with_defaults(readings).withColumns(synthetic_columns())


def rule_code(model_code: Column) -> Column:
    """Class by fixed chemical rules, the first that holds; otherwise the model's class."""
    pm25, pm10, so2, co, fires = (F.col(n) for n in ("PM2_5", "PM10", "SO2", "CO", "fire_count"))
    share = ratio(pm25, pm10)
    return (
        F.when(so2 > 500, GAS)
        .when(so2 > 200, INDUSTRIAL)
        .when((pm10 > 400) & (share < 0.25) & (co < 2.0), DUST)
        .when((pm25 > 200) & (co > 3.0), FIRE)
        .when((pm25 > 300) | ((pm25 > 150) & (fires > 5)), FIRE)
        .when((pm10 > 300) & (share < 0.35), DUST)
        .otherwise(model_code)
    )


def confidence(code: Column, model_code: Column, prob: Column) -> Column:
    """Percent: the model's own where rules agree, else by how extreme the reading is."""

    def strength(base: float, extra: Column) -> Column:
        return F.least(F.lit(CONFIDENCE_CAP), F.lit(base) + extra)

    by_rule = (
        F.when((code == GAS) & (F.col("SO2") > 500), strength(60.0, F.col("SO2") / 20))
        .when((code == DUST) & (F.col("PM10") > 400), strength(55.0, F.col("PM10") / 30))
        .when((code == FIRE) & (F.col("CO") > 3), strength(55.0, F.col("CO") * 5))
        .otherwise(F.lit(70.0))
    )
    return F.when(code != model_code, by_rule).otherwise(F.get(prob, model_code) * 100)


def danger(code: Column, percent: Column) -> Column:
    """LOW, MEDIUM or HIGH from class, readings and the unrounded confidence."""
    return (
        F.when(code == NORMAL, "LOW")
        .when(code.isin(GAS, INDUSTRIAL), "HIGH")
        .when((code == FIRE) & (F.col("PM2_5") < 300), "MEDIUM")
        .when((code == FIRE) | (percent > 80), "HIGH")
        .otherwise("MEDIUM")
    )


def above_limits() -> Column:
    """Array of struct(pollutant, value, times): readings above twice their safe limit."""
    every = F.array(
        *[
            F.struct(F.lit(n).alias("pollutant"), F.col(n).cast("double").alias("value"), (F.col(n) / F.lit(limit)).alias("times"))
            for n, limit in SAFE_LIMITS.items()
        ]
    )
    # a limit is tested as value > 2 * limit: value / limit > 2 can round differently
    over = F.create_map(*chain.from_iterable((F.lit(n), F.lit(2 * v)) for n, v in SAFE_LIMITS.items()))
    return F.filter(every, lambda s: s["value"] > F.element_at(over, s["pollutant"]))


def above_safe_text(limits: Column) -> Column:
    return F.transform(limits, lambda s: F.format_string(LIMIT_FORMAT, s["pollutant"], decimal_text(s["value"], 1), decimal_text(s["times"], 1)))


def explanation(code: Column, index: Column) -> Column:
    """One sentence for the class."""

    def sentence(name: str, *parts: tuple[Column, int]) -> Column:
        return F.format_string(EXPLANATIONS[name], *[decimal_text(c, places) for c, places in parts])

    pm25, pm10, so2, co, no2 = (F.col(n) for n in ("PM2_5", "PM10", "SO2", "CO", "NO2"))
    share = ratio(pm25, pm10)
    return (
        F.when(code == FIRE, sentence("Fire", (pm25, 0), (co, 2), (share, 2)))
        .when(code == DUST, sentence("Dust", (pm10, 0), (share, 2)))
        .when(code == GAS, sentence("Gas", (so2, 0), (so2 / SAFE_LIMITS["SO2"], 0)))
        .when(code == INDUSTRIAL, sentence("Industrial", (so2, 0), (no2, 0)))
        .otherwise(sentence("Normal", (index, 0)))
    )


def half_even(c: Column, places: int) -> Column:
    """Round to the nearest, a tie to the even digit."""
    return F.rint(c * 10**places) / 10**places


def probability_map(prob: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in CLASSES]), F.transform(prob, lambda p: half_even(p * 100, 1)))


def ranked_probabilities(probs: Column) -> Column:
    """Entries of a class -> percent map, largest first, names breaking ties."""
    entries = F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label"), e["value"].alias("pct")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["label"].alias("label"), e["pct"].alias("pct")))


def score_columns(df: DataFrame) -> DataFrame:
    """Score readings that carry ``model_code`` and ``prob`` (array in class order).

    Adds label, confidence, danger, AQI, all_probs, above_safe and explanation. Only
    projections: the same plan serves a batch and a stream.
    """
    code, percent, index = F.col("_code"), F.col("_pct"), F.col("_aqi")
    step = df.withColumns({"_code": rule_code(F.col("model_code")), "_aqi": aqi_pm25("PM2_5")})
    step = step.withColumn("_pct", confidence(code, F.col("model_code"), F.col("prob")))
    out = step.withColumns(
        {
            "label": label_of(code),
            "confidence": half_even(percent, 1),
            "danger": danger(code, percent),
            "AQI": half_even(index, 1),
            "all_probs": probability_map(F.col("prob")),
            "above_safe": above_safe_text(above_limits()),
            "explanation": explanation(code, index),
        }
    )
    return out.drop("_code", "_pct", "_aqi")


def score_readings(readings: DataFrame, model=None) -> DataFrame:
    """Score a batch or streaming table of readings.

    With a fitted classifier its class and probabilities stand behind the rules; without
    one, a reading that no rule names is Normal.
    """
    ready = synthesize_features(readings)
    if model is not None:
        from ..operators.models import class_probabilities

        return score_columns(class_probabilities(ready, model))
    sure = F.array(*[F.lit(1.0 if i == NORMAL else 0.0) for i in range(len(CLASSES))])
    return score_columns(ready.withColumns({"model_code": F.lit(NORMAL), "prob": sure}))


# The four known scenarios a user can try.
SCENARIOS = {
    "Delhi Stubble Fire (Nov 2021)": {"NO2": 180.0, "SO2": 35.0, "CO": 8.5, "O3": 42.0, "PM2_5": 420.0, "PM10": 680.0, "AOD": 3.2, "fire_count": 45.0, "temp_c": 24.0, "humidity": 72.0, "wind_speed": 1.8},
    "Jaipur Dust Storm (May 2021)": {"NO2": 28.0, "SO2": 12.0, "CO": 0.7, "O3": 55.0, "PM2_5": 95.0, "PM10": 820.0, "AOD": 2.8, "fire_count": 0.0, "temp_c": 43.0, "humidity": 18.0, "wind_speed": 9.5},
    "Vizag LG Gas Leak (May 2020)": {"NO2": 85.0, "SO2": 920.0, "CO": 0.9, "O3": 38.0, "PM2_5": 48.0, "PM10": 65.0, "AOD": 0.4, "fire_count": 0.0, "temp_c": 30.0, "humidity": 78.0, "wind_speed": 2.1},
    "Normal day (Delhi, August)": {"NO2": 42.0, "SO2": 15.0, "CO": 1.1, "O3": 35.0, "PM2_5": 55.0, "PM10": 90.0, "AOD": 0.45, "fire_count": 0.0, "temp_c": 34.0, "humidity": 55.0, "wind_speed": 3.5},
}


def scenario_readings(spark) -> DataFrame:
    """The known scenarios as readings, to be given to ``score_readings``."""
    names = list(next(iter(SCENARIOS.values())))
    return spark.createDataFrame([(title, *(r[n] for n in names)) for title, r in SCENARIOS.items()], "scenario string, " + ", ".join(f"{n} double" for n in names))
