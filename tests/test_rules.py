"""Expressions, labels, sampling, order statistics and metrics on small tables."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyweave.functions import aqi as q
from skyweave.functions.cleaning import clip, decimal_text, lenient_double, nan_to_null
from skyweave.functions.labels import code_of, label_of
from skyweave.functions.scoring import score_readings, synthesize_features
from skyweave.operators import events as ev
from skyweave.operators import metrics, sampling
from skyweave.operators.order_stats import below_counts, clip_tail, exact_quantiles, in_ranges, tail_limits
from skyweave.operators.smooth import fit_weights
from skyweave.sources import reshape


def line(v, c_lo, c_hi, i_lo, i_hi):
    return (i_hi - i_lo) / (c_hi - c_lo + 1e-9) * (v - c_lo) + i_lo


@pytest.mark.parametrize(
    ("pm25", "pm10", "want"),
    [
        (None, None, None),
        (0.0, None, None),
        (-3.0, 0.0, None),
        (30.0, None, 50.0),
        (30.5, None, line(30.5, 31, 60, 51, 100)),
        (31.0, None, 51.0),
        (60.0, None, 100.0),
        (90.0, None, 200.0),
        (120.0, None, 300.0),
        (250.0, None, 400.0),
        (5000.0, None, 500.0),
        (None, 50.0, 50.0),
        (None, 350.0, 300.0),
        (None, 430.0, 400.0),
        (30.0, 430.0, 400.0),
    ],
)
def test_index(spark, pm25, pm10, want):
    got = spark.createDataFrame([(pm25, pm10)], "a double, b double").select(q.aqi("a", "b")).first()[0]
    assert got == (None if want is None else pytest.approx(want, abs=1e-6))


def test_continuous_index_and_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 30.0, 45.0, 60.0, 75.0, 90.0, 105.0, 120.0, 250.0, 9999.0)], "v double")
    got = [r[0] for r in df.select(q.aqi_pm25("v")).collect()]
    assert got == pytest.approx([0, 50, 75, 100, 150, 200, 250, 300, 400, 500])
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 50.0, 50.5, 100.0, 200.0, 300.0, 500.0, 501.0, None)], "v double")
    assert [r[0] for r in df.select(q.aqi_band("v")).collect()] == [
        None, "Good", "Good", "Satisfactory", "Satisfactory", "Moderate", "Poor", "Very Poor", None, None
    ]


def test_cleaning(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (None, None), (7.0, "2.5"), (-1.0, "NaN")], "v double, s string")
    rows = df.select(clip(nan_to_null("v"), 0, 5).alias("c"), lenient_double("s").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(None, 0.0), (None, 0.0), (5.0, 2.5), (0.0, 0.0)]


@pytest.mark.parametrize(("v", "places"), [(0.125, 2), (2.675, 2), (1234.5, 0), (0.25, 1), (0.05, 1), (99.95, 1), (1e6 + 0.5, 0)])
def test_decimal_text_rounds_like_c(spark, v, places):
    assert spark.range(1).select(decimal_text(F.lit(v), places)).first()[0] == f"{v:.{places}f}"


def test_codes(spark):
    df = spark.createDataFrame([("Normal",), ("Industrial",), ("odd",), (None,)], "l string")
    assert [r[0] for r in df.select(code_of("l")).collect()] == [0, 4, 0, 0]
    assert [r[0] for r in spark.range(7).select(label_of("id")).collect()] == ["Normal", "Fire", "Dust", "Gas", "Industrial", "Normal", "Normal"]


SCENARIOS = [
    ("fire", 180.0, 35.0, 8.5, 42.0, 420.0, 680.0, 3.2, 45.0, 1.8),
    ("dust", 28.0, 12.0, 0.7, 55.0, 95.0, 820.0, 2.8, 0.0, 9.5),
    ("gas", 85.0, 920.0, 0.9, 38.0, 48.0, 65.0, 0.4, 0.0, 2.1),
    ("normal", 42.0, 15.0, 1.1, 35.0, 55.0, 90.0, 0.45, 0.0, 3.5),
]


def test_known_scenarios(spark):
    df = spark.createDataFrame(SCENARIOS, "name string, NO2 double, SO2 double, CO double, O3 double, PM2_5 double, PM10 double, AOD double, fire_count double, wind_speed double")
    got = {r["name"]: r for r in score_readings(df).collect()}
    assert (got["fire"]["label"], got["fire"]["danger"], got["fire"]["confidence"]) == ("Fire", "HIGH", 95.0)
    assert (got["dust"]["label"], got["dust"]["danger"], got["dust"]["confidence"]) == ("Dust", "HIGH", round(55 + 820 / 30, 1))
    assert (got["gas"]["label"], got["gas"]["danger"], got["gas"]["confidence"]) == ("Gas", "HIGH", 95.0)
    assert (got["normal"]["label"], got["normal"]["danger"], got["normal"]["confidence"]) == ("Normal", "LOW", 100.0)
    assert got["gas"]["above_safe"] == ["NO2=85.0 (2.1× safe limit)", "SO2=920.0 (46.0× safe limit)"]
    assert got["fire"]["AQI"] == 500.0 and got["normal"]["all_probs"]["Normal"] == 100.0
    steady = synthesize_features(df.withColumn("is_spike", F.lit(False))).first()
    assert steady["PM2_5_lag24"] == 420.0 and steady["NO2_roll6_std"] == 0.0 and steady["pressure"] == 1013.0


def stamp(text):
    return dt.datetime.fromisoformat(text)


def test_labels_last_window_wins_and_end_is_midnight(spark):
    windows = spark.createDataFrame(
        [(1, 1, "a", stamp("2024-01-01"), stamp("2024-01-05"), "Fire"), (2, 2, "a", stamp("2024-01-03 10:00:00"), stamp("2024-01-04"), "Gas")],
        "id int, seq int, city string, start timestamp_ntz, end timestamp_ntz, type string",
    )
    times = ["2024-01-01 00:00", "2024-01-03 09:00", "2024-01-03 10:00", "2024-01-04 00:00", "2024-01-04 01:00", "2024-01-05 00:00", "2024-01-05 01:00"]
    rows = spark.createDataFrame([(c, stamp(t)) for c in ("a", "b") for t in times], "city string, datetime timestamp_ntz")
    got = {(r[0], str(r[1])[:16]): (r[2], r[3]) for r in ev.label_events(rows, windows).collect()}
    assert [got["a", t][0] for t in times] == ["Fire", "Fire", "Gas", "Gas", "Fire", "Fire", "Normal"]
    assert got["a", times[2]][1] == 3 and all(got["b", t] == ("Normal", 0) for t in times)
    whole = {str(r[1])[:16]: r[2] for r in ev.label_events(rows.filter("city = 'a'"), windows, inclusive_end="day").collect()}
    assert [whole[t] for t in times] == ["Fire", "Fire", "Gas", "Gas", "Gas", "Fire", "Fire"]


def test_labelling_does_not_multiply_rows(spark):
    windows = spark.createDataFrame([(i, i, "a", stamp("2024-01-01"), stamp("2024-02-01"), "Fire") for i in range(5)], "id int, seq int, city string, start timestamp_ntz, end timestamp_ntz, type string")
    rows = spark.range(100).select(F.lit("a").alias("city"), (F.lit("2024-01-10").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("datetime"))
    assert ev.label_events(rows, windows).count() == 100


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("quant", [0.0, 0.37, 0.999, 1.0])
def test_quantile_is_exact_while_narrowing(spark, ties, quant):
    rng = np.random.default_rng(11)
    v = rng.lognormal(0, 2, 3000)
    v = np.where(rng.random(3000) < 0.4, 1.0, v.round(1)) if ties else v
    df = spark.createDataFrame([(float(x), None) for x in v], "v double, e double")
    got = exact_quantiles(df, ["v", "e"], quant, accuracy=20)
    assert got["v"] == pytest.approx(np.quantile(v, quant), rel=1e-12) and got["e"] is None


def test_tail_clip_leaves_an_empty_column(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(1000)], "a double, b double")
    limits = tail_limits(df, ["a", "b"])
    assert limits["a"] == pytest.approx(998.001) and limits["b"] is None
    assert clip_tail(df, limits).agg(F.max("a")).first()[0] == pytest.approx(998.001)


def test_below_counts_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [("g" if rng.random() < 0.8 else "h", float(round(rng.random() ** 4, 2)), int(rng.integers(0, 3))) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = below_counts(df, "v", ["n"], "k", rows=3).collect()
    for r in got:
        assert r["n_below"] == sum(n for k, v, n in rows if k == r["k"] and v < r["v"])


def test_ranges_follow_the_rows_and_cut_a_hot_group(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, 1).when(F.col("id") % 101 == 0, None).otherwise(0).alias("k"))
    sizes = in_ranges(df, ["k"], ["id"], 500).groupBy("k", "_range").count()
    assert sizes.agg(F.max("count")).first()[0] < 1500 and sizes.where("k = 0").count() > 30
    split = sampling.stratified_split(df, "k", ["id"], 0.2, rows=500)
    whole = sampling.stratified_split(df, "k", ["id"], 0.2)
    assert split.count() == 20_000 and split.exceptAll(whole).count() == 0


def brute_auc(score, pos):
    p, n = score[pos], score[~pos]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def test_auc_equals_brute_force_and_flips(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 3, 600)
    prob = np.round(rng.random((600, 5)), 2)
    make = lambda p: spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(label, p)], "label int, prob array<double>")
    got = {r["cls"]: r["auc"] for r in metrics.roc_auc_ovr(make(prob), rows=7).collect()}
    assert sorted(got) == [0, 1, 2]  # classes without positives are left out
    for c, auc in got.items():
        assert auc == pytest.approx(brute_auc(prob[:, c], label == c))
    flipped = {r["cls"]: r["auc"] for r in metrics.roc_auc_ovr(make(-prob)).collect()}
    assert all(flipped[c] == pytest.approx(1 - a) for c, a in got.items())


def test_strata_are_exact_and_reproducible(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("label"))
    split = sampling.stratified_split(df, "label", ["id"], 0.2)
    assert {(r[0], r[1]) for r in split.filter("is_test").groupBy("label").count().collect()} == {(0, 980), (1, 20)}
    again = sampling.stratified_split(df.repartition(7), "label", ["id"], 0.2)
    assert split.exceptAll(again).count() == 0
    folds = sampling.stratified_folds(df, "label", ["id"]).groupBy("label", "fold").count().collect()
    assert {(r[0], r[2]) for r in folds} == {(0, 980), (1, 20)} and len(folds) == 10


def test_sample_keeps_all_events(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 100 == 0, 2).otherwise(0).alias("event_code"))
    got = {r[0]: r[1] for r in sampling.training_sample(df, ["id"]).groupBy("event_code").count().collect()}
    assert got[2] == 200 and abs(got[0] - 0.08 * 19800) < 150


def test_zero_division_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "label int, pred int")
    got = {r["cls"]: r for r in metrics.per_class(df).collect()}
    assert (got[1]["precision"], got[1]["recall"], got[1]["f1"]) == (0.0, 0.0, 0.0)
    assert (got[2]["precision"], got[2]["recall"]) == (0.0, 0.0)
    m = metrics.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(1 / 3) and m["f1_macro"] == pytest.approx(0.5 / 3)


def test_regions_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(60, 70, 3000), rng.uniform(-5, 5, 3000))]
    places = [("p", 65.0, 0.0, 200), ("q", 66.5, 1.0, 90)]
    obs = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i long, lat double, lon double")
    cities = spark.createDataFrame(places, "city string, lat double, lon double, buffer_km int")
    got = {(r["city"], r["i"]) for r in reshape.within_regions(obs, cities).collect()}

    def far(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    assert got == {(n, i) for n, la, lo, r in places for i, p in enumerate(pts) if far(*p, la, lo) <= r}


def test_first_row_and_source_order(spark):
    rows = spark.createDataFrame([("a", 2, 9.0), ("a", 1, None), ("b", 5, 4.0)], "k string, o int, v double")
    assert {(r[0], r[1], r[2]) for r in reshape.keep_first(rows, ["k"], ["o"]).collect()} == {("a", 1, None), ("b", 5, 4.0)}
    first = spark.createDataFrame([("a", None, 1.0)], "k string, x double, y double")
    second = spark.createDataFrame([("a", 5.0, 2.0), ("b", 6.0, None)], "k string, x double, y double")
    got = {r[0]: (r[1], r[2]) for r in reshape.priority_merge([first, second], ["k"], ["x", "y"]).collect()}
    assert got == {"a": (5.0, 1.0), "b": (6.0, None)}


@given(st.integers(2, 8), st.integers(0, 3))
@settings(max_examples=30, deadline=None)
def test_fit_weights_reproduce_polynomials(half, poly):
    window = 2 * half + 1
    x = np.arange(window, dtype=float) - half
    y = sum((k + 1) * x**k for k in range(poly + 1))
    np.testing.assert_allclose(fit_weights(window, poly) @ y, y, atol=1e-6 * max(1.0, np.abs(y).max()))
    assert fit_weights(11, 2)[5] == pytest.approx(np.array([-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]) / 429)
