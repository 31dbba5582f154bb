"""Registered queries: projections, cleaning, index, joins with event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aqi as aqi_fn
from ..functions.cleaning import clip
from ..functions.labels import code_of, fingerprint_label, label_of
from ..functions.weather import calendar_columns, interaction_columns, ratio_columns, season, wind_columns
from ..operators import events as ev
from ..operators.decompose import attach_residuals, classical_daily, confirm_events, daily_means, flag_rates, spike_flags
from ..operators.features import GASES, aqi_with_fallback
from ..operators.metrics import min_max_score
from ..operators.order_stats import clip_tail, tail_limits
from ..operators.series import LEN, POS, drop_position
from ..session import stage_table
from ..sources import views
from . import reports
from .oracle_views import AQI, BASE, DAILY, HOURLY, PM10, PM25, WINDOWS, piecewise, proxied
from .registry import query, sql
from .stages import pm_proxies


def base(spark, sf, keep_position=False):
    """Hourly city table with particulates, index, an arithmetic anomaly score and labels."""
    proxies = pm_proxies(views.hourly(spark, sf, keep_position))
    scored = proxies.withColumns({"AQI": aqi_fn.aqi("PM2_5", "PM10"), "anomaly_score": F.col("cloud_pct") / 100})
    return ev.label_events(scored, views.event_windows(spark)).drop("event_code")


def staged_base(spark, sf):
    """The same, written once for operators that read it more than once."""
    return stage_table(base(spark, sf, keep_position=True), "base")


@query("particulate_proxies", "P-01", sql([HOURLY, proxied("hourly")], "city t:datetime f:AOD f:PM2_5 f:PM10", "proxied"))
def particulate_proxies(spark, sf):
    return pm_proxies(views.hourly(spark, sf)).select("city", "datetime", "AOD", "PM2_5", "PM10")


_LIMITS = "lim AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.999) AS q_{c}" for c in GASES) + " FROM hourly)"
_CLIPPED = (
    "clipped AS (SELECT city, datetime, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, 0.0::DOUBLE), q_{c}) END AS {c}" for c in GASES)
    + " FROM hourly, lim)"
)


@query("tail_clip", "P-02 J-07", sql([HOURLY, _LIMITS, _CLIPPED], "city t:datetime f:NO2 f:SO2 f:CO f:O3", "clipped"))
def tail_clip(spark, sf):
    hourly = stage_table(views.hourly(spark, sf).select("city", "datetime", *GASES), "hourly")
    return clip_tail(hourly, tail_limits(hourly, GASES))


@query(
    "aqi_index",
    "P-03 P-15",
    sql(
        [
            DAILY,
            f"s AS (SELECT city, date, {piecewise('PM2_5', PM25)} AS sub25, {piecewise('PM10', PM10)} AS sub10, {AQI} AS AQI FROM daily)",
            "b AS (SELECT *, CASE WHEN AQI < 0 THEN NULL WHEN AQI <= 50 THEN 'Good' WHEN AQI <= 100 THEN 'Satisfactory' "
            "WHEN AQI <= 200 THEN 'Moderate' WHEN AQI <= 300 THEN 'Poor' WHEN AQI <= 500 THEN 'Very Poor' END AS band FROM s)",
        ],
        "city d:date f:sub25 f:sub10 f:AQI band",
        "b",
    ),
)
def aqi_index(spark, sf):
    index = views.daily(spark, sf).select(
        "city",
        "date",
        aqi_fn.sub_index("PM2_5", aqi_fn.PM25_BREAKPOINTS).alias("sub25"),
        aqi_fn.sub_index("PM10", aqi_fn.PM10_BREAKPOINTS).alias("sub10"),
        aqi_fn.aqi("PM2_5", "PM10").alias("AQI"),
    )
    return index.withColumn("band", aqi_fn.aqi_band("AQI"))


_READINGS = """
readings AS (
  SELECT event_id AS reading_id, CASE user_id % 3 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'Jaipur' ELSE 'Vizag' END AS city, ts,
         value / 2 + k AS NO2, value * (user_id % 8 + 1) / 2 AS SO2, k / 12.5::DOUBLE + (user_id % 8) / 4 AS CO, k * 1.5::DOUBLE AS O3,
         value * (k + 10) / 50 AS PM2_5, value * 4 + k AS PM10, value / 100 AS AOD, CAST(k % 12 AS DOUBLE) AS fire_count,
         k / 10 AS wind_speed, k * 3.6::DOUBLE AS wind_dir, hour(ts) AS hour, month(ts) AS month, user_id % 3 <> 0 AS is_spike
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


@query(
    "aqi_fallback",
    "P-04",
    sql(
        [
            _READINGS,
            "part AS (SELECT reading_id, AOD, CASE WHEN fire_count < 4 THEN PM2_5 END AS PM2_5, CASE WHEN fire_count < 4 THEN PM10 END AS PM10 FROM readings)",
            f"i AS (SELECT *, {AQI} AS a FROM part)",
            "filled AS (SELECT reading_id, CASE WHEN a IS NULL AND (SELECT avg(CASE WHEN a IS NULL THEN 1 ELSE 0 END) FROM i) > 0.5 THEN AOD * 200 ELSE a END AS AQI FROM i)",
        ],
        "reading_id f:AQI",
        "filled",
    ),
)
def aqi_fallback(spark, sf):
    some = F.col("fire_count") < 4
    part = views.readings(spark, sf).select("reading_id", "AOD", F.when(some, F.col("PM2_5")).alias("PM2_5"), F.when(some, F.col("PM10")).alias("PM10"))
    return aqi_with_fallback(part).select("reading_id", "AQI")


_CONTINUOUS = (
    "CASE WHEN PM2_5 <= 30 THEN PM2_5 / 30 * 50 WHEN PM2_5 <= 60 THEN 50 + (PM2_5 - 30) / 30 * 50 WHEN PM2_5 <= 90 THEN 100 + (PM2_5 - 60) / 30 * 100 "
    "WHEN PM2_5 <= 120 THEN 200 + (PM2_5 - 90) / 30 * 100 ELSE least(300 + (PM2_5 - 120) / 130 * 100, 500.0::DOUBLE) END"
)


@query("aqi_continuous", "P-05", sql([_READINGS, f"c AS (SELECT reading_id, {_CONTINUOUS} AS AQI FROM readings)"], "reading_id f:AQI", "c"))
def aqi_continuous(spark, sf):
    return views.readings(spark, sf).select("reading_id", aqi_fn.aqi_pm25("PM2_5").alias("AQI"))


_INTERACT = """
x AS (
  SELECT city, datetime, PM2_5 / (PM10 + 1e-6::DOUBLE) AS ratio_pm25_pm10, CO / (NO2 + 1e-6::DOUBLE) AS ratio_co_no2,
         SO2 / (NO2 + 1e-6::DOUBLE) AS ratio_so2_no2, CO * NO2 AS co_x_no2, SO2 * NO2 AS so2_x_no2,
         coalesce(AOD, 0) * coalesce(wind_speed, 0) AS aod_x_wind, coalesce(fire_count, 0) * NO2 AS fire_x_no2
  FROM proxied)"""


@query(
    "ratios_interactions",
    "P-06 P-07",
    sql(
        [HOURLY, proxied("hourly"), _INTERACT],
        "city t:datetime f:ratio_pm25_pm10 f:ratio_co_no2 f:ratio_so2_no2 f:co_x_no2 f:so2_x_no2 f:aod_x_wind f:fire_x_no2",
        "x",
    ),
)
def ratios_interactions(spark, sf):
    columns = {**ratio_columns(), **interaction_columns()}
    return pm_proxies(views.hourly(spark, sf)).select("city", "datetime", *[c.alias(n) for n, c in columns.items()])


_CALENDAR = """
cal AS (
  SELECT o_orderkey, hour(t) AS hour, (isodow(t) - 1) AS dayofweek, month(t) AS month, CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         sin(2 * pi() * hour(t) / 24) AS hour_sin, cos(2 * pi() * hour(t) / 24) AS hour_cos,
         sin(2 * pi() * month(t) / 12) AS month_sin, cos(2 * pi() * month(t) / 12) AS month_cos, dayofyear(t) AS day_of_year,
         CASE WHEN month(t) IN (12, 1, 2) THEN 'Winter' WHEN month(t) <= 5 THEN 'Summer' WHEN month(t) <= 9 THEN 'Monsoon' ELSE 'PostMonsoon' END AS season
  FROM (SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24) AS t FROM orders))"""


@query(
    "calendar_parts",
    "P-08 P-09 P-17",
    sql(_CALENDAR, "o_orderkey n:hour n:dayofweek n:month n:is_weekend f:hour_sin f:hour_cos f:month_sin f:month_cos n:day_of_year season", "cal"),
)
def calendar_parts(spark, sf):
    t = F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_custkey") % 24)
    rows = views.table(spark, sf, "orders").select("o_orderkey", t.alias("t"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in calendar_columns("t").items()], F.dayofyear("t").alias("day_of_year"), season("t").alias("season"))


@query(
    "wind_vector",
    "P-10",
    sql(
        [
            HOURLY,
            "w AS (SELECT city, datetime, coalesce(wind_speed, 0) * sin(radians(coalesce(wind_dir, 0))) AS wind_u, coalesce(wind_speed, 0) * cos(radians(coalesce(wind_dir, 0))) AS wind_v FROM hourly)",
        ],
        "city t:datetime f:wind_u f:wind_v",
        "w",
    ),
)
def wind_vector(spark, sf):
    return views.hourly(spark, sf).select("city", "datetime", *[c.alias(n) for n, c in wind_columns("wind_speed", "wind_dir").items()])


@query(
    "city_range",
    "P-11",
    sql(HOURLY, "city t:datetime f:NO2 f:SO2", "hourly WHERE city = 'Jaipur' AND hourly.datetime >= TIMESTAMP '2024-01-10' AND hourly.datetime <= TIMESTAMP '2024-01-20'"),
)
def city_range(spark, sf):
    return reports.select_range(views.hourly(spark, sf), "Jaipur", "2024-01-10", "2024-01-20").select("city", "datetime", "NO2", "SO2")


_CODE = "CASE {0} WHEN 'Fire' THEN 1 WHEN 'Dust' THEN 2 WHEN 'Gas' THEN 3 WHEN 'Industrial' THEN 4 ELSE 0 END"


@query(
    "event_labels",
    "J-04 P-12 P-13",
    sql([BASE, f"x AS (SELECT city, datetime, event_label, event_label AS display_label, {_CODE.format('event_label')} AS event_code FROM base)"], "city t:datetime event_label display_label n:event_code", "x"),
)
def event_labels(spark, sf):
    labelled = ev.label_events(views.hourly(spark, sf).select("city", "datetime"), views.event_windows(spark))
    return reports.with_display_label(labelled)


@query(
    "event_labels_whole_day",
    "J-04",
    sql(
        [
            HOURLY,
            WINDOWS,
            "x AS (SELECT h.city, h.datetime, coalesce((SELECT max_by(w.type, w.seq) FROM windows w WHERE w.city = h.city AND h.datetime >= w.w_start "
            "AND h.datetime < w.w_end + INTERVAL 1 DAY), 'Normal') AS event_label FROM hourly h)",
        ],
        "city t:datetime event_label",
        "x",
    ),
)
def event_labels_whole_day(spark, sf):
    hourly = views.hourly(spark, sf).select("city", "datetime")
    return ev.label_events(hourly, views.event_windows(spark), inclusive_end="day").drop("event_code")


@query(
    "label_codes",
    "P-13",
    f"SELECT event_id, {_CODE.format('label')}::BIGINT AS code, ['Normal', 'Fire', 'Dust', 'Gas', 'Industrial'][{_CODE.format('label')} + 1] AS name "
    "FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'Fire' WHEN 'error' THEN 'Gas' WHEN 'view' THEN 'Industrial' WHEN 'signup' THEN 'Dust' ELSE 'odd' END AS label FROM events)",
)
def label_codes(spark, sf):
    t = F.col("event_type")
    label = F.when(t == "click", "Fire").when(t == "error", "Gas").when(t == "view", "Industrial").when(t == "signup", "Dust").otherwise("odd")
    return views.table(spark, sf, "events").select("event_id", code_of(label).alias("code")).withColumn("name", label_of("code"))


@query(
    "fingerprint_labels",
    "P-16",
    sql(
        [
            _READINGS,
            "x AS (SELECT reading_id, CASE WHEN PM2_5 > 100 AND CO > 2.5 AND PM2_5 / (PM10 + 1e-6::DOUBLE) > 0.55 THEN 'Fire' "
            "WHEN PM10 > 150 AND PM2_5 / (PM10 + 1e-6::DOUBLE) < 0.38 AND wind_speed > 3.5 THEN 'Dust' "
            "WHEN SO2 > 60 AND NO2 > 50 AND PM10 < 250 THEN 'Gas' WHEN SO2 > 35 AND NO2 > 60 AND PM2_5 > 80 THEN 'Marine' ELSE 'Normal' END AS label FROM readings)",
        ],
        "reading_id label",
        "x",
    ),
)
def fingerprint_labels(spark, sf):
    return views.readings(spark, sf).select("reading_id", fingerprint_label().alias("label"))


@query(
    "event_points",
    "P-18",
    sql(
        [BASE, "x AS (SELECT city, datetime, event_label AS display_label, least(greatest(coalesce(AQI, 30), 10.0::DOUBLE), 500.0::DOUBLE) AS size, anomaly_score AS height FROM base WHERE event_label <> 'Normal')"],
        "city t:datetime display_label f:size f:height",
        "x",
    ),
)
def event_points(spark, sf):
    return reports.report_events(base(spark, sf))


@query(
    "pollutant_view",
    "P-19",
    sql(
        [
            BASE,
            "x AS (SELECT city, datetime, NO2 AS raw, CAST(NULL AS DOUBLE) AS smooth, CASE WHEN event_label <> 'Normal' THEN event_label END AS event, "
            "CASE WHEN event_label <> 'Normal' THEN NO2 END AS event_top, CASE WHEN event_label <> 'Normal' THEN 0.0 END AS event_base FROM base)",
        ],
        "city t:datetime f:raw f:smooth event f:event_top f:event_base",
        "x",
    ),
)
def pollutant_view(spark, sf):
    return reports.report_pollutant(base(spark, sf), "NO2")


# ------------------------------------------------------------------ event windows and evidence

_VALIDATED = """
hit AS (
  SELECT w.id, w.city, w.type, w.name, count(b.city) AS n, count(*) FILTER (WHERE {label} = w.type) AS m, max(b.anomaly_score) AS peak
  FROM windows w LEFT JOIN base b ON b.city = w.city AND b.datetime >= w.w_start AND b.datetime <= w.w_end GROUP BY ALL),
validated AS (
  SELECT id, city, type, name, CASE WHEN n > 0 THEN m / n * 100 > 50 ELSE false END AS detected,
         CASE WHEN n > 0 THEN round_even(m / n * 100, 1) ELSE 0 END AS match_pct, round_even(coalesce(peak, 0), 3) AS peak_score
  FROM hit)"""
_PREDICTED = "CASE WHEN b.NO2 > 40 THEN 'Fire' WHEN b.SO2 > 40 THEN 'Gas' WHEN b.O3 > 30 THEN 'Industrial' ELSE 'Dust' END"


@query("event_validation", "A-12 J-05", sql([BASE, _VALIDATED.format(label="b.event_label")], "n:id city type name detected f:match_pct f:peak_score", "validated"))
def event_validation(spark, sf):
    return ev.validate_events(base(spark, sf), views.event_windows(spark)).drop("seq", "start", "end")


def _with_prediction(spark, sf):
    guess = F.when(F.col("NO2") > 40, "Fire").when(F.col("SO2") > 40, "Gas").when(F.col("O3") > 30, "Industrial").otherwise("Dust")
    return base(spark, sf).withColumn("pred_label", guess)


@query("event_validation_predicted", "A-12 J-05", sql([BASE, _VALIDATED.format(label=_PREDICTED)], "n:id city type name detected f:match_pct f:peak_score", "validated"))
def event_validation_predicted(spark, sf):
    return ev.validate_events(_with_prediction(spark, sf), views.event_windows(spark), label="pred_label").drop("seq", "start", "end")


@query(
    "detection_total",
    "A-12",
    sql([BASE, _VALIDATED.format(label="b.event_label"), "t AS (SELECT count(*) FILTER (WHERE detected) AS detected, count(*) AS events, count(*) FILTER (WHERE detected) * 100 / count(*) AS detected_pct FROM validated)"], "n:detected n:events f:detected_pct", "t"),
)
def detection_total(spark, sf):
    return ev.detection_total(ev.validate_events(base(spark, sf), views.event_windows(spark)))


# daily table on a full calendar, gaps carried, and its weekday decomposition
_DAYS = """
span AS (SELECT city, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY city),
days AS (
  SELECT city, date, coalesce(last_value(PM2_5 IGNORE NULLS) OVER up, first_value(PM2_5 IGNORE NULLS) OVER down, 0) AS PM2_5,
         coalesce(last_value(NO2 IGNORE NULLS) OVER up, first_value(NO2 IGNORE NULLS) OVER down, 0) AS NO2
  FROM span LEFT JOIN daily USING (city, date)
  WINDOW up AS (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY city ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
long AS (SELECT city, date, 'PM2_5' AS series, PM2_5 AS value FROM days UNION ALL SELECT city, date, 'NO2', NO2 FROM days),
trended AS (
  SELECT *, avg(value) OVER (PARTITION BY city, series ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend,
         count(*) OVER (PARTITION BY city, series) AS len FROM long),
parts AS (
  SELECT *, avg(value - trend) OVER (PARTITION BY city, series, isodow(date)) AS seasonal FROM trended),
residuals AS (
  SELECT city, date, series, trend, seasonal, CASE WHEN len < 60 THEN 0 ELSE value - trend - seasonal END AS residual FROM parts)"""


def daily_series(spark, sf):
    """Daily means of the five order series, complete and without gaps, with positions."""
    rows = views.daily(spark, sf).withColumn("datetime", F.col("date").cast("timestamp_ntz"))
    return stage_table(daily_means(rows, ["PM2_5", "NO2"], stage=stage_table, keep_position=True), "days")


@query("daily_means", "A-01 G-04 S-18", sql([DAILY, _DAYS], "city d:date f:PM2_5 f:NO2", "days"))
def daily_city_means(spark, sf):
    return daily_series(spark, sf).select("city", "date", "PM2_5", "NO2")


@query("classical_residual", "M-03b", sql([DAILY, _DAYS], "city d:date series f:trend f:seasonal f:residual", "residuals"))
def classical_residual(spark, sf):
    return classical_daily(daily_series(spark, sf), chunk_rows=512)


@query(
    "residual_sigma",
    "W-14",
    sql(
        [
            DAILY,
            _DAYS,
            "st AS (SELECT city, series, avg(residual) AS m, stddev_samp(residual) AS s FROM residuals GROUP BY 1, 2)",
            "z AS (SELECT city, date, series, (residual - m) / s AS residual_sigma, coalesce((residual - m) / s > 2.5, false) AS is_shock FROM residuals JOIN st USING (city, series))",
        ],
        "city d:date series f:residual_sigma is_shock",
        "z",
    ),
)
def residual_sigma(spark, sf):
    from ..operators.decompose import residual_sigma as sigma

    return sigma(classical_daily(daily_series(spark, sf), chunk_rows=512)).select("city", "date", "series", "residual_sigma", "is_shock")


# hourly city rows carrying the residual of a synthetic daily series of the same city
_EVIDENCE = (
    BASE
    + """,
raw_days AS (SELECT city, CAST(datetime AS DATE) AS date, avg(PM2_5) AS PM2_5, avg(NO2) AS NO2 FROM base GROUP BY 1, 2),
dm AS (
  SELECT city, date, coalesce(last_value(PM2_5 IGNORE NULLS) OVER up, first_value(PM2_5 IGNORE NULLS) OVER down, 0) AS PM2_5,
         coalesce(last_value(NO2 IGNORE NULLS) OVER up, first_value(NO2 IGNORE NULLS) OVER down, 0) AS NO2
  FROM raw_days
  WINDOW up AS (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY city ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
dr AS (
  SELECT city, date, CASE WHEN count(*) OVER (PARTITION BY city) < 20 THEN 0 ELSE PM2_5 - pt - avg(PM2_5 - pt) OVER (PARTITION BY city, isodow(date)) END AS pr,
         CASE WHEN count(*) OVER (PARTITION BY city) < 20 THEN 0 ELSE NO2 - nt - avg(NO2 - nt) OVER (PARTITION BY city, isodow(date)) END AS nr
  FROM (SELECT *, avg(PM2_5) OVER w AS pt, avg(NO2) OVER w AS nt FROM dm WINDOW w AS (PARTITION BY city ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))),
joined AS (
  SELECT b.city, b.datetime, b.anomaly_score, coalesce(pr, 0) AS PM2_5_residual, coalesce(nr, 0) AS NO2_residual
  FROM base b LEFT JOIN dr ON dr.city = b.city AND dr.date = CAST(b.datetime AS DATE)),
flagged AS (
  SELECT *, coalesce(floor(PM2_5_residual * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE > 3 * floor(coalesce(CASE WHEN count(PM2_5_residual) OVER w >= 12 THEN stddev_samp(PM2_5_residual) OVER w END, 1) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE, false)
         OR coalesce(floor(NO2_residual * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE > 3 * floor(coalesce(CASE WHEN count(NO2_residual) OVER w >= 12 THEN stddev_samp(NO2_residual) OVER w END, 1) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE, false) AS stl_spike
  FROM joined WINDOW w AS (PARTITION BY city ORDER BY datetime ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)),
evidence AS (SELECT *, anomaly_score > 0.82 AND stl_spike AS confirmed_event FROM flagged)"""
)


def _evidence(spark, sf):
    rows = staged_base(spark, sf)
    days = stage_table(daily_means(rows, ["PM2_5", "NO2"], stage=stage_table, keep_position=True), "days")
    residuals = classical_daily(days, ["PM2_5", "NO2"], min_days=20)
    return attach_residuals(rows, residuals, ["PM2_5", "NO2"]).select("city", "datetime", "anomaly_score", "PM2_5_residual", "NO2_residual", POS, LEN)


@query("residual_to_hourly", "J-06 W-11", sql(_EVIDENCE, "city t:datetime f:PM2_5_residual f:NO2_residual", "evidence"))
def residual_to_hourly(spark, sf):
    return drop_position(_evidence(spark, sf)).drop("anomaly_score")


@query(
    "residual_view",
    "P-14 P-20",
    sql([_EVIDENCE, "l AS (SELECT city, datetime, 'PM2_5' AS series, PM2_5_residual AS residual FROM evidence UNION ALL SELECT city, datetime, 'NO2', NO2_residual FROM evidence)"], "city t:datetime series f:residual", "l"),
)
def residual_view(spark, sf):
    return reports.report_residuals(_evidence(spark, sf))


@query("spike_evidence", "W-04 W-05 M-02 M-04", sql(_EVIDENCE, "city t:datetime stl_spike confirmed_event", "evidence"))
def spike_evidence(spark, sf):
    return confirm_events(spike_flags(_evidence(spark, sf), chunk_rows=256)).select("city", "datetime", "stl_spike", "confirmed_event")


@query(
    "flag_rates",
    "A-10 M-02",
    sql(
        [
            _EVIDENCE,
            "r AS (SELECT city, count(*) AS n_rows, count(*) FILTER (WHERE anomaly_score > 0.88) AS flagged, count(*) FILTER (WHERE anomaly_score > 0.88) * 100 / count(*) AS flagged_pct, "
            "count(*) FILTER (WHERE stl_spike) AS spikes, count(*) FILTER (WHERE confirmed_event) AS confirmed, count(*) FILTER (WHERE confirmed_event) * 100 / count(*) AS confirmed_pct FROM evidence GROUP BY 1)",
        ],
        "city n:n_rows n:flagged f:flagged_pct n:spikes n:confirmed f:confirmed_pct",
        "r",
    ),
)
def flag_rate_report(spark, sf):
    return flag_rates(confirm_events(spike_flags(_evidence(spark, sf), chunk_rows=256)))


@query(
    "score_scaling",
    "W-10 M-02",
    sql(
        [
            BASE,
            "x AS (SELECT city, datetime, 1 - (NO2 - min(NO2) OVER (PARTITION BY city)) / (max(NO2) OVER (PARTITION BY city) - min(NO2) OVER (PARTITION BY city) + 1e-9::DOUBLE) AS score FROM base)",
            "y AS (SELECT *, score > 0.88 AS is_anomaly FROM x)",
        ],
        "city t:datetime f:score is_anomaly",
        "y",
    ),
)
def score_scaling(spark, sf):
    rows = stage_table(views.hourly(spark, sf).select("city", "datetime", "NO2"), "scores")
    return min_max_score(rows, "NO2", name="score", stage=stage_table).drop("NO2").withColumn("is_anomaly", F.col("score") > 0.88)


@query(
    "forecast_clip",
    "P-01 M-08",
    sql("x AS (SELECT o_orderkey, least(greatest(floor(o_totalprice) / 100 - 500, 0.0::DOUBLE), 1500.0::DOUBLE) AS forecast FROM orders)", "o_orderkey f:forecast", "x"),
)
def forecast_clip(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", clip(F.floor("o_totalprice") / 100 - 500, 0, 1500).alias("forecast"))
