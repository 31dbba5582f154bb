"""Registered queries: report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aqi import aqi
from ..operators.decompose import daily_means
from ..operators.sampling import class_weights
from ..sources import views
from . import reports
from .oracle_views import AQI, BASE, DAILY, HOURLY
from .queries_clean import base
from .registry import query, sql

# daily series with index, as a table of (city, datetime)
_INDEXED = DAILY + f", indexed AS (SELECT city, CAST(date AS TIMESTAMP) AS datetime, PM2_5, PM10, NO2, {AQI} AS AQI FROM daily)"


def indexed(spark, sf):
    rows = views.daily(spark, sf).withColumn("AQI", aqi("PM2_5", "PM10"))
    return rows.select("city", F.col("date").cast("timestamp_ntz").alias("datetime"), "PM2_5", "PM10", "NO2", "AQI")


@query(
    "hourly_city_days",
    "A-01",
    sql([HOURLY, "d AS (SELECT city, CAST(datetime AS DATE) AS date, avg(NO2) AS NO2, avg(CO) AS CO FROM hourly GROUP BY 1, 2)"], "city d:date f:NO2 f:CO", "d"),
)
def hourly_city_days(spark, sf):
    return daily_means(views.hourly(spark, sf), ["NO2", "CO"], fill=False)


@query(
    "worst_days",
    "P-03 P-15 A-01 T-02",
    sql(
        [
            BASE,
            "d AS (SELECT city, CAST(datetime AS DATE) AS date, avg(AQI) AS AQI, count(AQI) AS hours FROM base GROUP BY 1, 2)",
            "x AS (SELECT *, CASE WHEN AQI <= 50 THEN 'Good' WHEN AQI <= 100 THEN 'Satisfactory' WHEN AQI <= 200 THEN 'Moderate' WHEN AQI <= 300 THEN 'Poor' WHEN AQI <= 500 THEN 'Very Poor' END AS band FROM d ORDER BY AQI DESC NULLS LAST, city, date LIMIT 20)",
        ],
        "city d:date f:AQI n:hours band",
        "x",
    ),
)
def worst_days(spark, sf):
    from ..functions.aqi import aqi_band

    from .stages import pm_proxies

    rows = pm_proxies(views.hourly(spark, sf)).withColumn("AQI", aqi("PM2_5", "PM10"))
    days = rows.groupBy("city", F.col("datetime").cast("date").alias("date")).agg(F.avg("AQI").alias("AQI"), F.count("AQI").alias("hours"))
    return reports.top_k(days.withColumn("band", aqi_band("AQI")), "AQI", 20, ["city", "date"])


@query(
    "fire_calendar",
    "A-02",
    sql(
        [HOURLY, "x AS (SELECT city, CAST(datetime AS DATE) AS date, coalesce(sum(fire_count), 0) AS fire_sum, coalesce(max(fire_count), 0) AS fire_count FROM hourly GROUP BY 1, 2)"],
        "city d:date f:fire_sum f:fire_count",
        "x",
    ),
)
def fire_calendar(spark, sf):
    return reports.report_fire_daily(views.hourly(spark, sf))


@query(
    "monthly_pattern",
    "A-03",
    sql(
        [
            _INDEXED,
            "m AS (SELECT city, strftime(datetime, '%Y-%m') AS \"month\", avg(PM2_5) AS p, avg(NO2) AS n, avg(AQI) AS a FROM indexed GROUP BY 1, 2)",
            "l AS (SELECT city, \"month\", 'PM2_5' AS series, p AS mean FROM m UNION ALL SELECT city, \"month\", 'NO2', n FROM m UNION ALL SELECT city, \"month\", 'AQI', a FROM m)",
            'x AS (SELECT city, "month", series, mean, CASE WHEN max(mean) OVER w - min(mean) OVER w > 0 THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) ELSE 0 END AS scaled FROM l WINDOW w AS (PARTITION BY city, series))',
        ],
        'city "month" series f:mean f:scaled',
        "x",
    ),
)
def monthly_pattern(spark, sf):
    return reports.report_monthly(indexed(spark, sf))


_FINGER = ["PM2_5", "PM10", "NO2", "SO2", "CO", "O3", "AOD"]


def _fingerprint(by: str) -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in _FINGER)
    top = f"greatest({', '.join(_FINGER)})"
    return (
        f"m AS (SELECT {by}, {means} FROM base GROUP BY 1 HAVING count(*) >= 2), "
        f"x AS (SELECT {by}, {', '.join(f'{c} / CASE WHEN {top} > 0 THEN {top} ELSE 1 END AS {c}' for c in _FINGER)} FROM m)"
    )


@query("label_fingerprint", "A-04", sql([BASE, _fingerprint("event_label")], "event_label " + " ".join(f"f:{c}" for c in _FINGER), "x"))
def label_fingerprint(spark, sf):
    return reports.report_fingerprint(base(spark, sf), "event_label")


@query("city_fingerprint", "A-17", sql([BASE, _fingerprint("city")], "city " + " ".join(f"f:{c}" for c in _FINGER), "x"))
def city_fingerprint(spark, sf):
    return reports.report_fingerprint(base(spark, sf), "city")


def _corr_sql() -> str:
    cols = reports.CORRELATION_COLUMNS
    rows = [f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 AND stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 THEN round_even(corr({a}, {b}), 2) END AS corr FROM base" for a in cols for b in cols]
    return "x AS (" + " UNION ALL ".join(rows) + ")"


@query("correlation", "A-05", sql([BASE, _corr_sql()], "a b f:corr", "x"))
def correlation(spark, sf):
    return reports.report_correlation(base(spark, sf))


@query(
    "key_figures",
    "A-06 T-03",
    sql(
        [
            BASE,
            "lab AS (SELECT city, event_label, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, min(datetime)) AS r FROM base WHERE event_label <> 'Normal' GROUP BY 1, 2)",
            "worst AS (SELECT city, datetime FROM (SELECT city, datetime, row_number() OVER (PARTITION BY city ORDER BY AQI DESC NULLS LAST, datetime) AS r FROM base) WHERE r = 1)",
            "k AS (SELECT city, count(*) FILTER (WHERE event_label <> 'Normal') AS n, max(AQI) AS p, avg(AQI) AS m, max(NO2) AS n2, max(SO2) AS s2 FROM base GROUP BY 1)",
            "x AS (SELECT k.city, format('{:,}', n) AS events, printf('%.0f', p) AS peak_aqi, printf('%.0f', m) AS mean_aqi, strftime(w.datetime, '%d %b %Y') AS worst_day, "
            "coalesce(l.event_label, 'None') AS top_label, printf('%.2f', n2) AS peak_no2, printf('%.2f', s2) AS peak_so2 FROM k JOIN worst w USING (city) LEFT JOIN lab l ON l.city = k.city AND l.r = 1)",
        ],
        "city events peak_aqi mean_aqi worst_day top_label peak_no2 peak_so2",
        "x",
    ),
)
def key_figures(spark, sf):
    return reports.report_kpis(base(spark, sf))


@query("label_counts", "A-07", sql([BASE, "x AS (SELECT event_label, count(*) AS n, min(datetime) AS first_seen FROM base GROUP BY 1)"], "event_label n:n t:first_seen", "x"))
def label_counts(spark, sf):
    return reports.value_counts(base(spark, sf))


@query(
    "series_catalogue",
    "A-08 T-01",
    "SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1 ORDER BY 1",
)
def series_catalogue(spark, sf):
    return reports.catalogue(views.table(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate")


@query("sorted_series", "T-01", sql(HOURLY, "city t:datetime f:NO2", "hourly ORDER BY city, hourly.datetime"))
def sorted_series(spark, sf):
    return views.hourly(spark, sf).select("city", "datetime", "NO2").orderBy("city", "datetime")


@query("city_summary", "A-09", sql([_INDEXED, "x AS (SELECT city, avg(AQI) AS mean, max(AQI) AS max, count(AQI) AS n FROM indexed GROUP BY 1)"], "city f:mean f:max n:n", "x"))
def city_summary(spark, sf):
    return reports.city_summary(indexed(spark, sf))


@query("disaster_days", "A-11", sql([BASE, "x AS (SELECT city, count(DISTINCT CASE WHEN event_label <> 'Normal' THEN CAST(datetime AS DATE) END) AS disaster_days FROM base GROUP BY 1)"], "city n:disaster_days", "x"))
def disaster_days(spark, sf):
    return reports.disaster_days(base(spark, sf))


@query("class_weights", "A-14", sql([BASE, "c AS (SELECT event_label, count(*) AS n FROM base GROUP BY 1)", "x AS (SELECT event_label, n, max(n) OVER () / n AS weight FROM c)"], "event_label n:n f:weight", "x"))
def class_weight_table(spark, sf):
    return class_weights(base(spark, sf), "event_label")


@query("seasonal_pattern", "A-15", sql([_INDEXED, "x AS (SELECT city, month(datetime) AS \"month\", avg(AQI) AS AQI FROM indexed GROUP BY 1, 2)"], 'city n:"month" f:AQI', "x"))
def seasonal_pattern(spark, sf):
    return reports.seasonal_pattern(indexed(spark, sf))


_MONTHS = [f"m{m:02d}" for m in range(1, 13)]


@query(
    "seasonal_heatmap",
    "A-15",
    sql([_INDEXED, "x AS (SELECT city, " + ", ".join(f"avg(AQI) FILTER (WHERE month(datetime) = {i + 1}) AS {n}" for i, n in enumerate(_MONTHS)) + " FROM indexed GROUP BY 1)"], "city " + " ".join(f"f:{n}" for n in _MONTHS), "x"),
)
def seasonal_heatmap(spark, sf):
    return reports.seasonal_heatmap(indexed(spark, sf))


@query(
    "city_overlay",
    "A-16",
    sql([BASE, "x AS (SELECT CAST(datetime AS DATE) AS date, " + ", ".join(f"avg(AQI) FILTER (WHERE city = '{c}') AS {c}" for c in views.CITY_NAMES) + " FROM base GROUP BY 1)"], "d:date " + " ".join(f"f:{c}" for c in views.CITY_NAMES), "x"),
)
def city_overlay(spark, sf):
    return reports.overlay(base(spark, sf), views.CITY_NAMES)


@query("event_bubbles", "A-18", sql([BASE, "x AS (SELECT city, event_label, count(*) AS hours, max(AQI) AS peak_aqi FROM base WHERE event_label <> 'Normal' GROUP BY 1, 2)"], "city event_label n:hours f:peak_aqi", "x"))
def event_bubbles(spark, sf):
    return reports.event_bubbles(base(spark, sf))


@query(
    "peak_rows",
    "T-03",
    sql([BASE, "x AS (SELECT city, datetime, AQI FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY AQI DESC NULLS LAST, datetime) AS r FROM base) WHERE r = 1)"], "city t:datetime f:AQI", "x"),
)
def peak_rows(spark, sf):
    return reports.peak_rows(base(spark, sf))
