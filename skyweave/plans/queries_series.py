"""Registered queries: gap filling, smoothing and window features of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators.decompose import centred_residual, trailing_residual
from ..operators.features import LAG_COLUMNS, LAGS, ROLL_COLUMNS, daily_momentum, lags_and_rolls, lead_target
from ..operators.fill import carry_fill, fill_gaps, interpolate
from ..operators.series import LEN, POS, drop_position, with_position
from ..operators.smooth import fit_weights, savgol
from ..session import stage_table
from ..sources import views
from . import reports
from .oracle_views import BASE, DAILY, STATIONS, proxied
from .queries_clean import _DAYS, base, daily_series, staged_base
from .registry import query, sql
from .stages import pm_proxies

CHUNK = 256  # short chunks, so that the supplied series cross many chunk borders
FILLED = ["PM2_5", "NO2", "temp_c"]
_FILLED_SPEC = "city t:datetime " + " ".join(f"f:{c}" for c in FILLED)

_POSITIONED = "pos AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime) AS p FROM proxied)"


def _interpolated(cols: list[str]) -> str:
    near, out = [], []
    for c in cols:
        hit = f"CASE WHEN {c} IS NOT NULL THEN p END"
        near.append(
            f"last_value({hit} IGNORE NULLS) OVER up AS bp_{c}, last_value({c} IGNORE NULLS) OVER up AS bv_{c}, "
            f"first_value({hit} IGNORE NULLS) OVER down AS ap_{c}, first_value({c} IGNORE NULLS) OVER down AS av_{c}"
        )
        out.append(
            f"CASE WHEN {c} IS NOT NULL THEN {c} "
            f"WHEN bp_{c} IS NOT NULL AND ap_{c} IS NOT NULL THEN CASE WHEN p - bp_{c} <= 6 OR ap_{c} - p <= 6 THEN bv_{c} + (av_{c} - bv_{c}) / (ap_{c} - bp_{c}) * (p - bp_{c}) END "
            f"WHEN bp_{c} IS NULL AND ap_{c} - p <= 6 THEN av_{c} WHEN ap_{c} IS NULL AND p - bp_{c} <= 6 THEN bv_{c} END AS {c}"
        )
    return f"""
{_POSITIONED},
near AS (
  SELECT *, {', '.join(near)} FROM pos
  WINDOW up AS (PARTITION BY city ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY city ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
linear AS (SELECT city, datetime, p, {', '.join(out)} FROM near)"""


_SEASONAL = (
    "seasonal AS (SELECT city, datetime, p, "
    + ", ".join(f"coalesce({c}, avg({c}) OVER (PARTITION BY city, month(datetime), hour(datetime)), 0) AS {c}" for c in FILLED)
    + " FROM linear)"
)


def _station_rows(spark, sf):
    rows = pm_proxies(views.stations(spark, sf, keep_position=True))
    return stage_table(rows.select("city", "datetime", *FILLED, POS, LEN), "stations")


@query("linear_gaps", "G-01", sql([STATIONS, proxied("stations"), _interpolated(FILLED)], _FILLED_SPEC, "linear"))
def linear_gaps(spark, sf):
    return drop_position(interpolate(_station_rows(spark, sf), FILLED, chunk_rows=CHUNK))


@query("seasonal_gaps", "G-02 G-03 A-13", sql([STATIONS, proxied("stations"), _interpolated(FILLED), _SEASONAL], _FILLED_SPEC, "seasonal"))
def seasonal_gaps(spark, sf):
    return fill_gaps(_station_rows(spark, sf), FILLED, chunk_rows=CHUNK, stage=stage_table)


_CARRIED = (
    "carried AS (SELECT city, datetime, p, "
    + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER up, first_value({c} IGNORE NULLS) OVER down, 0) AS {c}" for c in FILLED)
    + """ FROM pos
  WINDOW up AS (PARTITION BY city ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY city ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
)


@query("carried_gaps", "G-04", sql([STATIONS, proxied("stations"), _POSITIONED, _CARRIED], _FILLED_SPEC, "carried"))
def carried_gaps(spark, sf):
    return drop_position(carry_fill(_station_rows(spark, sf), FILLED, chunk_rows=CHUNK))


def _smoothed(source: str, c: str, raw: str, key: str = "city") -> str:
    """Least-squares smoothing by explicit weights over the rows of the fitted window."""
    w = fit_weights(11, 2)

    def at(row: int, shift: int) -> str:
        terms = []
        for j in range(11):
            k = shift + j
            ref = c if k == 0 else (f"lead({c}, {k}) OVER w" if k > 0 else f"lag({c}, {-k}) OVER w")
            terms.append(f"({float(w[row][j])!r})::DOUBLE * {ref}")
        return " + ".join(terms)

    arms = [f"WHEN len < 11 THEN avg({raw}) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"]
    for p in range(5):
        arms.append(f"WHEN p = {p + 1} THEN {at(p, -p)}")
        arms.append(f"WHEN p = len - {p} THEN {at(10 - p, p - 10)}")
    return (
        f"smoothed AS (SELECT *, CASE {' '.join(arms)} ELSE {at(5, -5)} END AS {c}_smooth "
        f"FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS len FROM {source}) WINDOW w AS (PARTITION BY {key} ORDER BY p))"
    )


@query(
    "savgol_smooth",
    "G-05",
    sql([STATIONS, proxied("stations"), _interpolated(FILLED), _SEASONAL, _smoothed("seasonal", "NO2", "NO2")], "city t:datetime f:NO2 f:NO2_smooth", "smoothed"),
)
def savgol_smooth(spark, sf):
    filled = fill_gaps(_station_rows(spark, sf), ["NO2"], chunk_rows=CHUNK, stage=stage_table, keep_position=True)
    return savgol(filled, ["NO2"], prefilled=True, chunk_rows=CHUNK).select("city", "datetime", "NO2", "NO2_smooth")


_SHORT = """
perday AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus <> 'P') AS DOUBLE) / 1000 AS value
  FROM orders GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY date) AS p FROM perday),
kept AS (
  SELECT *, coalesce(last_value(value IGNORE NULLS) OVER up, first_value(value IGNORE NULLS) OVER down, 0) AS v FROM numbered
  WINDOW up AS (PARTITION BY o_custkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY o_custkey ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("short_series_smooth", "G-06 G-05", sql([_SHORT, _smoothed("kept", "v", "value", "o_custkey")], "o_custkey d:date f:value f:v_smooth", "smoothed"))
def short_series_smooth(spark, sf):
    value = F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)"))).cast("double") / 1000
    rows = views.table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("date")).agg(value.alias("value"))
    smooth = savgol(stage_table(with_position(rows, ["o_custkey"], "date", bucket_days=3660), "short"), ["value"], ["o_custkey"], "date", chunk_rows=CHUNK)
    return smooth.withColumnRenamed("value_smooth", "v_smooth")


def _lags_sql() -> str:
    lags = [f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in LAG_COLUMNS for k in LAGS]
    rolls = []
    for c in ROLL_COLUMNS:
        for n in (6, 24):
            rolls.append(f"avg({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_roll{n}_mean")
        rolls.append(f"coalesce(stddev_samp({c}) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS {c}_roll6_std")
    return f"wide AS (SELECT city, datetime, {', '.join(lags + rolls)} FROM base WINDOW w AS (PARTITION BY city ORDER BY datetime))"


LAG_NAMES = [f"{c}_lag{k}" for c in LAG_COLUMNS for k in LAGS]
ROLL_NAMES = [f"{c}_roll{n}" for c in ROLL_COLUMNS for n in ("6_mean", "24_mean", "6_std")]


@query("lags_and_rolls", "W-01 W-02 W-03", sql([BASE, _lags_sql()], "city t:datetime " + " ".join(f"f:{c}" for c in LAG_NAMES + ROLL_NAMES), "wide"))
def lags_rolls(spark, sf):
    rows = staged_base(spark, sf).drop("event_label")
    return lags_and_rolls(rows, chunk_rows=CHUNK).select("city", "datetime", *LAG_NAMES, *ROLL_NAMES)


@query("lead_target", "W-06", sql([BASE, "x AS (SELECT city, datetime, PM2_5, lead(PM2_5, 24) OVER (PARTITION BY city ORDER BY datetime) AS target_24h FROM base)"], "city t:datetime f:PM2_5 f:target_24h", "x"))
def lead_24(spark, sf):
    return lead_target(staged_base(spark, sf).select("city", "datetime", "PM2_5", POS, LEN), chunk_rows=CHUNK)


@query(
    "timeline",
    "W-07 P-11 P-15",
    sql(
        [
            BASE,
            "x AS (SELECT city, datetime, AQI, anomaly_score, avg(AQI) OVER (PARTITION BY city ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS AQI_6h FROM base "
            "WHERE city = 'Delhi' AND datetime >= TIMESTAMP '2024-01-04' AND datetime <= TIMESTAMP '2024-01-25')",
            "y AS (SELECT *, CASE WHEN AQI_6h < 0 THEN NULL WHEN AQI_6h <= 50 THEN 'Good' WHEN AQI_6h <= 100 THEN 'Satisfactory' WHEN AQI_6h <= 200 THEN 'Moderate' "
            "WHEN AQI_6h <= 300 THEN 'Poor' WHEN AQI_6h <= 500 THEN 'Very Poor' END AS band FROM x)",
        ],
        "city t:datetime f:AQI f:AQI_6h band f:anomaly_score",
        "y",
    ),
)
def timeline(spark, sf):
    return reports.report_timeline(drop_position(staged_base(spark, sf)), "Delhi", "2024-01-04", "2024-01-25", chunk_rows=CHUNK)


@query(
    "first_markers",
    "W-08",
    sql([BASE, "x AS (SELECT city, event_label, min(datetime) AS datetime, coalesce(min_by(coalesce(AQI, 50), datetime), 50) AS AQI FROM base WHERE event_label <> 'Normal' GROUP BY 1, 2)"], "city event_label t:datetime f:AQI", "x"),
)
def first_markers(spark, sf):
    return ev.event_markers(base(spark, sf))


_PREV = "prev AS (SELECT *, lag(event_label) OVER (PARTITION BY city ORDER BY datetime) AS before FROM base)"


@query(
    "run_markers",
    "W-08",
    sql([BASE, _PREV, "x AS (SELECT city, event_label, datetime, coalesce(AQI, 50) AS AQI FROM prev WHERE event_label <> 'Normal' AND (before IS NULL OR before <> event_label))"], "city event_label t:datetime f:AQI", "x"),
)
def run_markers(spark, sf):
    return ev.run_markers(staged_base(spark, sf), chunk_rows=CHUNK)


@query(
    "event_log",
    "W-09",
    sql(
        [
            BASE,
            _PREV,
            "runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_label THEN 1 ELSE 0 END) OVER (PARTITION BY city ORDER BY datetime) AS run FROM prev)",
            "x AS (SELECT city, event_label, min(datetime) AS \"start\", max(datetime) AS \"end\", count(*) AS hours, max(anomaly_score) AS peak_score FROM runs WHERE event_label <> 'Normal' GROUP BY city, event_label, run)",
        ],
        'city event_label t:"start" t:"end" n:hours f:peak_score',
        "x",
    ),
)
def event_log(spark, sf):
    return ev.event_log(staged_base(spark, sf), chunk_rows=CHUNK)


@query(
    "label_runs",
    "W-09",
    sql(
        "o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders), "
        "r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> o_orderstatus THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM o), "
        "x AS (SELECT o_custkey, o_orderstatus, min(o_orderdate) AS first_day, count(*) AS n FROM r GROUP BY o_custkey, o_orderstatus, run)",
        "o_custkey o_orderstatus t:first_day n:n",
        "x",
    ),
)
def label_runs(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    placed = stage_table(with_position(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"], bucket_days=3660), "orders")
    runs = ev.run_starts(placed, "o_orderstatus", ["o_custkey"], "o_orderdate", chunk_rows=4)
    return runs.groupBy("o_custkey", "o_orderstatus", "_run").agg(F.min("o_orderdate").alias("first_day"), F.count(F.lit(1)).alias("n")).drop("_run")


@query(
    "trailing_residual",
    "W-11",
    sql([DAILY, _DAYS, "x AS (SELECT city, date, PM2_5 - avg(PM2_5) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS PM2_5_residual FROM days)"], "city d:date f:PM2_5_residual", "x"),
)
def trailing(spark, sf):
    return trailing_residual(daily_series(spark, sf), "PM2_5", order="date", chunk_rows=CHUNK).select("city", "date", "PM2_5_residual")


@query(
    "centred_residual",
    "W-11",
    sql([BASE, "x AS (SELECT city, datetime, NO2 - avg(NO2) OVER (PARTITION BY city ORDER BY datetime ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS NO2_residual FROM base)"], "city t:datetime f:NO2_residual", "x"),
)
def centred(spark, sf):
    return centred_residual(staged_base(spark, sf).select("city", "datetime", "NO2", POS, LEN), "NO2", chunk_rows=CHUNK).select("city", "datetime", "NO2_residual")


def _momentum_sql() -> tuple[str, list[str]]:
    out, names = [], []
    for k in (1, 3, 7, 14, 30):
        names.append(f"PM2_5_lag{k}")
        out.append(f"lag(PM2_5, {k}) OVER w AS PM2_5_lag{k}")
    for n in (7, 14, 30):
        for fn, tail in (("avg", "mean"), ("stddev_samp", "std"), ("max", "max")):
            names.append(f"PM2_5_roll{n}_{tail}")
            out.append(f"coalesce({fn}(PM2_5) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) AS PM2_5_roll{n}_{tail}")
    return f"x AS (SELECT city, date, {', '.join(out)} FROM days WINDOW w AS (PARTITION BY city ORDER BY date))", names


_MOMENTUM, MOMENTUM_NAMES = _momentum_sql()


@query("daily_momentum", "W-12", sql([DAILY, _DAYS, _MOMENTUM], "city d:date " + " ".join(f"f:{n}" for n in MOMENTUM_NAMES), "x"))
def momentum(spark, sf):
    return daily_momentum(daily_series(spark, sf), chunk_rows=CHUNK).select("city", "date", *MOMENTUM_NAMES)


@query(
    "seasonal_naive",
    "W-13",
    sql(
        [
            DAILY,
            "m AS (SELECT city, date_trunc('month', date) AS ym, avg(PM2_5) AS v FROM daily GROUP BY 1, 2)",
            "s AS (SELECT city, month(ym) AS mo, avg(v) AS forecast, coalesce(stddev_samp(v), 0) AS sigma FROM m GROUP BY 1, 2)",
            "a AS (SELECT city, CAST(l + INTERVAL 1 MONTH * i AS DATE) AS \"month\" FROM (SELECT city, max(ym) AS l FROM m GROUP BY 1), (SELECT unnest(range(1, 7)) AS i))",
            'x AS (SELECT a.city, a."month", forecast, sigma, forecast - sigma AS lo68, forecast + sigma AS hi68, forecast - 1.96::DOUBLE * sigma AS lo95, forecast + 1.96::DOUBLE * sigma AS hi95 '
            'FROM a LEFT JOIN s ON s.city = a.city AND s.mo = month(a."month"))',
        ],
        'city d:"month" f:forecast f:sigma f:lo68 f:hi68 f:lo95 f:hi95',
        "x",
    ),
)
def seasonal_naive(spark, sf):
    return reports.seasonal_naive(views.daily(spark, sf), "PM2_5")
