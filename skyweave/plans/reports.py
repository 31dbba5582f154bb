"""Report tables over a results frame. Each takes a DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aqi import aqi_band
from ..functions.cleaning import clip, decimal_text
from ..functions.labels import CLASSES
from ..operators.features import over_chunks
from ..operators.series import densify, drop_position

NORMAL = CLASSES[0]
# Column groups of the reports.
MONTHLY_COLUMNS = ["PM2_5", "NO2", "SO2", "CO", "O3", "AOD", "AQI"]
FINGERPRINT_COLUMNS = ["PM2_5", "PM10", "NO2", "SO2", "CO", "O3", "AOD"]
CORRELATION_COLUMNS = ["PM2_5", "NO2", "SO2", "CO", "O3", "AOD", "AQI", "temp_c", "humidity", "wind_speed", "fire_count"]


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def _earliest(order: str) -> Column:
    """A number that falls as time rises, so that a maximum picks the first of equals."""
    t = F.col(order)
    day = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return -(day * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))


def select_range(df: DataFrame, city: str | None, start: str, end: str, order: str = "datetime") -> DataFrame:
    """Rows of a city from ``start`` to ``end``, both at midnight and both inclusive."""
    inside = (F.col(order) >= F.lit(start).cast("timestamp_ntz")) & (F.col(order) <= F.lit(end).cast("timestamp_ntz"))
    return df.filter(inside if city is None else (F.col("city") == city) & inside)


def with_display_label(df: DataFrame) -> DataFrame:
    """Known label if the table has one, else the predicted one, else Normal."""
    for name in ("event_label", "pred_label"):
        if name in df.columns:
            return df.withColumn("display_label", F.col(name))
    return df.withColumn("display_label", F.lit(NORMAL))


def report_timeline(df: DataFrame, city: str | None, start: str, end: str, **where) -> DataFrame:
    """AQI over the last six rows of the range, its band, forecast and anomaly score."""
    part = drop_position(select_range(df, city, start, end))  # the window restarts with the range
    smooth = over_chunks(part, lambda w: {"AQI_6h": F.avg("AQI").over(w.rowsBetween(-5, 0))}, before=5, **where)
    extra = _present(smooth, ["forecast_pm25_24h", "anomaly_score"])
    return smooth.select("city", "datetime", "AQI", "AQI_6h", aqi_band("AQI_6h").alias("band"), *extra)


def report_pollutant(df: DataFrame, pollutant: str) -> DataFrame:
    """Raw and smoothed value, and the value again where the row belongs to an event."""
    smooth = f"{pollutant}_smooth"
    shown = with_display_label(df)
    event = F.col("display_label") != NORMAL
    return shown.select(
        "city",
        "datetime",
        F.col(pollutant).alias("raw"),
        (F.col(smooth) if smooth in df.columns else F.lit(None).cast("double")).alias("smooth"),
        F.when(event, F.col("display_label")).alias("event"),
        F.when(event, F.col(pollutant)).alias("event_top"),
        F.when(event, F.lit(0.0)).alias("event_base"),
    )


def report_events(df: DataFrame) -> DataFrame:
    """Event rows with a size from AQI and the anomaly score as height."""
    shown = with_display_label(df).filter(F.col("display_label") != NORMAL)
    size = clip(F.coalesce(F.col("AQI"), F.lit(30.0)), 10, 500) if "AQI" in df.columns else F.lit(30.0)
    sized = shown.withColumn("size", size)
    height = F.col("anomaly_score") if "anomaly_score" in df.columns else F.col("size")
    return sized.select("city", "datetime", "display_label", "size", height.alias("height"))


def report_fingerprint(df: DataFrame, by: str = "display_label", least: int = 2) -> DataFrame:
    """Mean pollutants per group, divided by the group's largest mean."""
    cols = _present(df, FINGERPRINT_COLUMNS)
    means = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols]).filter(F.col("_n") >= least)
    top = F.greatest(*[F.col(c) for c in cols])
    scale = F.when(top > 0, top).otherwise(F.lit(1.0))
    return means.select(by, *[(F.col(c) / scale).alias(c) for c in cols])


def report_monthly(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Monthly mean per pollutant, scaled to 0..1 over the months of the series."""
    cols = _present(df, MONTHLY_COLUMNS)
    monthly = df.groupBy(*keys, F.date_format(order, "yyyy-MM").alias("month")).agg(*[F.avg(c).alias(c) for c in cols])
    long = monthly.unpivot([*keys, "month"], cols, "series", "mean")
    over = Window.partitionBy(*keys, "series")
    lo, hi = F.min("mean").over(over), F.max("mean").over(over)
    scaled = F.when(hi - lo > 0, (F.col("mean") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return long.select(*keys, "month", "series", "mean", scaled.alias("scaled"))


def report_correlation(df: DataFrame, cols: Sequence[str] = tuple(CORRELATION_COLUMNS)) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows that have both.

    One partial aggregate for all pairs. A pair with a constant side has no correlation;
    the built-in one would divide by zero.
    """
    cols = _present(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    def deviation(a: str, b: str) -> str:
        return f"stddev_pop(if(`{b}` IS NULL, NULL, `{a}`))"

    row = df.agg(*[F.expr(f"try_divide(covar_pop(`{a}`, `{b}`), {deviation(a, b)} * {deviation(b, a)})").alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for x, y in dict.fromkeys([(a, b), (b, a)]):
            cells.append(f"named_struct('a', '{x}', 'b', '{y}', 'corr', rint(`{a}|{b}` * 100) / 100)")
    return row.select(F.expr(f"inline(array({', '.join(cells)}))"))


def residual_columns(df: DataFrame, most: int | None = None) -> list[str]:
    """All residual columns; a chart may ask for the first few."""
    return [c for c in df.columns if c.endswith("_residual")][:most]


def report_residuals(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime", most: int | None = None) -> DataFrame:
    """Residual columns in long form."""
    cols = residual_columns(df, most)
    long = df.select(*keys, order, *cols).unpivot([*keys, order], cols, "series", "residual")
    return long.withColumn("series", F.regexp_replace("series", "_residual$", ""))


def report_fire_daily(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Fire pixels per day on a complete calendar: the sum over rows and the daily count.

    Hourly rows repeat the day's count, so the sum is that many times the count.
    """
    daily = df.groupBy(*keys, F.col(order).cast("date").alias("date")).agg(
        F.coalesce(F.sum("fire_count"), F.lit(0.0)).alias("fire_sum"),
        F.coalesce(F.max("fire_count"), F.lit(0.0)).alias("fire_count"),
    )
    return densify(daily, keys, "date", "1 day", zero=["fire_sum", "fire_count"])


def value_counts(df: DataFrame, col: str = "event_label", order: str = "datetime") -> DataFrame:
    """Rows per value, most frequent first, earlier first appearance before later."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen")


def report_kpis(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Key figures per series as display text.

    First by (series, label, day) with plain numbers, a hash aggregate that reduces the rows
    before the shuffle; then by label, then by series.
    """
    shown = with_display_label(df)
    days = shown.groupBy(*keys, "display_label", F.col(order).cast("date").alias("t")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(_earliest(order)).alias("seen"),
        F.max("AQI").alias("v"),
        F.sum("AQI").alias("aqi_sum"),
        F.count("AQI").alias("aqi_n"),
        F.max("NO2").alias("no2"),
        F.max("SO2").alias("so2"),
    )
    peak = F.when(F.col("v").isNotNull(), F.struct(F.col("v"), F.col("seen"), F.col("t")))
    first = days.groupBy(*keys, "display_label").agg(
        F.sum("n").alias("n"),
        F.max("seen").alias("seen"),
        F.max(peak).alias("peak"),
        F.sum("aqi_sum").alias("aqi_sum"),
        F.sum("aqi_n").alias("aqi_n"),
        F.max("no2").alias("no2"),
        F.max("so2").alias("so2"),
    )
    event = F.col("display_label") != NORMAL
    top = F.max(F.when(event, F.struct("n", "seen", "display_label")))
    figures = first.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(event, F.col("n"))), F.lit(0)).alias("events"),
        F.max("peak").alias("peak"),
        F.try_divide(F.sum("aqi_sum"), F.sum("aqi_n")).alias("mean"),
        top.alias("top"),
        F.max("no2").alias("no2"),
        F.max("so2").alias("so2"),
    )

    def text(c: Column, places: int) -> Column:
        return F.coalesce(decimal_text(c, places), F.lit("—"))

    return figures.select(
        *keys,
        F.format_number("events", 0).alias("events"),
        text(F.col("peak.v"), 0).alias("peak_aqi"),
        text(F.col("mean"), 0).alias("mean_aqi"),
        F.coalesce(F.date_format("peak.t", "dd MMM yyyy"), F.lit("—")).alias("worst_day"),
        F.coalesce(F.col("top.display_label"), F.lit("None")).alias("top_label"),
        text(F.col("no2"), 2).alias("peak_no2"),
        text(F.col("so2"), 2).alias("peak_so2"),
    )


def peak_rows(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Time and value of the first row with the largest AQI, per series."""
    peak = F.when(F.col("AQI").isNotNull(), F.struct(F.col("AQI").alias("v"), _earliest(order).alias("e"), F.col(order).alias("t")))
    best = df.groupBy(*keys).agg(F.max(peak).alias("p"))
    return best.select(*keys, F.col("p.t").alias(order), F.col("p.v").alias("AQI"))


def catalogue(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Distinct series with first and last day, sorted."""
    day = F.col(order).cast("date")
    return df.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).orderBy(*keys)


def coverage(daily: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Per series: distinct days, share of rows with PM2.5 and with AQI."""
    n = F.count(F.lit(1))
    return daily.groupBy(*keys).agg(
        F.countDistinct(F.col(order).cast("date")).alias("days"),
        (F.count("PM2_5") * 100 / n).alias("pm25_pct"),
        (F.count("AQI") * 100 / n).alias("aqi_pct"),
    )


def city_summary(df: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("AQI").alias("mean"), F.max("AQI").alias("max"), F.count("AQI").alias("n"))


def disaster_days(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime", label: str = "event_label") -> DataFrame:
    """Distinct days with an event row; a series without one has 0."""
    day = F.when(F.col(label) != NORMAL, F.col(order).cast("date"))
    return df.groupBy(*keys).agg(F.countDistinct(day).alias("disaster_days"))


def seasonal_pattern(df: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Mean AQI per calendar month."""
    return df.groupBy(*keys, F.month(order).alias("month")).agg(F.avg("AQI").alias("AQI"))


def seasonal_heatmap(df: DataFrame, order: str = "datetime") -> DataFrame:
    """One row per city, one column per calendar month."""
    months = [F.avg(F.when(F.month(order) == m, F.col("AQI"))).alias(f"m{m:02d}") for m in range(1, 13)]
    return df.groupBy("city").agg(*months)


def overlay(df: DataFrame, cities: Sequence[str], order: str = "datetime") -> DataFrame:
    """One row per date, one mean AQI column per city."""
    return df.groupBy(F.col(order).cast("date").alias("date")).agg(*[F.avg(F.when(F.col("city") == c, F.col("AQI"))).alias(c) for c in cities])


def event_bubbles(df: DataFrame, keys: Sequence[str] = ("city",), label: str = "event_label") -> DataFrame:
    """Hours and peak AQI per series and event type."""
    events = df.filter(F.col(label) != NORMAL)
    return events.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("hours"), F.max("AQI").alias("peak_aqi"))


def top_k(df: DataFrame, by: str, k: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest value (a bounded heap per task, then one merge)."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def seasonal_naive(
    daily: DataFrame,
    col: str,
    months: int = 6,
    keys: Sequence[str] = ("city",),
    order: str = "date",
) -> DataFrame:
    """Next months per series: mean of the same calendar month in earlier years, with bands.

    The 68 and 95 percent bands are 1 and 1.96 deviations of those monthly means.
    """
    keys = list(keys)
    month = F.trunc(F.col(order), "month")
    monthly = daily.groupBy(*keys, month.alias("_ym")).agg(F.avg(col).alias("_mean"))
    slots = monthly.groupBy(*keys, F.month("_ym").alias("_m")).agg(F.avg("_mean").alias("forecast"), F.coalesce(F.stddev_samp("_mean"), F.lit(0.0)).alias("sigma"))
    last = monthly.groupBy(*keys).agg(F.max("_ym").alias("_last"))
    ahead = last.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.lit(months)), lambda i: F.add_months("_last", i))).alias("month"))
    joined = ahead.withColumn("_m", F.month("month")).join(slots, [*keys, "_m"], "left")
    f, s = F.col("forecast"), F.col("sigma")
    return joined.select(
        *keys, "month", "forecast", "sigma", (f - s).alias("lo68"), (f + s).alias("hi68"), (f - 1.96 * s).alias("lo95"), (f + 1.96 * s).alias("hi95")
    )
