"""Registered queries: streaming jobs over the supplied tables, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import score_columns
from ..sources import views
from ..streaming import jobs
from .oracle_views import AQI
from .queries_clean import _READINGS
from .queries_models import SCORE_COLUMNS, SCORE_SQL, modelled
from .registry import query, sql

LATE_MINUTES = 10
DAY_MS = 86_400_000


class _StreamSession:
    """Hands out streaming readers where the views expect batch ones."""

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path: str):
        schema = self._spark.read.parquet(path).schema
        # a streaming source wants a folder or a pattern: match exactly this file
        return jobs.read_stream(self._spark, path.replace(".parquet", "[.]parquet"), schema)


def readings_stream(spark, sf):
    return views.readings(_StreamSession(spark), sf)


@query("stream_scores", "ST-1", SCORE_SQL)
def stream_scores(spark, sf):
    return jobs.drain(score_columns(modelled(readings_stream(spark, sf))).select(*SCORE_COLUMNS), "scores")


def _index_sql(unit: str) -> str:
    return sql(
        [
            _READINGS,
            f"m AS (SELECT city, date_trunc('{unit}', ts) AS datetime, avg(PM2_5) AS PM2_5, avg(PM10) AS PM10, count(*) AS readings FROM readings GROUP BY 1, 2)",
            f"x AS (SELECT *, {AQI} AS AQI FROM m)",
        ],
        "city t:datetime f:PM2_5 f:PM10 n:readings f:AQI",
        "x",
    )


def _index(spark, sf, window: str):
    rows, end = jobs.with_end(readings_stream(spark, sf))
    index = jobs.windowed_index(rows, window=window, late=f"{LATE_MINUTES} minutes")
    return jobs.drain(index.drop("band"), "index", end)


@query("stream_hourly_index", "ST-2", _index_sql("hour"))
def stream_hourly_index(spark, sf):
    return _index(spark, sf, "1 hour")


@query("stream_daily_index", "ST-2", _index_sql("day"))
def stream_daily_index(spark, sf):
    return _index(spark, sf, "1 day")


_HISTORY = """
h AS (
  SELECT reading_id, station, ts, SO2, lag(SO2, 1) OVER w AS SO2_lag1, lag(SO2, 6) OVER w AS SO2_lag6, lag(SO2, 24) OVER w AS SO2_lag24,
         avg(SO2) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS SO2_roll6_mean, avg(SO2) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS SO2_roll24_mean,
         coalesce(stddev_samp(SO2) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS SO2_roll6_std
  FROM (SELECT r.*, printf('S%02d', e.user_id % 30) AS station FROM readings r JOIN events e ON e.event_id = r.reading_id)
  WINDOW w AS (PARTITION BY station ORDER BY ts, reading_id))"""


@query(
    "stream_history",
    "ST-3 W-01 W-02 W-03",
    sql([_READINGS, _HISTORY], "reading_id station f:SO2 f:SO2_lag1 f:SO2_lag6 f:SO2_lag24 f:SO2_roll6_mean f:SO2_roll24_mean f:SO2_roll6_std", "h"),
)
def stream_history(spark, sf):
    events = _StreamSession(jobs.stream_session(spark)).parquet(f"{sf}/events.parquet")
    rows = events.select(
        F.col("event_id").alias("reading_id"),
        views.by_station(F.col("user_id")).alias("station"),
        "ts",
        (F.col("value") * (F.col("user_id") % 8 + 1) / 2).alias("SO2"),
    )
    rows, end = jobs.with_end(rows)
    featured = jobs.history_features(rows, ["SO2"], ["station"], late=f"{LATE_MINUTES} minutes", slice_ms=DAY_MS)
    path = jobs.drain_counted(featured, "history", end).path
    return spark.read.schema(featured.schema).parquet(path).withColumnRenamed("id", "reading_id").drop("t")
