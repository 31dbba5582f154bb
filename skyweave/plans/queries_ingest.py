"""Registered queries: sources, sinks and ingest reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import lenient_double
from ..operators.decompose import daily_means
from ..operators.series import densify
from ..session import shared_path
from ..sources import files, reshape, views
from .oracle_views import DAILY, HOURLY, ITEMS_SOURCE, ORDERS_SOURCE, PIXELS, RAW, STATIONS
from .registry import query, sql
from .reports import coverage

# The whole span of the tables, which date_range cuts.
PIXEL_RANGE = ("1990-01-01", "2010-01-01")
F_RAW = " ".join(f"f:{c}" for c in RAW)


@query("parquet_round_trip", "S-01 S-02", sql(DAILY, "city d:date f:PM2_5 f:PM10 f:NO2", "daily"))
def parquet_round_trip(spark, sf):
    path = shared_path(spark, "daily")
    files.write_table(views.daily(spark, sf), path)
    schema = "date date, PM2_5 double, PM10 double, NO2 double, city string"
    return files.read_table(spark, path, schema).select("city", "date", "PM2_5", "PM10", "NO2")


@query("csv_round_trip", "S-03 S-04", sql(ORDERS_SOURCE, "d:date f:PM2_5 f:SO2", "orders_source"))
def csv_round_trip(spark, sf):
    path = shared_path(spark, "csv")
    files.write_csv(views.orders_source(spark, sf), path)
    return files.read_csv(spark, path, "date date, PM2_5 double, SO2 double", date_format="yyyy-MM-dd")


@query(
    "weather_json",
    "S-05",
    sql(HOURLY, "city t:datetime " + " ".join(f"f:{c}" for c in files.WEATHER_FIELDS.values()), "hourly"),
)
def weather_json(spark, sf):
    # one document per city and day: parallel arrays of at most 24 hours
    fields = [F.col(dst).alias(src) for src, dst in files.WEATHER_FIELDS.items()]
    hour = F.struct(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm").alias("time"), *fields)
    day = views.hourly(spark, sf).groupBy("city", F.col("datetime").cast("date").alias("date")).agg(F.sort_array(F.collect_list(hour)).alias("h"))
    arrays = F.struct(*[F.col(f"h.{n}").alias(n) for n in ("time", *files.WEATHER_FIELDS)])
    docs = day.select("city", F.to_json(F.struct(arrays.alias("hourly")), {"ignoreNullFields": "false"}).alias("doc"))
    return files.explode_weather(docs)


@query(
    "date_range",
    "S-06",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
)
def date_range(spark, sf):
    return reshape.between_dates(views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "1996-01-01", "1997-01-01", "o_orderdate")


@query(
    "region_filter",
    "S-07",
    f"WITH {PIXELS} SELECT city, band, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM inside GROUP BY 1, 2",
)
def region_filter(spark, sf):
    inside = reshape.within_regions(views.pixels(spark, sf), views.cities(spark))
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return inside.groupBy("city", "band").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


_PIXEL_DAILY = f"""
pixel AS (
  SELECT city, CAST(image_ts AS DATE) AS date, band, floor(lat / (10000.0::DOUBLE / 1000 / 111.32::DOUBLE)) AS py,
         floor(lon / (10000.0::DOUBLE / 1000 / 111.32::DOUBLE)) AS px, avg(value) AS value
  FROM inside WHERE image_ts >= TIMESTAMP '{PIXEL_RANGE[0]}' AND image_ts < TIMESTAMP '{PIXEL_RANGE[1]}' GROUP BY ALL),
pixel_daily AS (SELECT city, date, band, avg(value) AS value FROM pixel GROUP BY 1, 2, 3)"""


def _pixel_daily(spark, sf):
    return reshape.pixel_daily_mean(views.pixels(spark, sf), views.cities(spark), *PIXEL_RANGE, by=["band"])


@query("pixel_daily", "S-08", sql([PIXELS, _PIXEL_DAILY], "city d:date band f:value", "pixel_daily WHERE value IS NOT NULL"))
def pixel_daily(spark, sf):
    return _pixel_daily(spark, sf)


_FIRES = f"""
fires AS (
  SELECT city, CAST(image_ts AS DATE) AS date, CAST(count(*) FILTER (WHERE mask >= 7) AS DOUBLE) AS fire_count
  FROM inside WHERE image_ts >= TIMESTAMP '{PIXEL_RANGE[0]}' AND image_ts < TIMESTAMP '{PIXEL_RANGE[1]}' GROUP BY 1, 2)"""


def _fires(spark, sf):
    masks = views.pixels(spark, sf).drop("value").withColumnRenamed("mask", "value")
    return reshape.fire_daily(masks, views.cities(spark), *PIXEL_RANGE)


@query("fire_daily", "S-09", sql([PIXELS, _FIRES], "city d:date f:fire_count", "fires"))
def fire_daily(spark, sf):
    return _fires(spark, sf)


@query(
    "lenient_parse",
    "S-10",
    sql("x AS (SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 0.0::DOUBLE ELSE value END AS parsed FROM events)", "event_id f:parsed", "x"),
)
def lenient_parse(spark, sf):
    text = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "nan").otherwise(F.col("value").cast("string"))
    return views.table(spark, sf, "events").select("event_id", lenient_double(text).alias("parsed"))


@query(
    "date_chunks",
    "S-11",
    "SELECT datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 180 AS chunk, count(*) AS n_rows, "
    "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS last_date FROM orders GROUP BY 1",
)
def date_chunks(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderdate")
    return reshape.chunk_summary(reshape.assign_chunks(orders, "1995-01-01", 180, "o_orderdate"), order="o_orderdate")


@query(
    "first_per_day",
    "S-12",
    "SELECT o_orderpriority, strftime(date, '%Y-%m-%d') AS date, o_orderkey, o_totalprice FROM ("
    "SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice, "
    "row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def first_per_day(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", "o_totalprice")
    return reshape.keep_first(rows, ["o_orderpriority", "date"], ["o_orderkey"])


_SCALE = "CASE band WHEN 'NO2' THEN 1e6::DOUBLE * 46.0055::DOUBLE WHEN 'SO2' THEN 1e6::DOUBLE * 64.066::DOUBLE WHEN 'CO' THEN 1e3::DOUBLE * 28.01::DOUBLE WHEN 'O3' THEN 1e6::DOUBLE * 48.0::DOUBLE ELSE 1.0::DOUBLE END"


@query(
    "unit_conversion",
    "S-13",
    sql(
        [
            "b AS (SELECT *, ['NO2', 'SO2', 'CO', 'O3', 'AOD'][l_linenumber % 5 + 1] AS band FROM lineitem)",
            f"x AS (SELECT l_orderkey, l_linenumber, l_partkey, band AS pollutant, l_extendedprice / 1000000000.0::DOUBLE * {_SCALE} AS value FROM b)",
        ],
        "l_orderkey n:l_linenumber l_partkey pollutant f:value",
        "x",
    ),
)
def unit_conversion(spark, sf):
    band = F.element_at(F.array(*[F.lit(b) for b in views.PIXEL_BANDS]), F.col("l_linenumber") % 5 + 1)
    long = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", band.alias("pollutant"), (F.col("l_extendedprice") / 1e9).alias("value")
    )
    return reshape.convert_units(long)


_ASSEMBLED = """
wide AS (
  SELECT city, date, max(value) FILTER (WHERE band = 'NO2') AS NO2, max(value) FILTER (WHERE band = 'SO2') AS SO2,
         max(value) FILTER (WHERE band = 'CO') AS CO, max(value) FILTER (WHERE band = 'O3') AS O3,
         max(value) FILTER (WHERE band = 'AOD') AS AOD
  FROM pixel_daily GROUP BY 1, 2)"""
_WIDE = "city d:date f:NO2 f:SO2 f:CO f:O3 f:AOD"


def _assembled(spark, sf):
    return reshape.assemble_daily(_pixel_daily(spark, sf).withColumnRenamed("band", "pollutant"), views.PIXEL_BANDS)


@query("daily_assembly", "S-14", sql([PIXELS, _PIXEL_DAILY, _ASSEMBLED], _WIDE, "wide"))
def daily_assembly(spark, sf):
    return _assembled(spark, sf)


@query(
    "daily_full_join",
    "S-14 J-02",
    sql(
        [ORDERS_SOURCE, ITEMS_SOURCE, "j AS (SELECT coalesce(a.date, b.date) AS date, a.PM2_5 AS a_pm, b.PM2_5 AS b_pm FROM orders_source a FULL JOIN items_source b ON a.date = b.date)"],
        "d:date f:a_pm f:b_pm",
        "j",
    ),
)
def daily_full_join(spark, sf):
    a = views.orders_source(spark, sf).select("date", F.col("PM2_5").alias("a_pm"))
    b = views.items_source(spark, sf).select("date", F.col("PM2_5").alias("b_pm"))
    return reshape.full_join_all([a, b], ["date"])


@query(
    "fire_attach",
    "S-15 J-03",
    sql(
        [PIXELS, _PIXEL_DAILY, _ASSEMBLED, _FIRES, "j AS (SELECT w.*, coalesce(f.fire_count, 0) AS fire_count FROM wide w LEFT JOIN fires f ON w.city = f.city AND w.date = f.date)"],
        _WIDE + " f:fire_count",
        "j",
    ),
)
def fire_attach(spark, sf):
    return reshape.attach_fires(_assembled(spark, sf), _fires(spark, sf))


@query(
    "daily_to_hourly",
    "S-16 J-01",
    sql(
        [
            HOURLY,
            "d AS (SELECT city, CAST(datetime AS DATE) AS date, avg(NO2) AS NO2_day, avg(SO2) AS SO2_day FROM hourly GROUP BY 1, 2)",
            "j AS (SELECT h.city, h.datetime, h.temp_c, d.NO2_day, d.SO2_day FROM hourly h LEFT JOIN d ON h.city = d.city AND CAST(h.datetime AS DATE) = d.date)",
        ],
        "city t:datetime f:temp_c f:NO2_day f:SO2_day",
        "j",
    ),
)
def daily_to_hourly(spark, sf):
    hourly = views.hourly(spark, sf)
    daily = daily_means(hourly, ["NO2", "SO2"], fill=False).select("city", "date", F.col("NO2").alias("NO2_day"), F.col("SO2").alias("SO2_day"))
    return reshape.daily_onto_hourly(hourly.select("city", "datetime", "temp_c"), daily)


@query(
    "stacked",
    "S-17",
    sql(
        [HOURLY, STATIONS, "u AS (SELECT city, datetime, NO2, SO2 FROM hourly UNION ALL SELECT city, datetime, NO2, NULL FROM stations)"],
        "city t:datetime f:NO2 f:SO2",
        "u",
    ),
)
def stacked(spark, sf):
    a = views.hourly(spark, sf).select("city", "datetime", "NO2", "SO2")
    return reshape.stack([a, views.stations(spark, sf).select("city", "datetime", "NO2")])


@query("station_grid", "S-18", sql(STATIONS, f"city t:datetime {F_RAW}", "stations"))
def station_grid(spark, sf):
    return views.stations(spark, sf)


@query(
    "daily_grid",
    "S-18",
    sql(
        [
            DAILY,
            "s AS (SELECT city, unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS date FROM daily GROUP BY city)",
            "g AS (SELECT s.city, CAST(s.date AS DATE) AS date, d.PM2_5, coalesce(d.NO2, 0) AS NO2 FROM s LEFT JOIN daily d ON d.city = s.city AND d.date = CAST(s.date AS DATE))",
        ],
        "city d:date f:PM2_5 f:NO2",
        "g",
    ),
)
def daily_grid(spark, sf):
    return densify(views.daily(spark, sf).select("city", "date", "PM2_5", "NO2"), order="date", step="1 day", zero=["NO2"])


@query(
    "source_priority",
    "S-19",
    sql(
        [
            ORDERS_SOURCE,
            ITEMS_SOURCE,
            "m AS (SELECT coalesce(a.date, b.date) AS date, coalesce(a.PM2_5, b.PM2_5) AS PM2_5, coalesce(a.SO2, b.SO2) AS SO2, b.NO2 AS NO2 FROM orders_source a FULL JOIN items_source b ON a.date = b.date)",
        ],
        "d:date f:PM2_5 f:SO2 f:NO2",
        "m",
    ),
)
def source_priority(spark, sf):
    return reshape.priority_merge([views.orders_source(spark, sf), views.items_source(spark, sf)], ["date"], ["PM2_5", "SO2", "NO2"])


@query(
    "station_means",
    "S-20",
    sql(
        "m AS (SELECT o_orderpriority AS city, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)",
        "city d:date f:value",
        "m",
    ),
)
def station_means(spark, sf):
    path = shared_path(spark, "stations")
    rows = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("place"), F.col("o_orderdate").alias("datetime"), F.col("o_totalprice").alias("value"))
    rows.write.option("header", True).partitionBy("place").csv(path)
    read = files.read_stations(spark, f"{path}/*/*.csv", "datetime timestamp_ntz, value double")
    return files.station_city_means(read, ["value"])


@query(
    "coverage_report",
    "S-22",
    sql(
        [
            HOURLY,
            "c AS (SELECT city, count(DISTINCT CAST(datetime AS DATE)) AS days, count(AOD) * 100 / count(*) AS pm25_pct, count(NO2) * 100 / count(*) AS aqi_pct FROM hourly GROUP BY 1)",
        ],
        "city n:days f:pm25_pct f:aqi_pct",
        "c",
    ),
)
def coverage_report(spark, sf):
    return coverage(views.hourly(spark, sf).select("city", "datetime", F.col("AOD").alias("PM2_5"), F.col("NO2").alias("AQI")))
