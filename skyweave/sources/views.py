"""Deterministic views that turn the supplied tables into air-quality series.

Values are summed as decimals, so a mean does not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import densify
from ..session import stage_table
from .reshape import CITIES

CITY_NAMES = [c[0] for c in CITIES]
PIXEL_BANDS = ["NO2", "SO2", "CO", "O3", "AOD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean(value: Column, when: Column | None = None) -> Column:
    value = value.cast("decimal(18,2)")
    value = value if when is None else F.when(when, value)
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


def by_city(user: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CITY_NAMES]), (user % 3 + 1).cast("int"))


def by_station(user: Column) -> Column:
    return F.format_string("S%02d", user % 30)


def sparse_hourly(spark: SparkSession, sf_dir: str, key=by_city) -> DataFrame:
    """Readings of ``events`` by (city, hour); only hours with an event."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    # hour of a wall-clock time, without a detour through the session time zone
    hour = F.make_timestamp_ntz(F.year("ts"), F.month("ts"), F.day("ts"), F.hour("ts"), F.lit(0), F.lit(0))
    level = F.sum(k).cast("double") / F.count(k)
    base = (
        ev.groupBy(key(F.col("user_id")).alias("city"), hour.alias("datetime"))
        .agg(
            _mean(F.col("value"), kind == "click").alias("NO2"),
            _mean(F.col("value"), kind == "error").alias("SO2"),
            (_mean(F.col("value"), kind == "purchase") / 20).alias("CO"),
            _mean(F.col("value"), kind == "signup").alias("O3"),
            (_mean(F.col("value"), kind == "view") / 100).alias("AOD"),
            F.count_if((kind == "error") & (F.col("value") > 100)).cast("double").alias("fire_count"),
            level.alias("k"),
        )
    )
    k = F.col("k")
    return base.select(
        "city",
        "datetime",
        (k / 2).alias("temp_c"),
        k.alias("humidity"),
        (k / 10).alias("wind_speed"),
        (k * 3.6).alias("wind_dir"),
        (k / 50).alias("precip"),
        (k / 5 + 1000).alias("pressure"),
        (k / 4).alias("dewpoint"),
        k.alias("cloud_pct"),
        (k * 100).alias("visibility_m"),
        "NO2", "SO2", "CO", "O3", "AOD", "fire_count",
    )


def hourly(spark: SparkSession, sf_dir: str, keep_position: bool = False) -> DataFrame:
    """Three cities on a complete hourly grid."""
    return densify(sparse_hourly(spark, sf_dir), stage=stage_table, keep_position=keep_position)


def stations(spark: SparkSession, sf_dir: str, keep_position: bool = False) -> DataFrame:
    """Thirty stations on a complete hourly grid, with long gaps."""
    return densify(sparse_hourly(spark, sf_dir, by_station), stage=stage_table, keep_position=keep_position)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five daily series over several years; days without an order are absent."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    key = [F.col("o_orderpriority").alias("city"), F.col("o_orderdate").cast("date").alias("date")]
    fine = orders.groupBy(*key).agg((_mean(F.col("o_totalprice")) / 1000).alias("PM2_5"))
    coarse = (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .groupBy(*key)
        .agg((_mean(F.col("l_extendedprice")) / 200).alias("PM10"), _mean(F.col("l_quantity")).alias("NO2"))
    )
    return fine.join(coarse, ["city", "date"], "left")


def orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily PM2_5 and SO2 by date, from orders; SO2 only where the day has an urgent one."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (_mean(F.col("o_totalprice")) / 1000).alias("PM2_5"),
        (_mean(F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT") / 5000).alias("SO2"),
    )


def items_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily PM2_5, SO2 and NO2 by ship date, from lineitem."""
    i = table(spark, sf_dir, "lineitem")
    return i.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        (_mean(F.col("l_extendedprice")) / 300).alias("PM2_5"),
        (_mean(F.col("l_extendedprice"), F.col("l_returnflag") == "R") / 1500).alias("SO2"),
        _mean(F.col("l_quantity")).alias("NO2"),
    )


def _literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows as an inline table, whose size the optimizer knows."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def cities(spark: SparkSession) -> DataFrame:
    return _literal(spark, CITIES, "city, lat, lon, buffer_km").withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel observations around the cities, from lineitem; whole tenths of a degree in step."""
    i = table(spark, sf_dir, "lineitem")

    def of_city(col: int) -> Column:
        return F.element_at(F.array(*[F.lit(c[col]) for c in CITIES]), (F.col("l_suppkey") % 3 + 1).cast("int"))

    return i.select(
        F.element_at(F.array(*[F.lit(b) for b in PIXEL_BANDS]), (F.col("l_linenumber") % 5 + 1)).alias("band"),
        F.col("l_shipdate").alias("image_ts"),
        (of_city(1) + (F.col("l_partkey") % 13 - 6) / 10).alias("lat"),
        (of_city(2) + (F.col("l_orderkey") % 13 - 6) / 10).alias("lon"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_linenumber") + 3).alias("mask"),
    )


# Event windows over both kinds of series; the second overlaps the first and
# wins there, the sixth has no data.
EVENT_WINDOWS = [
    (1, 1, "Delhi", "2024-01-05 00:00:00", "2024-01-09 00:00:00", "Fire", "Delhi smoke"),
    (2, 2, "Delhi", "2024-01-08 06:00:00", "2024-01-10 00:00:00", "Gas", "Delhi leak"),
    (3, 3, "Jaipur", "2024-01-12 00:00:00", "2024-01-15 00:00:00", "Dust", "Jaipur dust"),
    (4, 4, "Vizag", "2024-01-20 00:00:00", "2024-01-22 00:00:00", "Industrial", "Vizag plant"),
    (5, 5, "Vizag", "2024-01-24 00:00:00", "2024-01-25 12:30:00", "Gas", "Vizag leak"),
    (6, 6, "Delhi", "2023-06-01 00:00:00", "2023-06-03 00:00:00", "Dust", "before the data"),
    (7, 7, "1-URGENT", "1996-03-01 00:00:00", "1996-03-20 00:00:00", "Fire", "series one"),
    (8, 8, "5-LOW", "1999-07-01 00:00:00", "1999-07-15 00:00:00", "Dust", "series five"),
]


def event_windows(spark: SparkSession) -> DataFrame:
    rows = _literal(spark, EVENT_WINDOWS, "id, seq, city, s, e, type, name")
    return rows.select(
        "id", "seq", "city", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"), "type", "name"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, predictions and class probabilities by integer arithmetic on ``events``."""
    ev = table(spark, sf_dir, "events")
    label = F.when(F.col("user_id") % 10 < 6, 0).otherwise((F.col("user_id") % 10 - 5)).cast("int")
    wrong = F.col("event_id") % 7 == 0
    parts = [(F.col("event_id") * (7 + 4 * c) + F.col("user_id") * 13) % 97 + F.when(label == c, 40).otherwise(1) for c in range(5)]
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    return ev.select(
        F.col("event_id").alias("row_id"),
        label.alias("label"),
        F.when(wrong, (label + F.col("event_id") % 5) % 5).otherwise(label).cast("int").alias("pred"),
        F.array(*[p / total for p in parts]).alias("prob"),
        (F.col("event_id") * 7919 + 104729) .alias("mix"),
        (F.col("event_id") % 5).cast("int").alias("fold"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per sensor event: pollutants scaled into the range of the rules."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    u = F.col("user_id") % 8
    return ev.select(
        F.col("event_id").alias("reading_id"),
        by_city(F.col("user_id")).alias("city"),
        F.col("ts"),
        (v / 2 + k).alias("NO2"),
        (v * (u + 1) / 2).alias("SO2"),
        (k / 12.5 + u / 4).alias("CO"),
        (k * 1.5).alias("O3"),
        (v * (k + 10) / 50).alias("PM2_5"),
        (v * 4 + k).alias("PM10"),
        (v / 100).alias("AOD"),
        (k % 12).cast("double").alias("fire_count"),
        (k / 10).alias("wind_speed"),
        (k * 3.6).alias("wind_dir"),
        F.hour("ts").alias("hour"),
        F.month("ts").alias("month"),
        (F.col("user_id") % 3 != 0).alias("is_spike"),
    )
