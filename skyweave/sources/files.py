"""File readers and writers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import clean_doubles

# Weather service field -> column.
WEATHER_FIELDS = {
    "temperature_2m": "temp_c",
    "relativehumidity_2m": "humidity",
    "windspeed_10m": "wind_speed",
    "winddirection_10m": "wind_dir",
    "precipitation": "precip",
    "surface_pressure": "pressure",
    "dewpoint_2m": "dewpoint",
    "cloudcover": "cloud_pct",
    "visibility": "visibility_m",
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A stage table; a declared schema saves the footer read and pins the types."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return clean_doubles(reader.parquet(path))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("city",), max_rows_per_file: int = 5_000_000) -> None:
    """Overwrite a stage table, one folder per partition value.

    Nothing is shuffled for the layout: a key with a third of the rows would otherwise be
    written by one task. Files are bounded in rows instead.
    """
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file).partitionBy(*partition_by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, timestamp_format: str | None = None, date_format: str | None = None) -> DataFrame:
    """CSV with a header; date columns are parsed by the declared types."""
    reader = spark.read.schema(schema).option("header", True)
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def weather_schema() -> str:
    fields = ", ".join(f"{name}: array<double>" for name in WEATHER_FIELDS)
    return f"struct<hourly: struct<time: array<string>, {fields}>>"


def explode_weather(docs: DataFrame, doc: str = "doc", keep: Sequence[str] = ("city",)) -> DataFrame:
    """JSON documents of parallel arrays to one row per hour, columns renamed."""
    parsed = docs.select(*keep, F.from_json(doc, weather_schema())["hourly"].alias("h"))
    arrays = [F.col(f"h.{n}").alias(n) for n in ("time", *WEATHER_FIELDS)]
    rows = parsed.select(*keep, *arrays).select(*keep, F.inline(F.arrays_zip("time", *WEATHER_FIELDS)))
    return rows.select(
        *keep,
        F.col("time").cast("timestamp_ntz").alias("datetime"),
        *[F.col(src).alias(dst) for src, dst in WEATHER_FIELDS.items()],
    )


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Landed weather responses, one JSON document a file, the city being the folder."""
    docs = spark.read.text(path, wholetext=True)
    city = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return explode_weather(docs.select(F.url_decode(city).alias("city"), F.col("value").alias("doc")))


def read_stations(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """Station CSV files under one folder per city; adds city and station from the path."""
    rows = read_csv(spark, glob, schema).select("*", F.col("_metadata.file_path").alias("_path"))
    folder = F.regexp_extract("_path", r"(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    return rows.select(
        F.url_decode(folder).alias("city"),
        F.url_decode(F.regexp_extract("_path", r"([^/]+?)(?:\.csv)?$", 1)).alias("station"),
        *[c for c in rows.columns if c != "_path"],
    )


def station_city_means(stations: DataFrame, cols: Sequence[str], order: str = "datetime") -> DataFrame:
    """City means per day over all readings of all its stations."""
    return stations.groupBy("city", F.col(order).cast("date").alias("date")).agg(*[F.avg(c).alias(c) for c in cols])
