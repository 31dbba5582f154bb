"""Ingest reshaping: from observations to one hourly table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factor to micrograms per cubic metre (milligrams for CO).
UNIT_SCALES = {"NO2": 1e6 * 46.0055, "SO2": 1e6 * 64.066, "CO": 1e3 * 28.01, "O3": 1e6 * 48.0}
# Monitored places.
CITIES = [
    ("Delhi", 28.7041, 77.1025, 50),
    ("Jaipur", 26.9124, 75.7873, 50),
    ("Vizag", 17.6868, 83.2185, 50),
]
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def between_dates(df: DataFrame, start: str, end: str, order: str = "datetime") -> DataFrame:
    """Rows with start <= time < end."""
    return df.filter((F.col(order) >= F.lit(start).cast("timestamp_ntz")) & (F.col(order) < F.lit(end).cast("timestamp_ntz")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_regions(obs: DataFrame, cities: DataFrame, cell_degrees: float = 1.0) -> DataFrame:
    """Observations within ``buffer_km`` of a city, once per city they belong to.

    Both sides are put on a grid of degree cells, a city on all cells its circle can touch,
    which makes this an equi-join with the distance as residual test.
    """
    reach = F.col("buffer_km") / KM_PER_DEGREE
    # a circle reaches furthest in longitude at the latitude nearest the pole
    polar = F.least(F.abs(F.col("c_lat")) + reach, F.lit(89.0))
    lon_reach = reach / F.cos(F.radians(polar))

    around = round(360 / cell_degrees)  # cells meet again at the date line

    def cells(centre: Column, width: Column) -> Column:
        return F.sequence(F.floor((centre - width) / cell_degrees).cast("int"), F.floor((centre + width) / cell_degrees).cast("int"))

    places = cities.select("city", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "buffer_km")
    wrapped = F.array_distinct(F.transform(cells(F.col("c_lon"), F.least(lon_reach, F.lit(180.0))), lambda x: F.pmod(x, F.lit(around))))
    gridded = places.withColumn("_y", F.explode(cells(F.col("c_lat"), reach))).withColumn("_x", F.explode(wrapped))
    placed = obs.withColumns({"_y": F.floor(F.col("lat") / cell_degrees).cast("int"), "_x": F.pmod(F.floor(F.col("lon") / cell_degrees).cast("int"), F.lit(around))})
    near = placed.join(gridded, ["_y", "_x"]).filter(haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) <= F.col("buffer_km"))
    return near.select("city", *obs.columns)


def pixel_daily_mean(obs: DataFrame, cities: DataFrame, start: str, end: str, grid_m: float = 10_000, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the day's images per pixel, then mean over the pixels of a region.

    Not the flat mean: a pixel seen often counts once. Days without a value are absent.
    """
    step = grid_m / 1000 / KM_PER_DEGREE
    inside = within_regions(between_dates(obs, start, end, "image_ts"), cities)
    pixel = {"_py": F.floor(F.col("lat") / step), "_px": F.floor(F.col("lon") / step), "date": F.col("image_ts").cast("date")}
    per_pixel = inside.withColumns(pixel).groupBy("city", "date", *by, "_py", "_px").agg(F.avg("value").alias("value"))
    return per_pixel.groupBy("city", "date", *by).agg(F.avg("value").alias("value")).filter(F.col("value").isNotNull())


def fire_daily(obs: DataFrame, cities: DataFrame, start: str, end: str, min_mask: int = 7) -> DataFrame:
    """Fire pixels per city and day: mask values of at least ``min_mask``."""
    inside = within_regions(between_dates(obs, start, end, "image_ts"), cities)
    hit = F.coalesce((F.col("value") >= min_mask).cast("int"), F.lit(0))
    return inside.groupBy("city", F.col("image_ts").cast("date").alias("date")).agg(F.sum(hit).cast("double").alias("fire_count"))


def assign_chunks(df: DataFrame, start: str, days: int, order: str = "date") -> DataFrame:
    """Add chunk: number of the ``days``-long piece of the range a row falls in."""
    return df.withColumn("chunk", F.floor(F.datediff(F.col(order).cast("date"), F.lit(start).cast("date")) / days).cast("int"))


def chunk_summary(df: DataFrame, value: str = "value", order: str = "date") -> DataFrame:
    return df.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first_date"), F.max(order).alias("last_date"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be unique within a key.

    An aggregate, so rows of a hot key are reduced before the shuffle; dropDuplicates would
    keep an arbitrary row.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def convert_units(long: DataFrame, scales: dict[str, float] = UNIT_SCALES) -> DataFrame:
    """Multiply ``value`` by the factor of its ``pollutant``; no factor leaves it."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in scales.items()))
    return long.withColumn("value", F.col("value") * F.coalesce(F.try_element_at(table, F.col("pollutant")), F.lit(1.0)))


def assemble_daily(long: DataFrame, pollutants: Sequence[str], keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """(keys, pollutant, value) to one column per pollutant: a full outer join in one shuffle."""
    wide = [F.max(F.when(F.col("pollutant") == p, F.col("value"))).alias(p) for p in pollutants]
    return long.filter(F.col("pollutant").isin(list(pollutants))).groupBy(*keys).agg(*wide)


def full_join_all(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of several tables on the same keys."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), frames)


def attach_fires(daily: DataFrame, fires: DataFrame, keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Left join of fire counts; a day without one has 0."""
    return daily.join(fires, list(keys), "left").fillna(0.0, ["fire_count"])


def daily_onto_hourly(hourly: DataFrame, daily: DataFrame, keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """Every hourly row gets the daily values of its date."""
    dated = hourly.withColumn("date", F.col(order).cast("date"))
    return dated.join(daily, [*keys, "date"], "left").drop("date")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def priority_merge(sources: Sequence[DataFrame], keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key and column, the value of the first source that has one.

    One aggregate over the stacked sources instead of a chain of outer joins.
    """
    ranked = [s.select(*keys, *[c for c in cols if c in s.columns], F.lit(i).alias("_rank")) for i, s in enumerate(sources)]
    best = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in cols]
    return stack(ranked).groupBy(*keys).agg(*best)
