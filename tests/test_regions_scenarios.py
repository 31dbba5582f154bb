"""Regions across the date line and the known scenarios."""

from pyspark.sql import functions as F

from skyweave.functions import scoring
from skyweave.functions.scoring import background, scenario_readings, score_readings
from skyweave.sources.reshape import within_regions


def test_regions_meet_at_the_date_line(spark):
    cities = spark.createDataFrame([("fiji", -17.0, 179.9, 100.0), ("near", 10.0, 20.0, 50.0)], "city string, lat double, lon double, buffer_km double")
    obs = spark.createDataFrame([(1, -17.0, -179.8), (2, -17.0, 179.5), (3, -17.0, -178.0), (4, 10.1, 20.1)], "id int, lat double, lon double")
    got = sorted((r.id, r.city) for r in within_regions(obs, cities).collect())
    assert got == [(1, "fiji"), (2, "fiji"), (4, "near")]


def test_a_missing_reading_has_no_background(spark):
    df = spark.createDataFrame([(None,), (10.0,)], "NO2 double")
    got = [r.b for r in df.select(background("NO2").alias("b")).collect()]
    assert got[0] is None and got[1] is not None


def test_scenarios_are_told_apart(spark):
    got = {r.scenario: r.label for r in score_readings(scenario_readings(spark)).select("scenario", F.col("label")).collect()}
    assert len(got) == 4 and [got[s] for s in scoring.SCENARIOS] == ["Fire", "Dust", "Gas", "Normal"]
