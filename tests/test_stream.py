"""Streams equal batches on closed time, also with late files and hot keys."""

import datetime as dt
import time

import numpy as np
from pyspark.sql import functions as F

from skyweave.operators.features import lags_and_rolls
from skyweave.session import shared_path
from skyweave.streaming import jobs

SCHEMA = "reading_id long, city string, ts timestamp_ntz, x double"


def test_history_waits_for_out_of_order_files(spark):
    rng = np.random.default_rng(6)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else "b", t0 + dt.timedelta(minutes=i), float(rng.normal())) for i in range(300)]
    path = shared_path(spark, "landed")
    # neighbouring rows arrive swapped between two files, within the allowed delay
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if (r[0] // 5) % 2 == part], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream, end = jobs.with_end(jobs.read_stream(jobs.stream_session(spark), path, spark.read.parquet(path).schema))
    out = jobs.drain(jobs.history_features(stream, ["x"], ["city"], late="30 minutes", slice_ms=600_000), "history", end).toPandas()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before and len(out) == 300
    batch = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("ts", "datetime")
    want = lags_and_rolls(batch, ["x"], [1, 6, 24], ["x"]).toPandas()
    want = want.sort_values("reading_id").reset_index(drop=True)
    out = out.sort_values("id").reset_index(drop=True)
    assert out["id"].tolist() == want["reading_id"].tolist()
    for c in ("x_lag1", "x_lag6", "x_lag24", "x_roll6_mean", "x_roll24_mean", "x_roll6_std"):
        np.testing.assert_allclose(out[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9)


def test_open_slices_stay_without_an_end_and_late_rows_are_counted(spark):
    t0 = dt.datetime(2024, 1, 1)
    path = shared_path(spark, "landed")
    rows = [(i, "a", t0 + dt.timedelta(minutes=i), 1.0) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    stream, end = jobs.with_end(jobs.read_stream(jobs.stream_session(spark), path, spark.read.parquet(path).schema))
    featured = jobs.history_features(stream, ["x"], ["city"], late="30 minutes", slice_ms=600_000)
    open_ = jobs.drain_counted(featured, "history")
    assert open_.rows.count() == 160 and open_.late == 0
    # a reading of the first minute comes when the watermark has long passed it: two files later
    for row in [(1000, "a", t0 + dt.timedelta(minutes=201), 1.0), (999, "a", t0, 5.0)]:
        time.sleep(1.1)
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    one = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    index = jobs.windowed_index(one.withColumnsRenamed({"x": "PM2_5"}).withColumn("PM10", F.lit(1.0)), late="30 minutes")
    counted = jobs.drain_counted(index, "index")
    assert counted.late == 1


def test_end_closes_every_window(spark):
    t0 = dt.datetime(2024, 1, 1)
    path = shared_path(spark, "landed")
    spark.createDataFrame([(i, None if i % 9 == 0 else "a", t0 + dt.timedelta(minutes=i), float(i)) for i in range(200)], SCHEMA).write.parquet(path)
    stream, end = jobs.with_end(jobs.read_stream(spark, path, spark.read.parquet(path).schema))
    rows = jobs.drain(jobs.windowed_index(stream.withColumnsRenamed({"x": "PM2_5"}).withColumn("PM10", F.lit(1.0))), "index", end).collect()
    assert sum(r.readings for r in rows) == 200 and len(rows) == 8
