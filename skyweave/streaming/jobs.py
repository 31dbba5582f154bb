"""Streaming jobs: scoring, windowed index and true history features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.aqi import aqi, aqi_band
from ..functions.scoring import score_readings
from ..session import shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = 24
# The event time of an end mark: later than any reading.
END = dt.datetime(9000, 1, 1)


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's with the state store that keyed history needs; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they land; the schema is declared."""
    return spark.readStream.schema(schema).parquet(path)


def with_end(readings: DataFrame, order: str = "ts") -> tuple[DataFrame, str]:
    """The stream and a folder beside it: ``drain`` puts a mark there that ends the stream.

    The mark is a row with a far event time and nulls else. It moves the watermark past all readings, so that what is
    still open comes out by the same operators; it never comes out itself.
    """
    spark = readings.sparkSession
    marks = shared_path(spark, "end-marks")
    spark.createDataFrame([], readings.schema).write.parquet(marks)
    return readings.unionByName(read_stream(spark, marks, readings.schema)), marks


@dataclass(frozen=True)
class Drained:
    """What a stream gave: the appended rows, where they lie, and how many rows its state dropped as too late."""

    rows: DataFrame
    path: str
    late: int


def drain_counted(stream: DataFrame, name: str, end: str | None = None, order: str = "ts") -> Drained:
    """Process what is there, then stop. With ``end``, the folder of ``with_end``, the stream is over after that and nothing stays open.

    Output and checkpoint lie in the shared folder, so a restarted query goes on where it was and no committed row is
    written twice. Rows behind the watermark are counted where the state drops them, after any partial aggregation.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    late = 0

    def run() -> int:
        target = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        running = target.outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
        return sum(int(o["numRowsDroppedByWatermark"]) for p in running.recentProgress for o in p["stateOperators"])

    late += run()
    if end is not None:
        types = dict(spark.read.parquet(end).dtypes)
        mark = spark.range(1).select(*[(F.lit(END) if c == order else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        mark.write.mode("append").parquet(end)
        late += run()
    return Drained(spark.read.schema(stream.schema).parquet(out), out, late)


def drain(stream: DataFrame, name: str, end: str | None = None, order: str = "ts") -> DataFrame:
    """The rows of ``drain_counted``."""
    return drain_counted(stream, name, end, order).rows


def score_stream(readings: DataFrame, model=None) -> DataFrame:
    """The batch scoring expressions on a stream; no state."""
    return score_readings(readings, model)


def _timed(readings: DataFrame, order: str, late: str) -> DataFrame:
    """Readings with event time ``_t`` and a watermark; end marks have moved it, and go no further."""
    marked = readings.withColumn("_t", F.col(order).cast("timestamp")).withWatermark("_t", late)
    return marked.where(F.col("_t") < F.lit(END).cast("timestamp"))


def windowed_index(
    readings: DataFrame,
    keys: Sequence[str] = ("city",),
    order: str = "ts",
    window: str = "1 hour",
    late: str = "10 minutes",
) -> DataFrame:
    """AQI of mean particulates per key and time window, once the watermark has passed it.

    Event time must be a TIMESTAMP; rows later than ``late`` behind the newest are dropped and counted by ``drain_counted``. The
    windows open at the end come out with an end mark. Partial aggregation reduces a hot key before its rows are shuffled.
    """
    timed = _timed(readings, order, late)
    means = timed.groupBy(F.window("_t", window), *keys).agg(
        F.avg("PM2_5").alias("PM2_5"), F.avg("PM10").alias("PM10"), F.count(F.lit(1)).alias("readings")
    )
    start = F.col("window.start").cast("timestamp_ntz").alias("datetime")
    indexed = means.select(*keys, start, "PM2_5", "PM10", "readings").withColumn("AQI", aqi("PM2_5", "PM10"))
    return indexed.withColumn("band", aqi_band("AQI"))


class HistoryFeatures(StatefulProcessor):
    """Per key: rows wait in slices of event time until the watermark passes a slice, then leave in order.

    State is a map from slice to its rows, and the last 24 rows that left, so it does not grow with the stream. A
    timer stands at the end of each slice; a call holds one batch of input or one slice, never a key's backlog. Rows
    of one key may come in several pieces and out of order.
    """

    def __init__(self, keys: Sequence[str], columns: Sequence[str], slice_ms: int):
        self.keys, self.columns, self.slice_ms = list(keys), list(columns), slice_ms
        self.names = ["t", "id", *self.columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = "t array<long>, id array<long>, " + ", ".join(f"`{c}` array<double>" for c in self.columns)
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", fields)
        self.past = handle.getValueState("past", fields)

    def _frame(self, held: tuple | None) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.names, held if held is not None else [[]] * len(self.names))))

    def _lists(self, frame: pd.DataFrame) -> tuple:
        return tuple(frame[n].astype(float if n in self.columns else int).tolist() for n in self.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for number, part in pdf.groupby(pdf["t"] // (1000 * self.slice_ms)):
                place = (int(number),)
                if self.waiting.containsKey(place):
                    part = pd.concat([self._frame(self.waiting.getValue(place)), part], ignore_index=True)
                else:
                    self.handle.registerTimer((int(number) + 1) * self.slice_ms)
                self.waiting.updateValue(place, self._lists(part))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place = (int(expiredTimerInfo.getExpiryTimeInMs()) // self.slice_ms - 1,)
        ready = self._frame(self.waiting.getValue(place)).sort_values(["t", "id"])
        self.waiting.removeKey(place)
        past = self._frame(self.past.get() if self.past.exists() else None)
        line = pd.concat([past, ready], ignore_index=True) if len(past) else ready.reset_index(drop=True)
        frame = pd.DataFrame({"t": line["t"], "id": line["id"], **dict(zip(self.keys, key))})
        for c in self.columns:
            frame[c] = line[c]
            for k in (1, 6, 24):
                frame[f"{c}_lag{k}"] = line[c].shift(k)
            for n in (6, 24):
                frame[f"{c}_roll{n}_mean"] = line[c].rolling(n, min_periods=1).mean()
            frame[f"{c}_roll6_std"] = line[c].rolling(6, min_periods=1).std().fillna(0.0)
        self.past.update(self._lists(line.tail(HISTORY)))
        yield frame.iloc[len(past) :]

    def close(self) -> None:
        pass


def history_features(
    readings: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("city",),
    order: str = "ts",
    row_id: str = "reading_id",
    late: str = "10 minutes",
    slice_ms: int = 3_600_000,
) -> DataFrame:
    """Lags and rolling statistics of the true past of each key, in place of synthetic ones.

    Rows leave when the watermark, ``late`` behind the newest event time, has passed the slice of ``slice_ms`` they are in; those
    of the last slices come out with an end mark. Readings come from a ``stream_session``. Choose keys as fine as the
    sensor: one key's slices are handled in order by one task, one at a time.
    """
    types = dict(readings.dtypes)
    slim = _timed(readings, order, late).select(
        *keys, "_t", F.unix_micros("_t").alias("t"), F.col(row_id).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]
    )
    fields = ["t long", "id long", *[f"`{k}` {types[k]}" for k in keys]]
    for c in columns:
        names = [c, *[f"{c}_lag{k}" for k in (1, 6, 24)], *[f"{c}_roll{n}_mean" for n in (6, 24)], f"{c}_roll6_std"]
        fields += [f"`{n}` double" for n in names]
    return slim.groupBy(*keys).transformWithStateInPandas(HistoryFeatures(keys, columns, slice_ms), ", ".join(fields), "append", "EventTime")
