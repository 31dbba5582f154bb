"""Known event windows: labelling, validation, runs and markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CLASSES, code_of
from ..session import Stage, lazy
from .series import CHUNK_ROWS, POS, chunk_window, home_rows, in_series, neighbours, with_halo, with_position

NORMAL = CLASSES[0]


def _window_end(inclusive_end: str) -> Column:
    if inclusive_end == "midnight":  # the end date counts at 00:00 only
        return F.col("end")
    if inclusive_end == "day":  # the whole end date counts
        return F.col("end") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    raise ValueError("inclusive_end is 'midnight' or 'day'")


def day_slices(events: DataFrame, inclusive_end: str = "midnight") -> DataFrame:
    """One row per (event, calendar day it touches), which turns the range join into an equi-join."""
    ends = events.withColumn("end", _window_end(inclusive_end))
    days = F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))
    return ends.withColumn("_date", F.explode(days))


def label_events(
    df: DataFrame,
    events: DataFrame,
    key: str = "city",
    order: str = "datetime",
    inclusive_end: str = "midnight",
    stage: Stage = lazy,
) -> DataFrame:
    """Add event_label and event_code: type of the window a row falls in, else Normal.

    ``events`` has (key, start, end, type, seq); where windows overlap the highest ``seq``
    wins. Windows are resolved per (key, day) before the join, so a row meets at most one
    row of the other side and nothing is aggregated afterwards. Neither side is forced to
    be broadcast: the optimizer does so when the size it measures allows; ``stage`` may
    store the resolved windows so that it can measure them.
    """
    slices = day_slices(events, inclusive_end)
    midnight = F.col("_date").cast("timestamp_ntz")
    last_moment = midnight + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    whole_day = (F.col("start") <= midnight) & (F.col("end") >= last_moment)
    tagged = F.struct(F.col("seq").alias("seq"), F.col("type").alias("type"))
    part = F.struct(F.col("seq"), F.col("type"), F.col("start"), F.col("end"))
    resolved = slices.groupBy(F.col(key), F.col("_date")).agg(
        F.max(F.when(whole_day, tagged)).alias("_whole"),
        F.collect_list(F.when(~whole_day, part)).alias("_parts"),
    )
    t = F.col(order)
    inside = F.filter("_parts", lambda p: (t >= p["start"]) & (t <= p["end"]))
    partial = F.array_max(F.transform(inside, lambda p: F.struct(p["seq"].alias("seq"), p["type"].alias("type"))))
    winner = F.greatest(F.col("_whole"), partial)
    joined = df.withColumn("_date", t.cast("date")).join(stage(resolved, "windows"), [key, "_date"], "left")
    label = F.coalesce(winner["type"], F.lit(NORMAL))
    out = joined.withColumn("event_label", label).withColumn("event_code", code_of("event_label"))
    return out.select(*[c for c in df.columns if c not in ("event_label", "event_code")], "event_label", "event_code")


def rows_in_events(df: DataFrame, events: DataFrame, key: str = "city", order: str = "datetime") -> DataFrame:
    """Rows with every event window they fall in (inner)."""
    slices = day_slices(events)
    t = F.col(order)
    joined = df.withColumn("_date", t.cast("date")).join(slices, [key, "_date"])
    return joined.filter((t >= F.col("start")) & (t <= F.col("end"))).drop("_date")


def validate_events(
    df: DataFrame,
    events: DataFrame,
    label: str = "event_label",
    score: str = "anomaly_score",
    threshold: float = 50.0,
    key: str = "city",
    order: str = "datetime",
) -> DataFrame:
    """Per event: share of its rows that carry its type, peak score, detected or not.

    Events without rows are kept with 0 and false.
    """
    facts = df.select(key, order, F.col(label).alias("_label"), F.col(score).alias("_score"))
    seen = (
        rows_in_events(facts, events, key, order)
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("_label").eqNullSafe(F.col("type"))).alias("_hit"),
            F.max("_score").alias("_peak"),
        )
    )
    pct = F.coalesce(F.col("_hit") / F.col("_n") * 100, F.lit(0.0))
    return events.join(seen, "id", "left").select(
        *events.columns,
        (pct > threshold).alias("detected"),
        (F.rint(pct * 10) / 10).alias("match_pct"),
        (F.rint(F.coalesce(F.col("_peak"), F.lit(0.0)) * 1000) / 1000).alias("peak_score"),
    )


def detection_total(validated: DataFrame) -> DataFrame:
    """Detected events, all events and their share in percent."""
    hit = F.count_if("detected")
    return validated.agg(
        hit.alias("detected"),
        F.count(F.lit(1)).alias("events"),
        (hit * 100 / F.count(F.lit(1))).alias("detected_pct"),
    )


def event_markers(df: DataFrame, label: str = "event_label", keys: Sequence[str] = ("city",), order: str = "datetime") -> DataFrame:
    """First row of every non-Normal label per series, with its AQI (50 when missing)."""
    picked = df.filter(F.col(label) != NORMAL).groupBy(*keys, label).agg(F.min(order).alias(order), F.min_by("AQI", order).alias("_aqi"))
    return picked.select(*keys, label, order, F.coalesce(F.col("_aqi"), F.lit(50.0)).alias("AQI"))


def run_starts(
    df: DataFrame,
    label: str = "event_label",
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = lazy,
) -> DataFrame:
    """Add ``_run``: position where the contiguous run of the row's label begins."""
    placed = with_position(df, keys, order, stage=stage)
    haloed = with_halo(placed, before=1, chunk_rows=chunk_rows)
    prev = F.lag(label).over(chunk_window(keys))
    new = prev.isNull() | (prev != F.col(label))
    marked = stage(home_rows(haloed.withColumn("_start", F.when(new, F.col(POS))), chunk_rows), "runs")
    near = neighbours(marked, ["_start"], keys, chunk_rows, stage)
    return near.withColumn("_run", F.col("_prev__start")["val"]).drop("_prev__start", "_next__start")


def run_markers(df: DataFrame, label: str = "event_label", keys: Sequence[str] = ("city",), order: str = "datetime", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First row of every contiguous non-Normal run, with its AQI (50 when missing)."""
    placed = with_position(df, keys, order)
    haloed = with_halo(placed, before=1, chunk_rows=chunk_rows)
    marked = home_rows(haloed.withColumn("_prev", F.lag(label).over(chunk_window(keys))), chunk_rows)
    fresh = marked.filter(in_series() & (F.col(label) != NORMAL) & (F.col("_prev").isNull() | (F.col("_prev") != F.col(label))))
    return fresh.select(*keys, label, order, F.coalesce(F.col("AQI"), F.lit(50.0)).alias("AQI"))


def event_log(
    df: DataFrame,
    label: str = "event_label",
    score: str = "anomaly_score",
    keys: Sequence[str] = ("city",),
    order: str = "datetime",
    chunk_rows: int = CHUNK_ROWS,
    stage: Stage = lazy,
) -> DataFrame:
    """Start, end, rows and peak score of every contiguous non-Normal run; rows without a key or time are in none."""
    runs = run_starts(df, label, keys, order, chunk_rows, stage).filter((F.col(label) != NORMAL) & in_series())
    return (
        runs.groupBy(*keys, label, "_run")
        .agg(
            F.min(order).alias("start"),
            F.max(order).alias("end"),
            F.count(F.lit(1)).alias("hours"),
            F.max(score).alias("peak_score"),
        )
        .drop("_run")
    )
