"""Positions, halos, filling, smoothing and frames against pandas, across chunk borders."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyweave.operators import events as ev
from skyweave.operators.decompose import centred_residual, spike_flags
from skyweave.operators.features import lags_and_rolls, lead_target
from skyweave.operators.fill import carry_fill, fill_gaps, interpolate
from skyweave.operators.series import CHUNK, POS, densify, with_halo, with_position
from skyweave.operators.smooth import savgol

CHUNK_ROWS = 48
START = pd.Timestamp("2024-01-01")


def frame(series: dict[str, list]) -> pd.DataFrame:
    parts = [pd.DataFrame({"city": k, "datetime": START + pd.to_timedelta(np.arange(len(v)), "h"), "x": v}) for k, v in series.items()]
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    cols = ", ".join("datetime timestamp_ntz" if c == "datetime" else f"{c} string" if pdf[c].dtype == object or str(pdf[c].dtype) in ("str", "string") else f"{c} double" for c in pdf.columns)
    rows = [tuple(None if (isinstance(v, float) and np.isnan(v)) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, cols).repartition(4)


def collect(df, *cols):
    pdf = df.select("city", "datetime", *cols).toPandas()
    return pdf.sort_values(["city", "datetime"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(7)
    out = {}
    for i in range(24):
        n = int(rng.integers(1, 320))
        v = rng.normal(50, 20, n).round(3)
        hole = rng.random(n) < rng.uniform(0, 0.5)
        if n > 60:  # long gaps that span chunk borders
            at = int(rng.integers(0, n - 50))
            hole[at : at + int(rng.integers(5, 50))] = True
        out[f"c{i:02d}"] = np.where(hole, np.nan, v).tolist()
    out["empty"] = [np.nan] * 60
    return frame(out)


def per_city(pdf, f):
    out = pdf.sort_values(["city", "datetime"]).copy()
    return out.groupby("city")["x"].transform(f).reset_index(drop=True)


def test_positions_count_rows_in_time_order(spark, gappy):
    got = collect(with_position(to_spark(spark, gappy), bucket_days=3), POS, "_len")
    want = gappy.sort_values(["city", "datetime"]).groupby("city").cumcount().reset_index(drop=True)
    assert (got[POS] == want).all()
    assert (got["_len"] == got.groupby("city")["city"].transform("size")).all()


def test_no_group_outgrows_its_chunk_when_one_key_holds_most_rows(spark):
    pdf = frame({"hot": list(np.arange(2000.0)), "a": [1.0] * 30, "b": [2.0] * 10})
    halo = with_halo(with_position(to_spark(spark, pdf)), 24, 10, CHUNK_ROWS)
    biggest = halo.groupBy("city", CHUNK).count().agg(F.max("count")).first()[0]
    assert biggest <= CHUNK_ROWS + 24 + 10


def test_interpolation_equals_pandas(spark, gappy):
    got = collect(interpolate(to_spark(spark, gappy), ["x"], chunk_rows=CHUNK_ROWS), "x")["x"]
    want = per_city(gappy, lambda s: s.interpolate(method="linear", limit=6, limit_direction="both"))
    assert (got.isna() == want.isna()).all()
    np.testing.assert_allclose(got.dropna(), want.dropna(), rtol=0, atol=1e-9)


def test_interpolation_by_hand(spark):
    nan = np.nan
    series = {
        "g5": [1.0, *[nan] * 5, 7.0],
        "g12": [0.0, *[nan] * 12, 13.0],
        "g13": [0.0, *[nan] * 13, 14.0],
        "g20": [0.0, *[nan] * 20, 21.0],
        "lead8": [*[nan] * 8, 5.0],
        "trail8": [5.0, *[nan] * 8],
    }
    got = collect(interpolate(to_spark(spark, frame(series)), ["x"], chunk_rows=8), "x")
    left = got[got["x"].isna()].groupby("city").size().to_dict()
    assert left == {"g13": 1, "g20": 8, "lead8": 2, "trail8": 2}
    g20 = got[got["city"] == "g20"]["x"].tolist()
    assert g20[3] == pytest.approx(3.0) and g20[18] == pytest.approx(18.0)


def test_known_values_are_kept_and_nothing_stays_missing(spark, gappy):
    got = collect(fill_gaps(to_spark(spark, gappy), ["x"], chunk_rows=CHUNK_ROWS), "x")["x"]
    known = gappy.sort_values(["city", "datetime"])["x"].reset_index(drop=True)
    assert got.notna().all()
    assert (got[known.notna()] == known[known.notna()]).all()


def test_seasonal_fill_equals_pandas(spark, gappy):
    def want(s):
        lin = s.interpolate(method="linear", limit=6, limit_direction="both")
        t = gappy.loc[s.index, "datetime"]
        mean = lin.groupby([t.dt.month, t.dt.hour]).transform("mean")
        return lin.fillna(mean).fillna(0)

    got = collect(fill_gaps(to_spark(spark, gappy), ["x"], chunk_rows=CHUNK_ROWS), "x")["x"]
    np.testing.assert_allclose(got, per_city(gappy, want), rtol=0, atol=1e-9)


def test_carry_fill_equals_pandas(spark, gappy):
    got = collect(carry_fill(to_spark(spark, gappy), ["x"], chunk_rows=CHUNK_ROWS), "x")["x"]
    assert (got == per_city(gappy, lambda s: s.ffill().bfill().fillna(0))).all()


def local_fit(y, window=11, poly=2):
    """Every point by its own least-squares fit."""
    out, half, n = [], window // 2, len(y)
    for i in range(n):
        lo = min(max(i - half, 0), n - window)
        x = np.arange(lo, lo + window)
        out.append(np.polyval(np.polyfit(x - i, y[lo : lo + window], poly), 0))
    return np.array(out)


def test_smoothing_equals_local_fits_and_short_series_fall_back(spark, gappy):
    got = collect(savgol(to_spark(spark, gappy), ["x"], chunk_rows=CHUNK_ROWS), "x", "x_smooth")

    def want(s):
        if len(s) < 11:
            return s.rolling(5, center=True, min_periods=1).mean()
        return pd.Series(local_fit(s.ffill().bfill().fillna(0).to_numpy()), index=s.index)

    expected = per_city(gappy, want)
    assert (got["x_smooth"].isna() == expected.isna()).all()
    np.testing.assert_allclose(got["x_smooth"].dropna(), expected.dropna(), atol=1e-8)
    raw = gappy.sort_values(["city", "datetime"])["x"].reset_index(drop=True)
    assert got["x"].equals(raw)


def test_smoothing_reproduces_a_quadratic(spark):
    series = {f"n{n}": [0.5 * t * t - 3 * t + 2 for t in range(n)] for n in (11, 12, 60, 130)}
    got = collect(savgol(to_spark(spark, frame(series)), ["x"], chunk_rows=CHUNK_ROWS), "x", "x_smooth")
    np.testing.assert_allclose(got["x_smooth"], got["x"], atol=1e-7)


def test_lags_and_rolls_equal_pandas(spark, gappy):
    got = lags_and_rolls(to_spark(spark, gappy), ["x"], [1, 6, 24], ["x"], (6, 24), (6,), chunk_rows=CHUNK_ROWS)
    got = collect(got, "x_lag1", "x_lag6", "x_lag24", "x_roll6_mean", "x_roll24_mean", "x_roll6_std")
    for k in (1, 6, 24):
        want = per_city(gappy, lambda s, k=k: s.shift(k))
        assert got[f"x_lag{k}"].equals(want.rename(f"x_lag{k}"))
    for n in (6, 24):
        want = per_city(gappy, lambda s, n=n: s.rolling(n, min_periods=1).mean())
        assert (got[f"x_roll{n}_mean"].isna() == want.isna()).all()
        np.testing.assert_allclose(got[f"x_roll{n}_mean"].dropna(), want.dropna(), atol=1e-9)
    want = per_city(gappy, lambda s: s.rolling(6, min_periods=1).std().fillna(0))
    np.testing.assert_allclose(got["x_roll6_std"], want, atol=1e-6)


def test_lead_and_centred_frames_equal_pandas(spark, gappy):
    got = collect(lead_target(to_spark(spark, gappy), "x", chunk_rows=CHUNK_ROWS), "target_24h")["target_24h"]
    assert got.equals(per_city(gappy, lambda s: s.shift(-24)).rename("target_24h"))
    got = collect(centred_residual(to_spark(spark, gappy), "x", chunk_rows=CHUNK_ROWS), "x_residual")["x_residual"]
    want = per_city(gappy, lambda s: s - s.rolling(24, center=True, min_periods=1).mean())
    np.testing.assert_allclose(got.dropna(), want.dropna(), atol=1e-9)


def test_spikes_equal_pandas(spark):
    rng = np.random.default_rng(3)
    base = np.repeat(rng.normal(0, 1, 14), 24)
    base[150:160] += 30
    pdf = frame({"a": base.tolist(), "b": [0.0] * 100, "c": [4.0] * 20}).rename(columns={"x": "x_residual"})
    got = collect(spike_flags(to_spark(spark, pdf), ["x"], chunk_rows=96), "stl_spike")["stl_spike"]

    def want(s):
        return s > 3 * s.rolling(72, min_periods=12).std().fillna(1)

    expected = per_city(pdf.rename(columns={"x_residual": "x"}), lambda s: want(s).astype(float)) > 0
    first_days = (pdf.sort_values(["city", "datetime"]).groupby("city").cumcount() < 72).reset_index(drop=True)
    assert (got == expected)[~first_days].all()
    assert got.any() and not got[pdf.sort_values(["city", "datetime"])["city"].reset_index(drop=True) == "b"].any()


def test_runs_equal_pandas(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in ("a", "b"):
        labels = np.repeat(rng.choice(["Normal", "Fire", "Dust"], 40), rng.integers(1, 30, 40))
        for i, lab in enumerate(labels):
            rows.append((c, START + pd.Timedelta(hours=i), lab, float(rng.random())))
    pdf = pd.DataFrame(rows, columns=["city", "datetime", "event_label", "anomaly_score"])
    got = ev.event_log(to_spark(spark, pdf), chunk_rows=16).toPandas().sort_values(["city", "start"]).reset_index(drop=True)
    new = (pdf["event_label"] != pdf.groupby("city")["event_label"].shift()).groupby(pdf["city"]).cumsum()
    want = pdf.assign(run=new).query("event_label != 'Normal'").groupby(["city", "run", "event_label"], as_index=False)
    want = want.agg(start=("datetime", "min"), end=("datetime", "max"), hours=("datetime", "size"), peak_score=("anomaly_score", "max"))
    want = want.sort_values(["city", "start"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("event_label", "start", "end", "hours", "peak_score"):
        assert (got[c] == want[c]).all()


def test_grid_is_complete(spark):
    rows = [("a", pd.Timestamp("2024-01-01 00:00"), 1.0), ("a", pd.Timestamp("2024-01-01 05:00"), 2.0), ("b", pd.Timestamp("2024-01-02 00:00"), 3.0)]
    sdf = to_spark(spark, pd.DataFrame(rows, columns=["city", "datetime", "x"]))
    got = collect(densify(sdf), "x")
    assert len(got) == 7 and got["x"].notna().sum() == 3
    assert collect(densify(sdf, zero=["x"]), "x")["x"].tolist() == [1.0, 0.0, 0.0, 0.0, 0.0, 2.0, 3.0]


def test_empty_input_gives_empty_output(spark):
    empty = spark.createDataFrame([], "city string, datetime timestamp_ntz, x double")
    assert fill_gaps(empty, ["x"]).count() == 0
    assert savgol(empty, ["x"]).count() == 0
    assert lags_and_rolls(empty, ["x"], [1], ["x"]).count() == 0


def test_rows_without_key_or_time_stay(spark):
    t = [dt.datetime(2024, 1, 1, i) for i in range(5)]
    rows = [("a", t[i], float(i)) for i in range(5)] + [(None, t[0], 7.0), (None, t[1], None), ("a", None, 8.0), (None, None, 9.0)]
    df = spark.createDataFrame(rows, "city string, datetime timestamp_ntz, x double")
    many = df.unionByName(spark.range(9000).selectExpr("CAST(NULL AS STRING) AS city", "CAST(NULL AS TIMESTAMP_NTZ) AS datetime", "CAST(id AS DOUBLE) AS x"))
    for source in (df, many):
        out = lags_and_rolls(source, ["x"], [1], ["x"]).where("x IS NULL OR x < 10").distinct().toPandas()
        loose = out[out["city"].isna() | out["datetime"].isna()]
        assert loose[["x_lag1", "x_roll6_mean", "x_roll6_std"]].isna().all().all()
        series = out.dropna(subset=["city", "datetime"]).sort_values("datetime")
        assert series["x_lag1"].tolist()[1:] == [0.0, 1.0, 2.0, 3.0] and series["x_roll6_mean"].tolist() == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert lags_and_rolls(df, ["x"], [1], ["x"]).count() == 9 and lags_and_rolls(many, ["x"], [1], ["x"]).count() == 9009
    filled = fill_gaps(df, ["x"]).toPandas()
    assert len(filled) == 9 and sorted(filled["x"]) == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 7.0, 8.0, 9.0]
    smooth = savgol(df, ["x"]).toPandas()
    assert len(smooth) == 9 and smooth["x_smooth"].notna().sum() == 5
    sizes = with_position(many).where("_len IS NULL").selectExpr("floor(_pos / 4096) AS c").groupBy("c").count().toPandas()
    assert sizes["count"].max() <= 4096


@pytest.mark.parametrize("step, count, hours", [("1 second", 20_000, 1 / 3600), ("7 hours", 9_000, 7)])
def test_long_grids_are_laid_out_in_blocks(spark, step, count, hours):
    first = dt.datetime(2024, 1, 1, 5)
    last = first + dt.timedelta(hours=hours) * (count - 1)
    df = spark.createDataFrame([("a", first, 1.0), ("a", last, 2.0), ("b", first, 3.0), (None, first, 4.0), ("a", None, 5.0)], "city string, datetime timestamp_ntz, x double")
    out = densify(df, step=step, keep_position=True).toPandas().sort_values(["city", "_pos"])
    a = out[out["city"] == "a"]
    assert len(out) == count + 1 and a["_pos"].tolist() == list(range(count)) and set(a["_len"]) == {count}
    assert a["datetime"].tolist() == [first + dt.timedelta(hours=hours) * i for i in range(count)] and a["x"].notna().sum() == 2
