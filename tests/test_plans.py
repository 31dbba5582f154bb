"""Physical plans stay what they should be."""

import re

import pytest

from skyweave.operators import events as ev
from skyweave.operators.features import lags_and_rolls, pointwise_features
from skyweave.operators.fill import interpolate
from skyweave.operators.series import with_position
from skyweave.plans import reports
from skyweave.plans.catalogue import REGISTRY
from skyweave.plans.queries_clean import base
from skyweave.session import stage_table
from skyweave.sources import views


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return stage_table(with_position(base(spark, sf_dir)), "rows")


def test_lags_and_rolls_share_one_window(rows):
    p = plan(lags_and_rolls(rows))
    assert len(re.findall(r"\bWindow \[", p)) == 1 and p.count("Exchange hashpartitioning") == 1
    assert "_chunk" in re.search(r"hashpartitioning\(([^)]*)\)", p).group(1)


def test_pointwise_columns_move_no_row(rows):
    p = plan(pointwise_features(rows))
    assert "Exchange" not in p and "Python" not in p


def test_interpolation_keys_on_chunks_and_looks_back_only(rows):
    p = plan(interpolate(rows, ["NO2"]))
    assert "unboundedfollowing" not in p.lower().replace("unboundedpreceding$(), unboundedfollowing", "") and "Python" not in p
    assert "SortAggregate" not in p


def test_event_windows_are_an_equi_join(spark, rows):
    p = plan(ev.label_events(rows.select("city", "datetime"), views.event_windows(spark)))
    assert "BroadcastHashJoin [city" in p and "NestedLoop" not in p


def test_scans_read_only_what_is_used(rows):
    p = plan(reports.disaster_days(rows))
    read = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"city", "datetime", "event_label"}


def test_filters_reach_the_scan(spark, rows):
    p = plan(reports.select_range(rows, "Delhi", "2024-01-05", "2024-01-06").select("AQI"))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", p).group(1)
    assert "EqualTo(city,Delhi)" in pushed and "GreaterThanOrEqual(datetime" in pushed


def test_registry_covers_the_inventory():
    shown = {c for q in REGISTRY.values() for c in q.covers}
    for letter, last in (("S", 22), ("P", 20), ("G", 6), ("J", 7), ("A", 18), ("W", 14), ("T", 7), ("M", 15), ("R", 8)):
        missing = [f"{letter}-{i:02d}" for i in range(1, last + 1) if f"{letter}-{i:02d}" not in shown]
        assert not missing, missing
    assert {"ST-1", "ST-2", "ST-3", "M-03b"} <= shown


def test_one_row_aggregates_are_scalar_subqueries(spark, sf_dir):
    p = plan(REGISTRY["aqi_fallback"].run(spark, sf_dir))
    assert "Subquery" in p
