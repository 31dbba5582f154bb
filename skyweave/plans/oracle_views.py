"""The input views as SQL common table expressions, written apart from the Spark code."""

from __future__ import annotations

_MEAN = "CAST(sum(v) FILTER (WHERE event_type = '{0}') AS DOUBLE) / count(v) FILTER (WHERE event_type = '{0}')"

WEATHER = ["temp_c", "humidity", "wind_speed", "wind_dir", "precip", "pressure", "dewpoint", "cloud_pct"]
GASES = ["NO2", "SO2", "CO", "O3"]
RAW = [*WEATHER, "visibility_m", *GASES, "AOD", "fire_count"]


def _hourly(key: str, prefix: str) -> str:
    return f"""
{prefix}_obs AS (
  SELECT {key} AS city, date_trunc('hour', ts) AS datetime, event_type, value,
         CAST(value AS DECIMAL(18,2)) AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
{prefix}_agg AS (
  SELECT city, datetime,
         {_MEAN.format('click')} AS NO2, {_MEAN.format('error')} AS SO2, {_MEAN.format('purchase')} / 20 AS CO,
         {_MEAN.format('signup')} AS O3, {_MEAN.format('view')} / 100 AS AOD,
         CAST(count(*) FILTER (WHERE event_type = 'error' AND value > 100) AS DOUBLE) AS fire_count,
         CAST(sum(k) AS DOUBLE) / count(k) AS k
  FROM {prefix}_obs GROUP BY 1, 2),
{prefix}_grid AS (
  SELECT city, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime
  FROM {prefix}_agg GROUP BY city),
{prefix} AS (
  SELECT city, datetime, k / 2 AS temp_c, k AS humidity, k / 10 AS wind_speed, k * 3.6::DOUBLE AS wind_dir,
         k / 50 AS precip, k / 5 + 1000 AS pressure, k / 4 AS dewpoint, k AS cloud_pct, k * 100 AS visibility_m,
         NO2, SO2, CO, O3, AOD, fire_count
  FROM {prefix}_grid LEFT JOIN {prefix}_agg USING (city, datetime))"""


HOURLY = _hourly("CASE user_id % 3 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'Jaipur' ELSE 'Vizag' END", "hourly")
STATIONS = _hourly("printf('S%02d', user_id % 30)", "stations")

DAILY = """
daily AS (
  SELECT a.city, a.date, a.PM2_5, b.PM10, b.NO2 FROM (
    SELECT o_orderpriority AS city, CAST(o_orderdate AS DATE) AS date,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS PM2_5
    FROM orders GROUP BY 1, 2) a
  LEFT JOIN (
    SELECT o_orderpriority AS city, CAST(o_orderdate AS DATE) AS date,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 200 AS PM10,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS NO2
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) b
  ON a.city = b.city AND a.date = b.date)"""

ORDERS_SOURCE = """
orders_source AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS PM2_5,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE)
           / count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / 5000 AS SO2
  FROM orders GROUP BY 1)"""

ITEMS_SOURCE = """
items_source AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 300 AS PM2_5,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE)
           / count(*) FILTER (WHERE l_returnflag = 'R') / 1500 AS SO2,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS NO2
  FROM lineitem GROUP BY 1)"""

PLACES = """
places AS (SELECT * FROM (VALUES
  (0, 'Delhi', 28.7041::DOUBLE, 77.1025::DOUBLE, 50), (1, 'Jaipur', 26.9124::DOUBLE, 75.7873::DOUBLE, 50),
  (2, 'Vizag', 17.6868::DOUBLE, 83.2185::DOUBLE, 50)) t(i, city, clat, clon, buffer_km))"""

PIXELS = (
    PLACES
    + """,
pixels AS (
  SELECT ['NO2', 'SO2', 'CO', 'O3', 'AOD'][l_linenumber % 5 + 1] AS band, l_shipdate AS image_ts,
         clat + CAST(l_partkey % 13 - 6 AS DOUBLE) / 10 AS lat, clon + CAST(l_orderkey % 13 - 6 AS DOUBLE) / 10 AS lon,
         l_extendedprice AS value, l_linenumber + 3 AS mask
  FROM lineitem JOIN places ON l_suppkey % 3 = i),
inside AS (
  SELECT p.*, c.city FROM pixels p JOIN places c
  ON 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
       sin(radians(clat - lat) / 2) * sin(radians(clat - lat) / 2)
       + cos(radians(lat)) * cos(radians(clat)) * sin(radians(clon - lon) / 2) * sin(radians(clon - lon) / 2)))) <= buffer_km)"""
)

WINDOWS = """
windows AS (SELECT * FROM (VALUES
  (1, 1, 'Delhi', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-09 00:00:00', 'Fire', 'Delhi smoke'),
  (2, 2, 'Delhi', TIMESTAMP '2024-01-08 06:00:00', TIMESTAMP '2024-01-10 00:00:00', 'Gas', 'Delhi leak'),
  (3, 3, 'Jaipur', TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-01-15 00:00:00', 'Dust', 'Jaipur dust'),
  (4, 4, 'Vizag', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-22 00:00:00', 'Industrial', 'Vizag plant'),
  (5, 5, 'Vizag', TIMESTAMP '2024-01-24 00:00:00', TIMESTAMP '2024-01-25 12:30:00', 'Gas', 'Vizag leak'),
  (6, 6, 'Delhi', TIMESTAMP '2023-06-01 00:00:00', TIMESTAMP '2023-06-03 00:00:00', 'Dust', 'before the data'),
  (7, 7, '1-URGENT', TIMESTAMP '1996-03-01 00:00:00', TIMESTAMP '1996-03-20 00:00:00', 'Fire', 'series one'),
  (8, 8, '5-LOW', TIMESTAMP '1999-07-01 00:00:00', TIMESTAMP '1999-07-15 00:00:00', 'Dust', 'series five')
) t(id, seq, city, w_start, w_end, type, name))"""


def piecewise(v: str, pieces: list[tuple]) -> str:
    arms = []
    for i, (blo, bhi, ilo, ihi) in enumerate(pieces):
        line = f"(({ihi} - {ilo})::DOUBLE / ({bhi}::DOUBLE - {blo}::DOUBLE + 1e-9::DOUBLE)) * ({v} - {blo}::DOUBLE) + {ilo}::DOUBLE"
        arms.append(f"ELSE least({line}, 500.0::DOUBLE)" if i == len(pieces) - 1 else f"WHEN {v} <= {bhi} THEN {line}")
    return f"CASE WHEN {v} > 0 THEN CASE {' '.join(arms)} END END"


PM25 = [(0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200), (91, 120, 201, 300), (121, 250, 301, 400)]
PM10 = [(0, 50, 0, 50), (51, 100, 51, 100), (101, 250, 101, 200), (251, 350, 201, 300), (351, 430, 301, 400)]
AQI = f"greatest({piecewise('PM2_5', PM25)}, {piecewise('PM10', PM10)})"


def proxied(source: str, name: str = "proxied") -> str:
    d = "least(greatest(AOD, 0.0::DOUBLE), 5.0::DOUBLE)"
    return f"""
{name} AS (
  SELECT * EXCLUDE (AOD), CASE WHEN AOD IS NOT NULL THEN {d} END AS AOD,
         CASE WHEN AOD IS NOT NULL THEN least(greatest({d} * 120, 0.0::DOUBLE), 1500.0::DOUBLE) END AS PM2_5,
         CASE WHEN AOD IS NOT NULL THEN least(greatest({d} * 195, 0.0::DOUBLE), 3000.0::DOUBLE) END AS PM10
  FROM {source})"""


# hourly city table with particulates, index, an arithmetic anomaly score and event labels
BASE = ",".join(
    [
        HOURLY,
        proxied("hourly"),
        WINDOWS,
        f"""
base AS (
  SELECT p.*, {AQI} AS AQI, cloud_pct / 100 AS anomaly_score,
         coalesce((SELECT max_by(w.type, w.seq) FROM windows w
                   WHERE w.city = p.city AND p.datetime >= w.w_start AND p.datetime <= w.w_end), 'Normal') AS event_label
  FROM proxied p)""",
    ]
)
