"""Label dictionaries and rule labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import as_col
from .weather import ratio

# Event classes in code order.
CLASSES = ["Normal", "Fire", "Dust", "Gas", "Industrial"]


def code_of(label: Column | str) -> Column:
    """Class code of a label; an unknown or missing label is 0."""
    table = F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(CLASSES)))
    return F.coalesce(F.try_element_at(table, as_col(label)), F.lit(0))


def label_of(code: Column | str) -> Column:
    """Class name of a code; an unknown or missing code is Normal."""
    table = F.array(*[F.lit(n) for n in CLASSES])
    return F.coalesce(F.get(table, as_col(code).cast("int")), F.lit(CLASSES[0]))


def fingerprint_label(pm25="PM2_5", pm10="PM10", co="CO", so2="SO2", no2="NO2", wind="wind_speed") -> Column:
    """Chemical fingerprint class; the first rule that holds names it."""
    pm25, pm10, co, so2, no2, wind = (as_col(c) for c in (pm25, pm10, co, so2, no2, wind))
    share = ratio(pm25, pm10)
    return (
        F.when((pm25 > 100) & (co > 2.5) & (share > 0.55), "Fire")
        .when((pm10 > 150) & (share < 0.38) & (wind > 3.5), "Dust")
        .when((so2 > 60) & (no2 > 50) & (pm10 < 250), "Gas")
        .when((so2 > 35) & (no2 > 60) & (pm25 > 80), "Marine")
        .otherwise("Normal")
    )
