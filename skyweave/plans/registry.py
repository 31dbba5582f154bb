"""Registry of checkable queries: a Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Doubles are compared on a grid. Means of short decimals often end exactly half way between
# two grid points, where the last bit of a sum would decide; the odd offset moves the borders.
GRID = 100000.0
OFFSET = 0.318309886

Run = Callable[[SparkSession, str], DataFrame]


# Doubles from here on are whole multiples of the grid or close to it; they are compared as they are.
LARGE = 9e10


@dataclass(frozen=True)
class Query:
    """``run`` gives the engine's own result, ``checked`` the one that is compared with the SQL."""

    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None

    def checked(self, spark: SparkSession, sf: str) -> DataFrame:
        return plain(self.run(spark, sf))


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; ``covers`` lists the inventory rows it shows."""

    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return add


def _plain(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        grid = F.floor(c * F.lit(GRID) + F.lit(OFFSET)) / F.lit(GRID)
        return F.when(F.isnan(c) | (F.abs(c) >= F.lit(LARGE)), c.cast("double")).otherwise(grid).alias(name)
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if kind in ("int", "smallint", "tinyint"):
        return c.cast("bigint").alias(name)
    return c


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: doubles on a 1e-5 grid (NaN and large ones as they are), times as text, whole numbers as bigint."""
    return df.select(*[_plain(n, t) for n, t in df.dtypes])


def columns(spec: str) -> str:
    """SQL select list that does the same: ``f:`` double, ``t:`` time, ``d:`` date, ``n:`` whole number."""
    out = []
    for item in spec.split():
        kind, _, name = item.rpartition(":")
        out.append(
            {
                "": name,
                "f": f"CASE WHEN isnan(CAST({name} AS DOUBLE)) OR abs(CAST({name} AS DOUBLE)) >= {LARGE}::DOUBLE THEN CAST({name} AS DOUBLE)"
                f" ELSE CAST(floor(CAST({name} AS DOUBLE) * {GRID}::DOUBLE + {OFFSET}::DOUBLE) AS BIGINT) / {GRID}::DOUBLE END AS {name}",
                "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}",
                "d": f"strftime({name}, '%Y-%m-%d') AS {name}",
                "n": f"CAST({name} AS BIGINT) AS {name}",
            }[kind]
        )
    return ", ".join(out)


def sql(ctes: list[str] | str, spec: str, source: str) -> str:
    """``WITH ctes SELECT columns FROM source``."""
    ctes = [ctes] if isinstance(ctes, str) else ctes
    head = f"WITH {', '.join(c.strip() for c in ctes if c)} " if any(ctes) else ""
    return f"{head}SELECT {columns(spec)} FROM {source}"
