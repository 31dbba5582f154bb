"""Session helpers. Library code never builds a session; tests and bench.py do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skyweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors can reach.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a
    local session without that setting falls back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        base = _FALLBACK.setdefault(app, _FALLBACK.get(app) or tempfile.mkdtemp(prefix="run-"))
    return f"{base.rstrip('/')}/skyweave/{name}-{uuid.uuid4().hex}"


# What an operator does with a table it reads more than once, or joins and should know the size of.
Stage = Callable[[DataFrame, str], DataFrame]


def lazy(df: DataFrame, name: str) -> DataFrame:
    """Leave the table as a plan."""
    return df


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside drops its shuffle files as it ends, not when the driver happens to collect its garbage.

    For single runs only, like writing a table: a table run again inside shuffles anew.
    """
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a durable table, so that a plan which uses ``df`` more than
    once computes it once and a lost executor does not restart the whole chain. The
    optimizer also knows the size of a stored table: a small one is broadcast by measured
    size and the large side of its join is not shuffled at all.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
