"""Isolation forest per series: small random samples grow trees, all rows are scored in parallel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stage, stage_table
from .metrics import min_max_score
from .sampling import HASH_RANGE

# The features the anomaly score looks at.
ANOMALY_FEATURES = [
    "NO2", "SO2", "CO", "O3", "PM2_5", "PM10", "AOD",
    "ratio_pm25_pm10", "ratio_co_no2", "ratio_so2_no2",
    "co_x_no2", "so2_x_no2", "aod_x_wind", "fire_x_no2",
    "PM2_5_roll6_std", "NO2_roll6_std", "SO2_roll6_std",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "fire_count",
]
EULER = 0.5772156649015329
ROWS_PER_TASK = 100_000
NODE_SCHEMA = "tree int, rows int, feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, seed: int) -> dict[str, list]:
    """One random tree as parallel node arrays; a leaf has feature -1 and its path length."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}

    def add(rows: np.ndarray, level: int) -> int:
        node = len(tree["feature"])
        for name, value in (("feature", -1), ("threshold", 0.0), ("left", node), ("right", node)):
            tree[name].append(value)
        tree["depth"].append(float(level + path_length(np.array(len(rows)))))
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
        if level >= limit or len(spread) == 0:
            return node
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        goes_left = rows[:, f] <= cut
        if goes_left.all():  # the draw hit the maximum
            cut = float(rows[:, f].min())
            goes_left = rows[:, f] <= cut
        tree["feature"][node], tree["threshold"][node] = f, cut
        tree["left"][node] = add(rows[goes_left], level + 1)
        tree["right"][node] = add(rows[~goes_left], level + 1)
        return node

    add(x, 0)
    return tree


def _features(df: DataFrame, feats: Sequence[str]) -> list[str]:
    return [f for f in feats if f in df.columns]


def _sizes(df: DataFrame, keys: Sequence[str], stage: Stage) -> DataFrame:
    """Rows per series under other names for the keys, so that a null key finds its row as well."""
    return stage(df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")), "sizes")


def _sized(df: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(sizes, same).drop(*[f"_key_{k}" for k in keys])


def tree_samples(
    df: DataFrame,
    feats: Sequence[str],
    keys: Sequence[str] = ("city",),
    ids: Sequence[str] = ("city", "datetime"),
    trees: int = 300,
    sample: int = 256,
    seed: int = 42,
    stage: Stage = stage_table,
) -> DataFrame:
    """(keys, tree, x): at most ``sample`` random rows of a series for every tree.

    Draws are hashes of the row's identity. Every row draws how many trees it goes to, on average a little over
    trees * sample / rows of its series and at most all of them, and the first of these trees; each (key, tree) then keeps its
    lowest draws. The rule is the same for a series of any size. Row counts per series are stored first, so that
    their join moves no row while they are few.
    """
    keys = list(keys)
    feats = _features(df, feats)
    want = sample + 8 * sample**0.5  # eight deviations above, so that no tree goes short
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats])
    share = F.least(F.lit(1.0), F.lit(want) / F.col("_n")) * trees
    row = F.xxhash64(*ids)
    coin = F.pmod(F.xxhash64(F.lit(seed), row), F.lit(HASH_RANGE)) / HASH_RANGE
    drawn = _sized(df, _sizes(df, keys, stage), keys).select(*keys, F.floor(share + coin).cast("int").alias("_times"), row.alias("_row"), x.alias("x"))
    drawn = drawn.where(F.col("_times") > 0).withColumn("_times", F.least("_times", F.lit(trees)))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_row")), F.lit(trees)).cast("int")
    drawn = drawn.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), F.col("_times") - 1), lambda i: F.pmod(first + i, F.lit(trees)))))
    drawn = drawn.withColumn("_draw", F.xxhash64(F.lit(seed + 1), "_row", "tree"))
    lowest = Window.partitionBy(*keys, "tree").orderBy("_draw", "_row")
    return drawn.withColumn("_rank", F.row_number().over(lowest)).filter(F.col("_rank") <= sample).select(*keys, "tree", "x")


def fit_forest(
    df: DataFrame,
    feats: Sequence[str] = tuple(ANOMALY_FEATURES),
    keys: Sequence[str] = ("city",),
    ids: Sequence[str] = ("city", "datetime"),
    trees: int = 300,
    sample: int = 256,
    seed: int = 42,
) -> DataFrame:
    """One row per (key, tree) with the tree's nodes; a group holds at most ``sample`` rows."""
    keys = list(keys)
    samples = tree_samples(df, feats, keys, ids, trees, sample, seed)
    types = dict(samples.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], NODE_SCHEMA])

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        x = x[np.lexsort(x.T)]  # the order in which rows arrive must not matter
        nodes = grow_tree(x, seed * 100_003 + int(key[-1]))
        row = {**dict(zip(keys, key)), "tree": int(key[-1]), "rows": len(x), **nodes}
        return pd.DataFrame([row])

    return samples.groupBy(*keys, "tree").applyInPandas(grow, schema)


def _mean_depth(x: np.ndarray, forest: pa.Table) -> tuple[np.ndarray, float]:
    """Mean depth of each row over the trees, whose node arrays are taken from the columns as they lie."""
    nodes = {}
    for name, kind in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("depth", float)):
        column = forest.column(name).combine_chunks()
        nodes[name] = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for a, b in zip(ends[:-1], ends[1:]):
        feature, threshold, left, right, depth = (v[a:b] for v in nodes.values())
        at, going = np.zeros(len(x), dtype=np.int64), every
        while len(going):
            node = at[going]
            f = feature[node]
            going, node, f = going[f >= 0], node[f >= 0], f[f >= 0]
            if len(going):
                at[going] = np.where(x[going, f] <= threshold[node], left[node], right[node])
        total += depth[at]
    return total / max(forest.num_rows, 1), float(path_length(forest.column("rows").to_numpy()).mean())


def score_forest(
    df: DataFrame,
    forest: DataFrame,
    feats: Sequence[str] = tuple(ANOMALY_FEATURES),
    keys: Sequence[str] = ("city",),
    ids: Sequence[str] = ("city", "datetime"),
    rows_per_task: int = ROWS_PER_TASK,
    stage: Stage = stage_table,
) -> DataFrame:
    """Add ``raw``: 0.5 - 2^(-mean depth / expected depth), low for outliers.

    A series is cut by a hash of ``ids`` into pieces of about ``rows_per_task`` rows and its trees go to each piece, which
    scores whole rows: every row comes back once, also rows that share their ids. A series without trees scores null.
    """
    keys, feats = list(keys), _features(df, feats)
    sizes = _sizes(df, keys, stage).withColumn("_pieces", F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int")).drop("_n")
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats])
    piece = F.pmod(F.xxhash64(*ids), F.col("_pieces")).cast("int")
    rows = _sized(df, sizes, keys).withColumns({"_piece": piece, "_x": x}).drop("_pieces")
    trees = _sized(forest, sizes, keys).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("raw", T.DoubleType())])

    def score(part: pa.Table, grown: pa.Table) -> pa.Table:
        raw = np.full(part.num_rows, np.nan)
        if part.num_rows and grown.num_rows:
            values = part.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            depth, expected = _mean_depth(values.reshape(part.num_rows, -1), grown)
            raw = 0.5 - 2.0 ** (-depth / max(expected, 1e-12))
        return part.select(columns).append_column("raw", pa.array(raw, from_pandas=True))

    by = [*keys, "_piece"]
    return rows.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(score, schema)


def anomaly_scores(
    df: DataFrame,
    feats: Sequence[str] = tuple(ANOMALY_FEATURES),
    keys: Sequence[str] = ("city",),
    ids: Sequence[str] = ("city", "datetime"),
    trees: int = 300,
    sample: int = 256,
    seed: int = 42,
    threshold: float = 0.88,
    forest: DataFrame | None = None,
    stage: Stage = stage_table,
) -> DataFrame:
    """Add anomaly_score in [0, 1] (per series, 1 is the strangest row) and is_anomaly.

    ``df`` should be a stored table; the forest and the scores, which are used twice, are
    stored here.
    """
    grown = stage(fit_forest(df, feats, keys, ids, trees, sample, seed), "forest") if forest is None else forest
    scored = stage(score_forest(df, grown, feats, keys, ids, stage=stage), "scored")
    return min_max_score(scored, "raw", keys, stage=stage).drop("raw").withColumn("is_anomaly", F.col("anomaly_score") > threshold)
