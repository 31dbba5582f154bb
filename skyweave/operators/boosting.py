"""Gradient boosting over all classes at once (softmax) or of one value: histograms per level, summed by Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Stage, stage_table

BINS = 64  # cells of a feature's histogram
UNIT = float(1 << 20)  # gradients are summed as whole multiples of 1 / UNIT, so that no order of adding changes a tree
NODE_SCHEMA = "round int, output int, node int, feature int, cut int, threshold double, value double, gain double"
CELL_SCHEMA = "output int, node int, feature int, bin int, g bigint, h bigint"


@dataclass
class Boosted:
    """A fitted model. A tree's node ``i`` has the children ``2 i`` and ``2 i + 1``; a leaf has feature -1.

    ``nodes`` holds rows of ``NODE_SCHEMA``: at most rounds * outputs * 2^(depth + 1), whatever the data.
    """

    feats: list[str]
    loss: str
    depth: int
    base: list[float]
    nodes: list[tuple] = field(default_factory=list)

    def importance(self) -> list[float]:
        """Mean gain of the splits on each feature, as shares of their sum."""
        gain, splits = np.zeros(len(self.feats)), np.zeros(len(self.feats))
        for _, _, _, f, _, _, _, g in self.nodes:
            if f >= 0:
                gain[f] += g
                splits[f] += 1
        mean = gain / np.maximum(splits, 1)
        return (mean / max(mean.sum(), 1e-300)).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        about = json.dumps({"feats": self.feats, "loss": self.loss, "depth": self.depth, "base": self.base})
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").orderBy("round", "output", "node")
        return Boosted(**about, nodes=[tuple(r) for r in nodes.collect()])  # as many as the model has


def _trees(nodes: Sequence[tuple], depth: int, cut: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(output, feature, cut, value) arrays per tree; ``cut`` is 4 for bins, 5 for thresholds."""
    found: dict[tuple[int, int], tuple] = {}
    for row in nodes:
        key = (row[0], row[1])
        if key not in found:
            size = 1 << (depth + 1)
            found[key] = (row[1], np.full(size, -1, dtype=np.int64), np.zeros(size), np.zeros(size))
        _, feature, cuts, value = found[key]
        feature[row[2]], cuts[row[2]], value[row[2]] = row[3], row[cut], row[6]
    return [found[k] for k in sorted(found)]


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node at which each row ends."""
    at, every = np.ones(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[at]
        at = np.where(f < 0, at, 2 * at + (x[every, f] > cut[at]))
    return at


def _added(x: np.ndarray, trees: Sequence[tuple], depth: int, outputs: int) -> np.ndarray:
    total = np.zeros((len(x), outputs))
    for output, feature, cut, value in trees:
        total[:, output] += value[_walk(x, feature, cut, depth)]
    return total


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _uniform(row: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) from a row's identity and the round, the same whenever a task runs again."""
    mixed = (seed * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) ^ np.uint64(mixed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _vector(feats: Sequence[str]):
    """Features in order, missing and NaN as 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in feats])


def feature_edges(df: DataFrame, feats: Sequence[str], bins: int = BINS, error: float = 1e-3) -> list[list[float]]:
    """Borders of at most ``bins`` cells per feature, from one sketch of all features in one pass."""
    x = df.select(*[_vector([f])[0].alias(f"_{i}") for i, f in enumerate(feats)])
    found = x.approxQuantile(x.columns, [i / bins for i in range(1, bins)], error)
    return [sorted(set(values)) for values in found]


def _binned(edges: Sequence[Sequence[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    borders = [np.asarray(e, dtype=float) for e in edges]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("_x"), batch.num_rows)
            cells = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(borders)], axis=1).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in cells], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("_y", "_w", "_row", "_score")], packed], names=["_y", "_w", "_row", "_score", "_bins"])

    return run


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("_bins").to_pylist()), dtype=np.uint8).reshape(-1, width)


def _moved(nodes: list[tuple], depth: int, width: int) -> Callable:
    """Add the trees in ``nodes`` to the stored scores."""

    def run(batches):
        trees = _trees(nodes, depth, 4)
        for batch in batches:
            score = _matrix(batch.column("_score"), batch.num_rows)
            score = score + _added(_unpacked(batch, width), trees, depth, score.shape[1])
            yield batch.set_column(batch.schema.get_field_index("_score"), "_score", pa.array(list(score), type=pa.list_(pa.float64())))

    return run


def _cells(nodes: list[tuple], open_trees: list[tuple], level: int, columns: list[list[int]], loss: str, depth: int, width: int, share: float, seed: int, turn: int) -> Callable:
    """Histograms of gradients for the nodes of one level of all trees of a round: one sum per task and cell."""
    first, count, outputs = 1 << level, 1 << level, len(columns)

    def run(batches):
        trees = _trees(nodes, depth, 4)
        growing = {t[0]: t for t in _trees(open_trees, depth, 4)}
        empty = np.full(2 << depth, -1, dtype=np.int64), np.zeros(2 << depth)
        sums = [np.zeros((2, len(c), count * (BINS + 1))) for c in columns]
        for batch in batches:
            y, w = batch.column("_y").to_numpy(), batch.column("_w").to_numpy()
            bins, score = _unpacked(batch, width), _matrix(batch.column("_score"), batch.num_rows)
            drawn = _uniform(batch.column("_row").to_numpy(), seed, turn) < share
            y, w, bins, score = y[drawn], w[drawn], bins[drawn], score[drawn]
            if not len(y):
                continue
            score = score + _added(bins, trees, depth, outputs)
            if loss == "softmax":
                p = _softmax(score)
                g, h = p - (y[:, None] == np.arange(outputs)), 2 * p * (1 - p)
            else:
                g, h = score - y[:, None], np.ones_like(score)
            g, h = np.rint(g * w[:, None] * UNIT), np.rint(h * w[:, None] * UNIT)
            for k in range(outputs):
                _, feature, cut = growing[k][:3] if k in growing else (k, *empty)
                at = _walk(bins, feature, cut, level) - first
                here = at >= 0  # the others ended above
                base = at[here] * (BINS + 1)
                for i, f in enumerate(columns[k]):
                    cell = base + bins[here, f]
                    sums[k][0, i] += np.bincount(cell, g[here, k], count * (BINS + 1))
                    sums[k][1, i] += np.bincount(cell, h[here, k], count * (BINS + 1))
        for k, (own, cols) in enumerate(zip(sums, columns)):
            i, cell = np.nonzero((own[0] != 0) | (own[1] != 0))
            if len(i):
                data = [np.full(len(i), k), first + cell // (BINS + 1), np.asarray(cols)[i], cell % (BINS + 1)]
                ints = [pa.array(v.astype(np.int32)) for v in data]
                longs = [pa.array(own[j][i, cell].astype(np.int64)) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ints, *longs], names=["output", "node", "feature", "bin", "g", "h"])

    return run


def best_splits(cells: DataFrame, l2: float, child_weight: float) -> DataFrame:
    """The split of largest gain per (output, node), ties to the first feature and cell; gain -1 where none is allowed.

    A group of the running sums is one histogram, at most ``BINS`` cells. A task's cells are distinct, so they are dealt by
    histogram before they are added, which serves the sums and the running sums with one shuffle.
    """
    by = ["output", "node", "feature"]
    whole = F.lit(UNIT)
    total = cells.repartition(*by).groupBy(*by, "bin").agg(*[(F.sum(F.col(c).cast("decimal(20,0)"))).alias(c) for c in ("g", "h")])
    one, running = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{c}{s}": (F.sum(c).over(w).cast("double") / whole) for c in ("g", "h") for s, w in (("l", running), ("t", one))}
    cut = total.select(*by, "bin", *[e.alias(n) for n, e in sums.items()])

    def fit(g, h):
        return g * g / (h + l2)

    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    allowed = (F.col("hl") >= child_weight) & (hr >= child_weight)
    gain = F.when(allowed, fit(F.col("gl"), F.col("hl")) + fit(gr, hr) - fit(F.col("gt"), F.col("ht"))).otherwise(-1.0)
    cut = cut.withColumn("gain", gain)
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    best = F.max_by(F.struct("feature", "bin", "gl", "hl", "gt", "ht", "gain"), order)
    return cut.groupBy("output", "node").agg(best.alias("s")).select("output", "node", "s.*")


def fit_boosted(
    df: DataFrame,
    feats: Sequence[str],
    label: str,
    outputs: int = 1,
    weight: str | None = None,
    ids: Sequence[str] = ("city", "datetime"),
    rounds: int = 500,
    depth: int = 6,
    rate: float = 0.04,
    subsample: float = 0.8,
    columns: float = 0.75,
    l2: float = 1.0,
    child_weight: float = 1.0,
    seed: int = 42,
    edges: Sequence[Sequence[float]] | None = None,
    store_every: int = 10,
    stage: Stage = stage_table,
) -> Boosted:
    """One boosting over ``outputs`` classes by softmax, or of a value by squared error when ``outputs`` is 1.

    Every round grows one tree per class, all of them level by level in the same pass: a task sums gradients per
    (class, node, feature, cell), Spark adds the sums and picks the splits, and at most classes * 2^level splits come to the
    driver. The table of cells is stored; every ``store_every`` rounds the scores are stored with it, so a pass walks at most that many
    rounds of trees. Rows of a round are drawn by the hash of ``ids``, ``columns`` is the share of features of a tree. Rows without
    a label are left out; without rows the model has no trees. Numbers of classes are 0 to ``outputs`` - 1.
    """
    feats = list(feats)
    loss = "softmax" if outputs > 1 else "squared"
    known = df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    edges = feature_edges(known, feats) if edges is None else edges
    mean = known.agg(F.avg(F.col(label).cast("double"))).first()[0] if loss == "squared" else None
    base = [mean or 0.0] * outputs
    ids = [c for c in ids if c in df.columns] or feats
    rows = known.select(
        F.col(label).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        F.xxhash64(*ids).alias("_row"),
        F.array(*[F.lit(float(b)) for b in base]).alias("_score"),
        _vector(feats).alias("_x"),
    )
    schema = "_y double, _w double, _row bigint, _score array<double>, _bins binary"
    state = stage(rows.mapInArrow(_binned(edges), schema), "boosting")
    model, width, pending = Boosted(feats, loss, depth, base), len(feats), []
    if state.isEmpty():
        return model
    for turn in range(rounds):
        if turn and turn % store_every == 0:
            state, pending = stage(state.mapInArrow(_moved(pending, depth, width), schema), "boosting"), []
        draw = np.random.default_rng([seed, turn])
        some = [sorted(draw.choice(width, max(1, round(columns * width)), replace=False).tolist()) for _ in range(outputs)]
        grown = _grow(state, pending, turn, some, loss, depth, width, edges, rate, subsample, l2, child_weight, seed)
        pending = pending + grown
        model.nodes += grown
    return model


def _grow(state, pending, turn, columns, loss, depth, width, edges, rate, share, l2, child_weight, seed) -> list[tuple]:
    """The nodes of one round's trees."""
    tree: dict[tuple[int, int], tuple] = {}
    for level in range(depth):
        run = _cells(pending, list(tree.values()), level, columns, loss, depth, width, share, seed, turn)
        splits = best_splits(state.mapInArrow(run, CELL_SCHEMA), l2, max(child_weight, 1e-9)).collect()  # outputs * 2^level rows at most
        for s in splits:
            if level == 0:
                tree[s.output, 1] = (turn, s.output, 1, -1, 0, 0.0, -rate * s.gt / (s.ht + l2), 0.0)
            if s.gain <= 1e-12:
                continue
            threshold = float(edges[s.feature][s.bin])
            tree[s.output, s.node] = (turn, s.output, s.node, s.feature, s.bin, threshold, 0.0, s.gain)
            for child, g, h in ((2 * s.node, s.gl, s.hl), (2 * s.node + 1, s.gt - s.gl, s.ht - s.hl)):
                tree[s.output, child] = (turn, s.output, child, -1, 0, 0.0, -rate * g / (h + l2), 0.0)
        if all(s.gain <= 1e-12 for s in splits):
            break
    return [tree[k] for k in sorted(tree)]


def boosted_scores(df: DataFrame, model: Boosted, name: str = "prob") -> DataFrame:
    """Add ``name``: class probabilities, or the value in an array of one. Every row comes back once."""
    trees, depth, base, loss = _trees(model.nodes, model.depth, 5), model.depth, np.asarray(model.base), model.loss

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        values = _matrix(x, len(x))
        out = base + _added(values, trees, depth, len(base))
        return pa.array(list(_softmax(out) if loss == "softmax" else out), type=pa.list_(pa.float64()))

    return df.withColumn(name, score(_vector(model.feats)))
