"""Exact top-k inner products by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import shared_path

SEGMENTS = (1, 4, 16)
SCALE = 256.0


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is whole and finite, and those vectors as floor(256 x), shorter ones filled up with zeros."""
    n = len(column)
    values = column.flatten()
    lengths = np.zeros(n, np.int64)
    valid = np.ones(n, dtype=bool)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths[:] = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
    row = np.repeat(np.arange(n), lengths)
    valid[row[~np.isfinite(flat)]] = False
    out = np.zeros((n, int(lengths.max()) if n else 0))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0))
    keep = np.flatnonzero(valid)
    return keep, out[keep]


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) x mean and sqrt(length) x deviation of every segment.

    The squared distance of two vectors is at least that of their statistics, |q|^2 + |x|^2 - 2 s(q).s(x) in the lossless
    norms, so s(q).s(x) is the highest inner product that the distance bound leaves open.
    """
    parts = x.reshape(len(x), segments, -1)
    mean = parts.mean(axis=2)
    root = np.sqrt(parts.shape[2])
    return np.concatenate((root * mean, root * np.sqrt(np.maximum((parts**2).mean(axis=2) - mean**2, 0))), axis=1)


class TopK:
    """The best ``k`` of all candidates seen for each query of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.score = np.full((len(ids), k), -np.inf)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.pairs = self.exact = 0

    def add(self, ids: np.ndarray, x: np.ndarray, block: int = 512) -> None:
        width = -(-max(x.shape[1], self.x.shape[1], 1) // 16) * 16
        x, self.x = widen(x, width), widen(self.x, width)
        norms = np.sqrt((x**2).sum(axis=1))
        levels = [statistics(x, s) for s in SEGMENTS]
        for a in range(0, len(self.ids), block):
            self._block(slice(a, a + block), ids, x, norms, levels)

    def _block(self, rows: slice, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, levels: list[np.ndarray]) -> None:
        q, own = self.x[rows], self.ids[rows]
        low = self.score[rows, -1]
        # rounding of the statistics: a bound is raised by more than its error
        slack = 1e-9 * np.sqrt((q**2).sum(axis=1)).max(initial=0) * norms.max(initial=0) + 1e-3
        columns = np.arange(len(ids))
        alive = ids[None, :] != own[:, None]
        for segments, stats in zip(SEGMENTS, levels):
            if not len(columns):
                return
            alive &= statistics(q, segments) @ stats[columns].T + slack >= low[:, None]
            some = alive.any(axis=0)
            columns, alive = columns[some], alive[:, some]
        i, j = np.nonzero(alive)
        self.pairs += len(own) * len(ids)
        self.exact += len(i)
        if not len(i):
            return
        if len(i) > 0.05 * alive.size:
            score = (q @ x[columns].T)[i, j]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], x[columns[j[s : s + 65536]]]) for s in range(0, len(i), 65536)])
        good = score >= low[i]
        i, j, score = i[good], j[good], score[good]
        k = self.k
        who = np.concatenate((np.repeat(np.arange(len(own)), k), i))
        what = np.concatenate((self.best[rows].ravel(), ids[columns[j]]))
        score = np.concatenate((self.score[rows].ravel(), score))
        order = np.lexsort((what, -score, who))
        who, what, score = who[order], what[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        self.best[rows] = what[top].reshape(-1, k)
        self.score[rows] = score[top].reshape(-1, k)


def _search(query_ids: np.ndarray, query_x: np.ndarray, k: int) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(query_ids, query_x, k)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep, x = vectors(part.column(1))
                ids = part.column(0)
                has = ids.is_valid().to_numpy(zero_copy_only=False)[keep]
                top.add(ids.fill_null(0).to_numpy(zero_copy_only=False)[keep][has], x[has])
        i, j = np.nonzero(np.isfinite(top.score))
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(top.best[i, j]), pa.array(top.score[i, j].astype(np.int64))], schema=schema)

    return run


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """The ``k`` highest integer inner products for each query over all rows but its own ``vec_id``; ties to the smaller id.

    Both tables: ``vec_id``, ``embedding``; components count as floor(256 x). Queries are taken in blocks of about
    ``block`` vectors, the only thing that is sent to every task (bounded by the block, not by the table); for each block the
    candidates are scanned where they lie, without a shuffle. A task drops candidates by the bounds of 1, 4 and 16 segments, computes
    the survivors, and returns its best k per query; the best of those are ranked at the end. Each block's result is a
    table in the shared folder. Products are exact up to 2^53.

    Rows without ``vec_id``, null vectors and those with null or non-finite components take no part; vectors of other
    lengths count as filled up with zeros. Repeated rows are candidates each; of queries with the same ``vec_id`` the
    least vector asks. Other columns are not read. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    candidates = embeddings.select(F.col("vec_id").cast("bigint"), "embedding")
    asking = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding")
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asking = asking.where(sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asking.count() // block))
    path = shared_path(spark, "top-k")
    schema = "query_id bigint, vec_id bigint, score bigint"
    for b in range(blocks):
        rows = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        keep, x = vectors(rows.column(1).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(1).type))
        ids = rows.column(0).to_numpy()[keep]
        order = np.argsort(ids)
        candidates.mapInArrow(_search(ids[order], x[order], k), schema).write.mode("append").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(path)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
