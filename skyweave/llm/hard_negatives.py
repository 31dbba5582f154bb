"""Hard negatives by an inverted multi-index: cells of two half-space codebooks, visited by certified score bounds."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import shared_path, stage_table

from .topk import vectors, widen

Codebook = tuple[np.ndarray, np.ndarray]


def fit_codebook(x: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows of ``x`` in the order of their first components; the same on every run."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(words, len(distinct))).astype(int)]
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


class Slice:
    """Rows of the index in memory: inverted lists of cells, and a radius per word of either codebook."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: Codebook):
        cut = books[0].shape[1]
        halves = x[:, :cut], x[:, cut:]
        words = [nearest(h, b) for h, b in zip(halves, books)]
        used = [np.unique(w, return_inverse=True) for w in words]
        self.centres = [b[u] for b, (u, _) in zip(books, used)]
        self.radii = []
        for h, b, (u, inverse), w in zip(halves, books, used, words):
            r = np.zeros(len(u))
            np.maximum.at(r, inverse, np.sqrt(((h - b[w]) ** 2).sum(axis=1)))
            self.radii.append(r)
        self.ids, self.labels, self.x, self.cut = ids, labels, x, cut
        cell = used[0][1] * len(used[1][0]) + used[1][1]
        order = np.argsort(cell, kind="stable")
        keys, first = np.unique(cell[order], return_index=True)
        self.lists = dict(zip(keys.tolist(), np.split(order, first[1:])))
        self.norm = float(np.sqrt((x**2).sum(axis=1)).max(initial=0))

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and each word in use the highest half score a row of that word can have."""
        parts = q[:, : self.cut], q[:, self.cut :]
        return tuple(p @ c.T + np.sqrt((p**2).sum(axis=1))[:, None] * r for p, c, r in zip(parts, self.centres, self.radii))

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Cells that hold rows, with the bound of their scores, highest bound first (multi-sequence heap)."""
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        wide = len(b)
        heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
        left = len(self.lists)
        while heap and left:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < wide:
                heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))
            rows = self.lists.get(int(a[i]) * wide + int(b[j]))
            if rows is not None:
                left -= 1
                yield -bound, rows


class Best:
    """The first ``k`` rows of each of a query's windows so far: score descending, then id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in low]
        # a row below this score can enter no window any more; ties may still
        self.floor = min((float(a) for a, b in zip(low, high) if a <= b), default=np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        floors = []
        for w, (low, high) in enumerate(zip(self.low, self.high)):
            if low > high:
                continue
            s, i = self.found[w]
            floor = max(low, s[-1]) if len(s) == self.k else low
            inside = (scores >= floor) & (scores <= high)
            if inside.any():
                s, i = np.concatenate((s, scores[inside])), np.concatenate((i, ids[inside]))
                order = np.lexsort((i, -s))[: self.k]
                s, i = s[order], i[order]
                self.found[w] = s, i
                floor = max(low, s[-1]) if len(s) == self.k else low
            floors.append(floor)
        self.floor = min(floors, default=np.inf)


class Search:
    """Windows of a block of queries over any number of slices.

    same: rows of the query's own label count, its own id left out; otherwise rows of other labels.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], same: bool, k: int):
        self.ids, self.labels, self.x, self.same = ids, labels, x, same
        self.best = [Best(low, high, k) for low, high in windows]
        self.scored = 0

    def _score(self, q: int, part: Slice, rows: np.ndarray) -> None:
        fits = part.labels[rows] == self.labels[q]
        rows = rows[fits & (part.ids[rows] != self.ids[q])] if self.same else rows[~fits]
        if len(rows):
            self.scored += len(rows)
            self.best[q].add(part.x[rows] @ self.x[q], part.ids[rows])

    def seed(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> list[float]:
        """Floors that rows of a sample already reach; the sample's rows are met again in the index, so only the floors stay."""
        part = Slice(ids, labels, x, (np.zeros((1, x.shape[1] // 2)), np.zeros((1, x.shape[1] - x.shape[1] // 2))))
        floors = []
        for q, best in enumerate(self.best):
            trial = Best(best.low, best.high, best.k)
            held, self.best[q] = best, trial
            self._score(q, part, np.arange(len(ids)))
            self.best[q] = held
            floors.append(trial.floor)
        self.scored = 0
        return floors

    def add(self, part: Slice, floors: list[float] | None = None, batch: int = 256) -> None:
        """Search a slice: cells in the order of their bounds until the next bound is below every open window."""
        if not len(part.ids):
            return
        for at in range(0, len(self.ids), 1024):
            block = slice(at, at + 1024)
            first, second = part.halves(self.x[block])
            slack = 1e-9 * np.sqrt((self.x[block] ** 2).sum(axis=1)) * part.norm + 1e-3
            top = first.max(axis=1) + second.max(axis=1) + slack
            for k in range(len(top)):
                q = at + k
                best, least = self.best[q], floors[q] if floors else -np.inf
                if top[k] < max(best.floor, least):
                    continue
                held: list[np.ndarray] = []
                size = 0
                for bound, rows in part.visit(first[k], second[k]):
                    if bound + slack[k] < max(best.floor, least):
                        break
                    held.append(rows)
                    size += len(rows)
                    if size >= batch:
                        self._score(q, part, np.concatenate(held))
                        held, size = [], 0
                if held:
                    self._score(q, part, np.concatenate(held))

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(query, window, id, score)."""
        for q, best in enumerate(self.best):
            for w, (scores, ids) in enumerate(best.found):
                for s, i in zip(scores.tolist(), ids.tolist()):
                    yield int(self.ids[q]), w, i, int(s)


_FOUND = pa.schema([("query_id", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _slices(batches: Iterator[pa.RecordBatch], books: Codebook, most: int) -> Iterator[Slice]:
    """Index rows in slices of at most ``most`` and their whole vectors."""
    width = sum(b.shape[1] for b in books)
    held: list[tuple] = []
    size = 0

    def close() -> Slice:
        ids, labels, x = (np.concatenate(c) for c in zip(*held))
        held.clear()
        return Slice(ids, labels, x, books)

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            keep, x = vectors(part.column(2))
            if size and size + len(keep) > most:
                yield close()
                size = 0
            held.append((part.column(0).to_numpy(zero_copy_only=False)[keep], part.column(1).to_numpy(zero_copy_only=False)[keep], widen(x, width)))
            size += len(keep)
    if size:
        yield close()


def _search(make: Callable[[], Search], sample: tuple, books: Codebook, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, floors = make(), None
        for part in _slices(batches, books, most):
            floors = floors or search.seed(*sample)
            search.add(part, floors)
        found = list(search.rows())
        for at in range(0, len(found), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 65536]), _FOUND)], schema=_FOUND)

    return run


def _cells(books: Codebook) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, cut = sum(b.shape[1] for b in books), books[0].shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep, x = vectors(part.column(2))
                x = widen(x, width)
                cell = nearest(x[:, :cut], books[0]) * len(books[1]) + nearest(x[:, cut:], books[1])
                rows = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell, pa.int64())], names=["vec_id", "label", "embedding", "cell"])

    return run


class MultiIndex:
    """All rows with a whole vector, a label and an id, stored cell by cell, and the codebooks.

    The codebooks come from a bounded sample, the ``sample`` rows with the lowest hash of their id; every row is indexed. Rows are dealt by
    ranges of cell and id, so that a cell with a third of all rows lies in many partitions.
    """

    def __init__(self, rows: DataFrame, words: int = 32, sample: int = 4096, most: int = 16384):
        if words < 1 or sample < 1 or most < 1:
            raise ValueError("words, sample and most must be positive")
        sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(sound)
        width = rows.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 2
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "embedding").limit(sample).toArrow().combine_chunks()
        self.most, self.width = most, max(2, width)
        self.sample = self.arrays(drawn)
        x, cut = self.sample[2], self.width // 2
        self.books = fit_codebook(x[:, :cut], words), fit_codebook(x[:, cut:], words)
        schema = f"vec_id bigint, label bigint, embedding {rows.schema['embedding'].dataType.simpleString()}, cell bigint"
        celled = rows.mapInArrow(_cells(self.books), schema)
        self.rows = stage_table(celled.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"), "multi-index")

    def arrays(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and vectors of a bounded table."""
        column = rows.column("embedding").combine_chunks() if rows.num_rows else pa.array([], rows.schema.field("embedding").type)
        keep, x = vectors(column)
        return rows.column("vec_id").to_numpy()[keep].astype(np.int64), rows.column("label").to_numpy()[keep].astype(np.int64), widen(x, self.width)

    def search(self, make: Callable[[], Search]) -> DataFrame:
        """Each partition's finds for a block of queries; one scan, nothing shuffled."""
        return self.rows.select("vec_id", "label", "embedding").mapInArrow(_search(make, self.sample, self.books, self.most), "query_id bigint, window int, vec_id bigint, score bigint")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 32768, words: int = 32, sample: int = 4096) -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of other labels between ``low`` and ``high`` % of the positive's score.

    rows: ``vec_id``, ``label``, ``embedding``; ``anchors``: which of them ask. Components count as floor(256 x), a score is the integer inner
    product with the anchor (exact up to 2^53). Positives: the anchor's first ``positives`` other rows of its label by score, ties to the
    smaller id.

    Two half-space codebooks form cells. A cell's bound is the sum of the two halves', each the product with the word plus the query's
    half norm times the word's radius; a heap visits cells by that sum, and stops where it falls below what the windows of all positives
    still need, so nothing is lost. Anchors go in blocks of ``block``, of which one at a time is sent to the tasks with at most
    ``positives`` windows each; the index is scanned in place, and a task returns its own best rows only. Scores of
    the codebooks' sample are floors to start from.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Shorter vectors count as
    filled up with zeros. Repeated rows: each is a candidate; of anchors with one id the least (label, vector) asks, and rows with the
    anchor's id are none of its positives. Equal positives in a list give equal rows. Anchors without positives and positives
    without negatives give no row. Other columns are not read. An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_asks", anchors).select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding", "_asks")
    index = MultiIndex(rows.drop("_asks"), words, sample)
    asking = rows.where("_asks and label is not null and vec_id is not null and embedding is not null")
    asking = asking.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asking = stage_table(asking.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*"), "anchors")
    blocks = max(1, -(-asking.count() // block))
    pairs, mined = shared_path(spark, "positives"), shared_path(spark, "negatives")
    for b in range(blocks):
        mine_ = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b
        ids, labels, x = index.arrays(asking.where(mine_).orderBy("vec_id").toArrow().combine_chunks())
        at = shared_path(spark, "positives-of-block")
        index.search(_queries(ids, labels, x, None, positives)).write.parquet(at)
        best = _first(spark.read.parquet(at), ["query_id"], positives)
        best = stage_table(best.select("query_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")), "positives-of-block")
        # one window per positive, at most block x positives numbers
        scores = best.select("query_id", "positive_score").distinct().orderBy("query_id", F.desc("positive_score")).toArrow().combine_chunks()
        windows = _windows(ids, scores.column(0).to_numpy(), scores.column(1).to_numpy(), low, high)
        index.search(_queries(ids, labels, x, windows, negatives)).write.mode("append").parquet(mined)
        order = Window.partitionBy("query_id").orderBy(F.desc("positive_score"))
        best.withColumn("window", F.dense_rank().over(order) - 1).write.mode("append").parquet(pairs)
    found = _first(spark.read.parquet(mined), ["query_id", "window"], negatives)
    found = found.select("query_id", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return spark.read.parquet(pairs).join(found, ["query_id", "window"]).select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score", "place")


def _windows(ids: np.ndarray, query: np.ndarray, score: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and highest negative score for each distinct positive score of each query, the highest positive first."""
    first, last = np.searchsorted(query, ids), np.searchsorted(query, ids, "right")
    return [(-(-low * score[a:b] // 100), high * score[a:b] // 100) for a, b in zip(first, last)]


def _queries(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: list | None, k: int) -> Callable[[], Search]:
    def make() -> Search:
        every = np.array([-np.inf]), np.array([np.inf])
        return Search(ids, labels, x, windows if windows is not None else [every] * len(ids), windows is None, k)

    return make
