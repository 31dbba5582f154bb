"""Exact Jaccard self-join of shingle sets in their metric space: pivots, regions, boundaries, recursion.

Sets of different documents mostly have distance 1, the largest there is: around document pivots alone every
triangle-inequality window would hold all of them. So the method is applied where distances say something:

1. Regions. Documents that agree on a pair of min-wise hashes form a neighbourhood. Its pivots are the document that agrees most
   with others and some drawn by hash. Every document is assigned to its nearest pivots (most agreeing pairs of hashes) and the
   exact distances are computed; what lies within the radius of a pivot belongs to its region, and regions that share a document
   are one.
2. Boundary windows. A document further than the radius from everything outside its region needs no more work. By the bound below
   that is certain for all but the documents of which a fixed share of shingles lies in other regions; those are replicated to the
   next level.
3. Recursion. The boundary documents are joined among themselves with whole sets; those left after that meet in the cells of their rarest
   shingles, and the triangle inequality drops pairs whose distances to a common pivot differ by more than the radius.

Level 1 only saves work: whatever link it misses is found by 2 and 3, so that the result is exact.

Bound: order all shingles by hash. If two sets of sizes a and b share o shingles, the k-th of these is among the first a - o + k
shingles of the one and b - o + k of the other. Linked sets share at least ``threshold`` of either size, so with q(n) = n - ceil(t n) + k(n) first
shingles both hold at least k(min(a, b)) common ones there, and min(a, b) >= t max(a, b).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import freed_shuffles, stage_table

from .words import find_words, hash_words, lean, mix, text_slices

BUCKETS = 32
BITS = 1 << 26
PARITIES = 1024
# Cutting and hashing hold some 60 bytes for each byte of a slice.
SLICE_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)


class Sets:
    """Shingle sets of the rows of a slice: sorted hashes one after the other, borders, and a 128-bit hash of each set."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: int):
        rows = len(offsets) - 1
        data = _LOWER[data]
        starts, ends, row = find_words(data, offsets)
        hashes = hash_words(data, starts, ends)
        count = np.bincount(row, minlength=rows)
        first = np.cumsum(count) - count
        values, owner = [], []
        for n in range(1, words + 1):
            if n < words:
                at = first[count == n]
            else:
                at = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :]) if len(row) >= words else np.zeros(0, np.int64)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * _CHAIN + hashes[at + k]
            values.append(mix(h))
            owner.append(row[at])
        value, owner = np.concatenate(values), np.concatenate(owner)
        by_value = np.argsort(value)
        small = owner.astype(np.uint16) if rows <= 1 << 16 else owner
        order = by_value[np.argsort(small[by_value], kind="stable")]
        value, owner = value[order], owner[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.owner = value[new], owner[new]
        self.size = np.bincount(self.owner, minlength=rows)
        self.border = np.concatenate(([0], np.cumsum(self.size)))
        self.key = np.zeros((rows, 2), np.uint64)
        some = np.flatnonzero(self.size)
        if len(some):
            for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                self.key[some, k] = mix(np.add.reduceat(mix(self.value ^ np.uint64(salt)), self.border[some]) + self.size[some].astype(np.uint64))

    def minima(self) -> np.ndarray:
        """Least hash in each of 32 ranges, empty ones filled from the next one that is not."""
        rows = len(self.size)
        bucket = (self.value >> np.uint64(59)).astype(np.int64)
        slot = self.owner * BUCKETS + bucket
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        out = np.zeros(rows * BUCKETS, np.uint64)
        has = np.zeros(rows * BUCKETS, dtype=bool)
        out[slot[first]] = self.value[first]
        has[slot[first]] = True
        out, has = out.reshape(rows, BUCKETS), has.reshape(rows, BUCKETS)
        for _ in range(2):
            for b in range(BUCKETS - 1, -1, -1):
                after = (b + 1) % BUCKETS
                fill = ~has[:, b] & has[:, after]
                out[fill, b] = out[fill, after] * _CHAIN + np.uint64(1)
                has[:, b] |= fill
        return out


def _binary(keys: np.ndarray) -> pa.Array:
    n = len(keys)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys).view(np.uint8))])


def _lists(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.view(np.int64)))


def _pick(borders: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first ``lengths`` values of each of ``rows``, and their borders."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(borders[:-1][rows] - ends[:-1], lengths) + np.arange(int(ends[-1])), ends


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, Sets]]:
    for a, b, data, offsets in text_slices(column, SLICE_BYTES):
        yield a, b, Sets(data, offsets, words)


def _describe(words: int) -> Callable:
    """The columns before the text, node (null: empty set), its first 64 bits, size, and the keys of 16 pairs of minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(3), words):
                minima, n = sets.minima(), b - a
                pairs = mix(minima[:, ::2] * _CHAIN + minima[:, 1::2] + np.arange(BUCKETS // 2, dtype=np.uint64))
                empty = sets.size == 0
                node = _binary(sets.key)
                if empty.any():
                    node = pa.array([None if e else k for e, k in zip(empty.tolist(), node.to_pylist())], pa.binary())
                columns = [*[batch.column(k).slice(a, n) for k in range(3)], node, pa.array(sets.key[:, 0].view(np.int64)), pa.array(sets.size), _lists(pairs.ravel(), np.arange(n + 1) * (BUCKETS // 2))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "node", "bit", "n_shingles", "bands"])

    return run


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of size n shares at least with a set it is linked to: ceil(t n)."""
    return -(-n * percent // 100)


def extra(n: np.ndarray) -> np.ndarray:
    """k(n) of the bound."""
    return n // 8 + 1


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - needed(n, percent) + extra(n))


def held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a bitmap of 2^26 bits holds each key."""
    at = keys & np.uint64(BITS - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _emit(words: int, percent: int, nodes: np.ndarray | None, shingles: np.ndarray | None, whole: bool, others: np.ndarray | None = None) -> Callable:
    """node, size and shingles (first q(n), or whole sets), once per node and task.

    ``nodes``: bitmap of the nodes wanted, ``others``: of those not wanted. ``shingles``: bitmap of shingles in several regions: only sets of
    which it holds enough, and of those only what it holds. What the bitmaps let through in excess is dropped by later joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, sets in _sets(batch.column(0), words):
                want = sets.size > 0
                if nodes is not None:
                    want &= held(nodes, sets.key[:, 0])
                if others is not None:
                    want &= ~held(others, sets.key[:, 0])
                q = prefix(sets.size, percent)
                if shingles is not None:
                    at, ends = _pick(sets.border, np.arange(len(q)), q)
                    hits = np.concatenate(([0], np.cumsum(held(shingles, sets.value[at]))))
                    want &= hits[ends[1:]] - hits[ends[:-1]] >= extra(needed(sets.size, percent))
                rows = np.flatnonzero(want)
                if not len(rows):
                    continue
                names = [sets.key[r].tobytes() for r in rows]
                fresh = [i for i, k in enumerate(names) if k not in seen and not seen.add(k)]
                rows = rows[fresh]
                if not len(rows):
                    continue
                lengths = sets.size[rows] if whole else q[rows]
                at, ends = _pick(sets.border, rows, lengths)
                if shingles is not None:
                    inside = held(shingles, sets.value[at])
                    ends = np.concatenate(([0], np.cumsum(inside)))[ends]
                    at = at[inside]
                yield pa.RecordBatch.from_arrays([_binary(sets.key[rows]), pa.array(sets.size[rows]), _lists(sets.value[at], ends)], names=["node", "n", "shingles"])

    return run


_SETS = "node binary, n bigint, shingles array<bigint>"


def _store(df: DataFrame, name: str) -> DataFrame:
    """A stored table, whose shuffle files go once it is written."""
    with freed_shuffles(df.sparkSession):
        return stage_table(df, name)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """2^26 bits, those of the column's values set; 2^20 words at most reach the driver."""
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    with freed_shuffles(df.sparkSession):
        words = df.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node that it reaches, for every node of ``a``, ``b``.

    Rounds of taking the least label of the neighbours and then that label's own label; each round is a stored table.
    """
    both = _store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = _store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        step = _store(step, "labels")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = _store(step.join(jump, "comp").select("node", F.least("comp", "far").alias("comp"), "was"), "labels")
        if after.where("comp <> was").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")


def _close(size: Column, other: Column, percent: int) -> Column:
    """Sizes of which one is at least the threshold of the other."""
    return (100 * size >= percent * other) & (100 * other >= percent * size)


def _distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with their exact distance, and whether it lies within the radius."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.col("na") + F.col("nb")).alias("sum"))
    union = F.col("sum") - F.col("common")
    return both.select("a", "b", (1 - F.col("common") / union).alias("d"), (100 * F.col("common") >= percent * union).alias("linked"))


def _regions(nodes: DataFrame, texts: DataFrame, words: int, percent: int, nearest: int, draws: int = 2, drawn_bands: int = 4) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Distances of documents to their nearest pivots, of at most 16 + ``draws`` x ``drawn_bands`` that are looked at.

    Also a bitmap that holds all of these documents and pivots, and the whole sets of every node it holds, those in excess included.
    """
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    groups = keys.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("node").alias("least"), F.max("node").alias("most"))
    near = _store(keys.join(groups.where("least <> most").select("band", "key", "m"), ["band", "key"]), "neighbourhoods")
    near = near.join(near.groupBy("node").agg(F.sum("m").alias("degree")), "node")
    some = F.col("band") < drawn_bands
    drawn = [F.min(F.when(some, F.struct(F.xxhash64(F.lit(r), "band", "node").alias("u"), F.col("node").alias("b")))) for r in range(draws)]
    pivots = near.groupBy("band", "key").agg(F.array(F.max(F.struct(F.col("degree").alias("u"), F.col("node").alias("b"))), *drawn).alias("p"))
    pivots = pivots.select("band", "key", F.explode(F.array_distinct(F.transform("p", lambda x: x["b"]))).alias("b"))
    pairs = near.select(F.col("node").alias("a"), "band", "key").join(pivots, ["band", "key"]).where("b is not null and a <> b").select("a", "b").distinct()
    own, other = (nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bands").alias(f"k{x}"), F.col("bit").alias(f"bit_{x}")) for x in "ab")
    pairs = pairs.join(own, "a").join(other, "b").where(_close(F.col("na"), F.col("nb"), percent))
    agree = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x == y), lambda e: e))
    order = Window.partitionBy("a").orderBy(F.desc("agree"), "b")
    pairs = pairs.select("a", "b", "bit_a", "bit_b", agree.alias("agree")).withColumn("place", F.row_number().over(order))
    pairs = _store(pairs.where(F.col("place") <= nearest).drop("place", "agree"), "pivot-pairs")
    wanted = bitmap(pairs.select(F.col("bit_a").alias("bit")).union(pairs.select("bit_b")), "bit")
    sets = texts.mapInArrow(lean(_emit(words, percent, wanted, None, True)), _SETS)
    sets = _store(sets.dropDuplicates(["node"]), "pivot-sets")
    return _store(_distances(pairs, sets, percent), "pivot-distances"), sets, wanted


def _in_regions(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Sets with the region they lie in, its own for a document without links."""
    return sets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _first(sets: DataFrame, percent: int) -> DataFrame:
    """Whole sets cut to their first q(n) shingles."""
    q = F.expr(f"cast(least(n, n - (n * {percent} + 99) div 100 + n div 8 + 1) as int)")
    return sets.withColumn("shingles", F.slice("shingles", F.lit(1), q))


def _crossing(sets: DataFrame) -> DataFrame:
    """Shingles that occur in more than one region."""
    cells = sets.select(F.explode("shingles").alias("s"), F.xxhash64("comp").alias("c")).groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    return cells.where("least <> most").select("s")


def _enough(shingles: np.ndarray, percent: int) -> Callable:
    """Sets of which the bitmap holds as many shingles as a set shares at least with one it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                lists = some.column(some.schema.get_field_index("shingles"))
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                hits = np.concatenate(([0], np.cumsum(held(shingles, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)))))
                ends = np.concatenate(([0], np.cumsum(n)))
                yield some.filter(pa.array(hits[ends[1:]] - hits[ends[:-1]] >= needed(n, percent)))

    return run


def _parities() -> Callable:
    """node and, for each of 1024 classes of hashes, whether the set holds an odd number of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                lists = some.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                odd = np.bincount(row * PARITIES + (values & (PARITIES - 1)), minlength=len(lists) * PARITIES) & 1
                words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), _lists(words, np.arange(len(lists) + 1) * (PARITIES // 64))], names=["node", "parity"])

    return run


def _near_by_parity(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` whose parities differ in no more classes than linked sets of their sizes differ in shingles."""
    parities = _store(sets.select("node", "shingles").mapInArrow(lean(_parities()), "node binary, parity array<bigint>").join(sets.select("node", "n"), "node"), "boundary-parities")
    own, other = (parities.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    apart = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(PARITIES // 64)), F.lit(0))
    total = F.col("na") + F.col("nb")
    least = F.ceil(total * percent / (100 + percent))
    return pairs.join(own, "a").join(other, "b").where(apart <= total - 2 * least).select("a", "b")


def _boundary_pairs(rest: DataFrame, distances: DataFrame, percent: int) -> DataFrame:
    """Pairs of boundary documents of different regions that may be linked.

    Linked sets of sizes a and b share ceil(t (a + b) / (1 + t)) shingles at least. In any order of the shingles (here the rarest come
    first) both therefore hold as many from the first common one on, which is the cell that the pair meets in. A large family of texts
    has its common shingles last, so that a member with many of its own has too few left to meet the others at all. Of the pairs that
    meet, parities and the distances to common pivots drop those that are too far apart.
    """
    cells = rest.select("node", "n", "comp", F.explode("shingles").alias("s"))
    # shingles that the same documents hold count as one, with their number as its weight: a shared passage is one cell
    region = F.xxhash64("comp")
    held = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in range(2)]
    counted = cells.groupBy("s").agg(F.count("*").alias("df"), F.min("n").alias("least"), F.min(region).alias("c0"), F.max(region).alias("c1"), *held)
    counted = counted.where("c0 <> c1").groupBy("df", "least", "x0", "x1").agg(F.min("s").alias("s"), F.count("*").alias("weight"))
    ranked = cells.join(counted.select("s", "df", "least", "weight"), "s")
    # those of one region only join no pair; they are the first of the order, before the ones that are counted here
    node = Window.partitionBy("node")
    left = F.sum("weight").over(node.orderBy(F.desc("df"), F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a row meets sets of its own size or of others, none of which is below its cell's least
    meets = (100 + percent) * F.col("left") >= percent * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100)))
    ranked = _store(ranked.withColumn("left", left).where(meets).select("s", "node", "n", "comp", "left"), "boundary-cells")
    large, small = (ranked.select("s", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"), F.col("left").alias(f"l{x}")) for x in "ab")
    ordered = (F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") > F.col("b"))
    enough = (100 + percent) * F.least("la", "lb") >= percent * (F.col("na") + F.col("nb"))
    pairs = large.join(small, "s").where(ordered & (F.col("ca") != F.col("cb")) & _close(F.col("na"), F.col("nb"), percent) & enough)
    pairs = _store(pairs.select("a", "b").distinct(), "boundary-pairs")
    pairs = _store(_near_by_parity(pairs, rest, percent), "boundary-near")
    to_a = distances.select("a", F.col("b").alias("p"), F.col("d").alias("da"))
    to_b = distances.select(F.col("a").alias("b"), F.col("b").alias("p"), F.col("d").alias("db"))
    apart = pairs.join(to_a, "a").join(to_b, ["b", "p"]).where(F.abs(F.col("da") - F.col("db")) > 1 - percent / 100 + 1e-9)
    return pairs.join(apart.select("a", "b").distinct(), ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, nearest: int = 4) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row; ``h1``, ``h2`` (hash of the text), ``first`` (its component's first).

    Text: A-Z in lower case, words are runs other than U+0020 and U+0009 to U+000D, a set holds the distinct runs of ``words`` words;
    a shorter text is one shingle, a text without words has an empty set, which is linked with nothing. Sets are linked
    if 100 x common >= percent x union. Shingles are compared as 64-bit hashes, equal sets as 128-bit hashes. component_id:
    the least ``doc_id`` that links reach. ``nearest``: pivots that a document is compared with at level 1; any number gives
    the same result.

    Rows of equal sets are one node throughout. No group is gathered: heads and regions are found by aggregates that combine
    before the shuffle, sets are sent only for pairs, and the driver sees bitmaps of 8 MB.

    Null text: empty set. Null ``doc_id``: a row like others that cannot name a component; a component of only such rows is null.
    Repeated rows: one result row each. Other columns are not read. An empty table gives no rows.
    """
    texts = docs.select("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    rows = _store(rows.mapInArrow(lean(_describe(words)), "doc_id bigint, h1 bigint, h2 bigint, node binary, bit bigint, n_shingles bigint, bands array<bigint>"), "jaccard-rows")
    nodes = _store(rows.where("node is not null").dropDuplicates(["node"]).drop("doc_id", "h1", "h2"), "jaccard-nodes")
    distances, sets, described = _regions(nodes, texts, words, percent, nearest)
    links = distances.where("linked").select("a", "b")
    comps = components(links)
    # only nodes whose sets are stored can lie in a region with others: the rest are dealt by shingle without looking for theirs
    alone = texts.mapInArrow(lean(_emit(words, percent, None, None, False, described)), _SETS).withColumn("comp", F.col("node"))
    first = alone.unionByName(_in_regions(_first(sets, percent), comps))
    crossing = _store(_crossing(first), "crossing")
    if not crossing.isEmpty():
        # exact counts follow the bitmap, so that a full one costs a shuffle of the first shingles and no more
        hits = texts.mapInArrow(lean(_emit(words, percent, None, bitmap(crossing, "s"), False)), _SETS).dropDuplicates(["node"])
        hits = hits.select("node", "n", F.explode("shingles").alias("s")).join(crossing, "s").groupBy("node", "n").agg(F.count("*").alias("hits"))
        least = F.ceil(F.col("n") * percent / 100)
        wanted = hits.where(F.col("hits") >= F.floor(least / 8) + 1).select("node").join(nodes.select("node", "bit"), "node")
        wanted = _store(wanted, "boundary-nodes")
        rest = texts.mapInArrow(lean(_emit(words, percent, bitmap(wanted, "bit"), None, True)), _SETS)
        rest = _store(_in_regions(rest.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), comps), "boundary")
        # sets that a full bitmap lets through have too few common shingles to get a cell below
        last = _store(rest.mapInArrow(lean(_enough(bitmap(_crossing(rest), "s"), percent)), rest.schema), "boundary-last")
        if not last.isEmpty():
            more = _distances(_boundary_pairs(last, distances, percent), last, percent)
            more = _store(more.where("linked").select("a", "b"), "boundary-links")
            if not more.isEmpty():
                comps = components(links.union(more))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    least = rows.where("node is not null").groupBy("node").agg(F.min(place).alias("least"))
    least = least.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = least.groupBy("comp").agg(F.min("least").alias("head"))
    named = least.join(names, "comp").select(F.col("node").alias("named"), "head")
    out = rows.join(named, F.col("node") == F.col("named"), "left")
    empty = F.col("node").isNull()
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), "h1", "h2", (empty | (F.col("head") == place)).alias("first"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id's (ties: by text hash), of repeated rows one.

    Documents without words (null and empty texts among them) are linked with nothing and all stay. Null ``doc_id``: counts as the
    largest. Any other columns, whatever their names, are kept. An empty table gives no rows. Options: see ``jaccard_components``.
    """
    # both sides name a key alike and without nulls, so that the window finds the rows as the join has dealt them
    keys = ["id", "none", "h1", "h2"]
    own = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    stay = jaccard_components(docs, **options).where("first").select(*own, "h1", "h2", "n_shingles").groupBy(keys).agg(F.max("n_shingles").alias("w_n"))
    # the row is one struct, so that its names meet no others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *own, F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    at = rows.join(stay, keys).withColumn("place", F.row_number().over(Window.partitionBy(keys).orderBy("w_n")))
    return at.where((F.col("w_n") == 0) | (F.col("place") == 1)).select("document.*")
