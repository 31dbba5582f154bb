"""A Merkle manifest of a document table, with octopus multiproofs per leaf partition."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import stage_table

FAN = 16
# The tree over all sources' roots; names of source trees begin with "-" or "=".
TOP = ""
_STEPS = 3
Node = tuple[str, int, int]


def height(leaves: int, fan: int = FAN) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // fan)
        levels += 1
    return levels


def width(leaves: int, level: int, fan: int = FAN) -> int:
    """Nodes of a level."""
    return -(-leaves // fan**level)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def in_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` stored with a gapless long ``place`` by ``keys``, which must tell all rows apart that are not alike.

    Rows are dealt by range, sorted in their partition and numbered there; what lies before a partition comes from a table of one
    row per partition. No window spans the table and no key value binds rows to one task.
    """
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    stored = stage_table(sorted_, name)
    part = F.shiftright(F.col("_at"), 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return stored.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _above(hashes: Column, fan: int) -> Column:
    """The level above an array of nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / fan).cast("int")), lambda i: F.sha2(F.array_join(F.slice(hashes, i * fan + 1, F.lit(fan)), ""), 256))


def _inner(nodes: DataFrame, level: int, fan: int) -> DataFrame:
    """Up to three levels above ``level`` from one shuffle; nodes: tree, leaves, level, place, hash."""
    block = fan**_STEPS
    held = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
    wide = nodes.groupBy("tree", F.floor(F.col("place") / block).alias("block")).agg(F.max("leaves").alias("leaves"), held.alias("h0"))
    levels = []
    for step in range(1, _STEPS + 1):
        wide = wide.withColumn(f"h{step}", F.when(F.col("leaves") > F.lit(fan ** (level + step - 1)), _above(F.col(f"h{step - 1}"), fan)))
        levels.append(F.struct(F.lit(level + step).alias("level"), (F.col("block") * fan ** (_STEPS - step)).alias("first"), F.col(f"h{step}").alias("h")))
    found = wide.select("tree", "leaves", F.explode(F.array(*levels)).alias("x")).where("x.h is not null")
    return found.select("tree", "leaves", "x.level", "x.first", F.posexplode("x.h").alias("i", "hash")).select("tree", "leaves", "level", (F.col("first") + F.col("i")).alias("place"), "hash")


def inner_nodes(leaves: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """All nodes above the leaves of a forest (tree, leaves, place, hash), whose largest tree has ``most`` leaves."""
    columns = ["tree", "leaves", "level", "place", "hash"]
    last = leaves.withColumn("level", F.lit(0)).select(columns)
    out, level = last.limit(0), 0
    while level < height(most, fan):
        above = stage_table(_inner(last, level, fan), f"merkle-{level}")
        out = out.unionByName(above)
        level += _STEPS
        last = above.where(F.col("level") == level)
    return out


def missing(known: Iterable[int], tree: str, leaves: int, fan: int = FAN) -> list[Node]:
    """The least set of nodes that, with the ``known`` leaves of a tree, gives its root.

    Level by level: the nodes of a known node's run that are not known themselves are missing; the parents are known next.
    """
    out, have = [], set(known)
    for level in range(height(leaves, fan)):
        last = width(leaves, level, fan)
        runs = {i // fan for i in have}
        out += [(tree, level, i) for r in sorted(runs) for i in range(r * fan, min((r + 1) * fan, last)) if i not in have]
        have = runs
    return out


def derive(nodes: dict[Node, str], known: Iterable[int], tree: str, leaves: int, fan: int = FAN) -> None:
    """Add the shared interiors above the known leaves to ``nodes``, each computed once."""
    have = set(known)
    for level in range(height(leaves, fan)):
        last = width(leaves, level, fan)
        have = {i // fan for i in have}
        for r in have:
            nodes[tree, level + 1, r] = digest(nodes[tree, level, i] for i in range(r * fan, min((r + 1) * fan, last)))


def siblings(nodes: Mapping[Node, str], tree: str, leaves: int, place: int, fan: int = FAN) -> list[tuple[list[str], list[str]]]:
    """Of each level the nodes of the run before and after the path."""
    out = []
    for level in range(height(leaves, fan)):
        first, last = place // fan * fan, min(place // fan * fan + fan, width(leaves, level, fan))
        out.append(([nodes[tree, level, i] for i in range(first, place)], [nodes[tree, level, i] for i in range(place + 1, last)]))
        place //= fan
    return out


def fold(leaf: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = digest([*before, leaf, *after])
    return leaf


def _needed(sources: int, fan: int) -> Callable:
    """Coordinates a partition of leaves must fetch; group: one partition's runs (tree, rank, leaves, low, high)."""

    def run(runs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, rows in runs.groupby("tree", sort=False):
            known = (p for low, high in zip(rows["low"], rows["high"]) for p in range(low, high + 1))
            out += missing(known, tree, int(rows["leaves"].iloc[0]), fan)
        out += missing(runs["rank"], TOP, sources, fan)
        return pd.DataFrame(out, columns=["tree", "level", "place"]).assign(part=runs["part"].iloc[0])

    return run


def _expand(sources: int, fan: int, schema: list[str]) -> Callable:
    """Proofs of one partition from its leaves and what it fetched."""

    def run(leaves: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[Node, str] = {(t, v, p): h for t, v, p, h in zip(fetched["tree"], fetched["level"], fetched["place"], fetched["hash"])}
        trees = {}
        for tree, rows in leaves.groupby("tree", sort=False):
            n, rank = int(rows["leaves"].iloc[0]), int(rows["rank"].iloc[0])
            trees[tree] = n, rank
            nodes.update(((tree, 0, p), h) for p, h in zip(rows["place"], rows["leaf"]))
            derive(nodes, rows["place"], tree, n, fan)
            nodes[TOP, 0, rank] = nodes[tree, height(n, fan), 0]
        derive(nodes, [rank for _, rank in trees.values()], TOP, sources, fan)
        root = nodes[TOP, height(sources, fan), 0] if trees else None
        upper = {tree: siblings(nodes, TOP, sources, rank, fan) for tree, (_, rank) in trees.items()}
        subroot, proof, folded = [], [], []
        for tree, place, leaf, changed in zip(leaves["tree"], leaves["place"], leaves["leaf"], leaves["changed"]):
            n, rank = trees[tree]
            path = siblings(nodes, tree, n, place, fan) + upper[tree]
            subroot.append(nodes[TOP, 0, rank])
            proof.append(digest(h for before, after in path for h in (*before, *after)))
            folded.append(fold(leaf if changed is None else changed, path))
        return leaves.assign(subroot=subroot, root=root, proof_sha256=proof, folded_root=folded)[schema]

    return run


class Manifest:
    """Leaves of a table in order, and the nodes of their trees.

    ``leaves``: the carried columns, ``leaf``, ``changed``, ``tree``, ``leaves`` and ``rank`` of the tree, ``place`` in it and
    ``part``. ``nodes``: tree, level, place, hash of every node, leaves included, of the sources' trees and of the one over
    them (tree ``""``). ``root``: of all; none of an empty table.
    """

    def __init__(self, leaves: DataFrame, nodes: DataFrame, sources: int, fan: int):
        self.leaves, self.nodes, self.sources, self.fan = leaves, nodes, sources, fan

    @property
    def root(self) -> str | None:
        found = self.nodes.where((F.col("tree") == TOP) & (F.col("level") == height(self.sources, self.fan))).select("hash").first()
        return found["hash"] if found else None

    def coordinates(self, wanted: DataFrame) -> DataFrame:
        """Of each partition of the ``wanted`` leaves the missing nodes: part, tree, level, place.

        Rows next to each other are one run, so that a group holds runs of at most one partition.
        """
        inside = Window.partitionBy("part", "tree").orderBy("place")
        run = F.col("place") - F.row_number().over(inside)
        runs = wanted.withColumn("run", run).groupBy("part", "tree", "rank", "leaves", "run").agg(F.min("place").alias("low"), F.max("place").alias("high"))
        return runs.groupBy("part").applyInPandas(_needed(self.sources, self.fan), "tree string, level int, place bigint, part bigint")

    def prove(self, wanted: DataFrame | None = None) -> DataFrame:
        """subroot, root, proof_sha256 and folded_root of the wanted leaves (all, if not given).

        Each partition computes the coordinates it lacks, fetches them with one join, derives shared interiors once and
        expands the proofs of its leaves from them.
        """
        wanted = self.leaves if wanted is None else wanted
        fetched = self.coordinates(wanted).join(self.nodes, ["tree", "level", "place"])
        schema = f"{_types(wanted)}, subroot string, root string, proof_sha256 string, folded_root string"
        names = [*wanted.columns, "subroot", "root", "proof_sha256", "folded_root"]
        return wanted.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(_expand(self.sources, self.fan, names), schema)


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def build_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", tree: str = "source", found: Mapping[str, Column] | None = None, fan: int = FAN, part: int = 2048) -> Manifest:
    """The manifest of a table: a tree per ``tree`` value with the rows' hashes in ``key`` order, and a tree over their roots.

    A leaf is the sha256 of the row's ``columns``. ``found`` gives columns as they are met at verification instead;
    where the leaf comes out otherwise, ``changed`` holds it. Hashes are made in the scan; beyond it only keys and
    hashes move, about 100 bytes a row. Rows are numbered over the whole table by ranges, and ``part`` consecutive rows are a leaf
    partition whatever source they are from, so that neither a source with a third of all rows nor a million small sources
    makes a large or a thin group. Trees grow three levels per shuffle.

    Null values count as ``-`` in a leaf, the null source is a source of its own and stands first, rows without ``key`` stand
    first in their source. Rows of equal key stand by their hash; repeated rows are a leaf each. Columns that are not named
    are not read, whatever they are called. An empty table has no leaves and no root.
    """
    if part < 1 or fan < 2:
        raise ValueError("part must be 1 at least, fan 2")
    spark = docs.sparkSession
    plain = [F.col(_quoted(c)) for c in columns]
    met = [(found or {}).get(c, x) for c, x in zip(columns, plain)]
    leaf, now = leaf_hash(plain), leaf_hash(met)
    name = F.coalesce(F.concat(F.lit("="), F.col(_quoted(tree)).cast("string")), F.lit("-"))
    rows = docs.select(F.col(_quoted(key)).alias("key"), name.alias("tree"), leaf.alias("leaf"), (F.nullif(now, leaf) if found else F.lit(None).cast("string")).alias("changed"))
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    placed = in_order(rows, ["tree", "key", "leaf", "row"], "merkle-leaves").drop("row")
    trees = in_order(placed.groupBy("tree").agg(F.count("*").alias("leaves"), F.min("place").alias("first")), ["tree"], "merkle-sources")
    trees = stage_table(trees.withColumnRenamed("place", "rank"), "merkle-trees")
    seen = trees.agg(F.count("*").alias("n"), F.max("leaves").alias("most")).first()
    leaves = placed.withColumn("part", F.floor(F.col("place") / part)).join(trees, "tree").withColumn("place", F.col("place") - F.col("first")).drop("first")
    leaves = stage_table(leaves, "merkle-placed")
    forest = leaves.select("tree", "leaves", "place", F.col("leaf").alias("hash"))
    levels = ["tree", "leaves", "level", "place", "hash"]
    forest = forest.withColumn("level", F.lit(0)).select(levels).unionByName(inner_nodes(forest, seen["most"] or 0, fan))
    done = (F.col("leaves") <= F.pow(F.lit(fan), F.col("level"))) & ((F.col("level") == 0) | (F.col("leaves") > F.pow(F.lit(fan), F.col("level") - 1)))
    roots = forest.where(done).select("tree", "hash").join(trees.select("tree", F.col("rank").alias("place")), "tree")
    top = stage_table(roots.select(F.lit(TOP).alias("tree"), F.lit(seen["n"]).alias("leaves"), "place", "hash"), "merkle-subroots")
    top = top.withColumn("level", F.lit(0)).select(levels).unionByName(inner_nodes(top, seen["n"], fan))
    return Manifest(leaves, forest.unionByName(top).drop("leaves"), seen["n"], fan)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
