"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
# Passes over a pattern's distinct words at which a further word gets dearer: the cost of repetition is convex.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)
CELL = ["pattern", "src"]


def water_fill(sizes: Sequence[int], weights: Sequence[int], total: Fraction, most: int = 2) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out = [Fraction(0)] * len(sizes)
    free, left = list(range(len(sizes))), Fraction(total)
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


class Flow:
    """Maximum flow by blocking flows, able to go on after capacities have grown."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(room)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(0)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total, out, to, room = 0, self.out, self.to, self.room
        while True:
            depth = [-1] * len(out)
            depth[s] = 0
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in out[a]:
                    if room[e] and depth[to[e]] < 0:
                        depth[to[e]] = depth[a] + 1
                        queue.append(to[e])
            if depth[t] < 0:
                return total
            at = [0] * len(out)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    most = min(room[e] for e in path)
                    total += most
                    for e in path:
                        room[e] -= most
                        room[e ^ 1] += most
                    first = next(i for i, e in enumerate(path) if not room[e])
                    a = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if room[e] and depth[to[e]] == depth[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(out[a]):
                    path.append(out[a][at[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def route(patterns: Sequence[tuple[int, dict[int, int]]], quotas: Sequence[int], most: int = 2) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources that fill the quotas with the least repetition.

    ``patterns``: distinct words, and the words of the rows per source; an edge carries at most ``most`` times those. The
    cost of a word grows with the passes over the pattern's distinct words, which depends on the pattern's sum alone:
    shortest paths are those over patterns with the fewest passes, so the flow is raised level by level.
    """
    n = len(patterns)
    flow = Flow(n + len(quotas) + 2)
    start, sink = n + len(quotas), n + len(quotas) + 1
    supply = [flow.edge(start, p, 0) for p in range(n)]
    edges = [{s: flow.edge(p, n + s, most * w) for s, w in words.items() if w} for p, (_, words) in enumerate(patterns)]
    for s, q in enumerate(quotas):
        flow.edge(n + s, sink, q)
    given, left = [0] * n, sum(quotas)
    level = 0
    while left:
        passes = LEVELS[level] if level < len(LEVELS) else LEVELS[-1] << (level - len(LEVELS) + 1)
        level += 1
        open_ = False
        for p, (distinct, words) in enumerate(patterns):
            top = most * sum(words.values())
            room = min(passes * distinct, top)
            flow.room[supply[p]] += max(0, room - given[p])
            given[p] = max(given[p], room)
            open_ |= room < top
        left -= flow.run(start, sink)
        if not open_:
            break
    return [{s: flow.room[e ^ 1] for s, e in of.items()} for of in edges]


def _patterns(rows: DataFrame, most_patterns: int, bundles: int) -> tuple[DataFrame, DataFrame, list, dict, list]:
    """What texts several sources hold: their patterns, and what the driver routes.

    ``texts`` (h1, h2, pattern) and ``parts`` (pattern, src, words, distinct, bundle) are tables; lists of (pattern or bundle,
    distinct words, words per source) are the heaviest patterns and the bundles of all others, and single the sums of the rest by source.
    """
    texts = rows.groupBy("h1", "h2", "src").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    texts = texts.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("src", "words"))).alias("parts"), F.max("size").alias("size"))
    texts = stage_table(texts.withColumn("pattern", F.when(F.size("parts") > 1, F.concat_ws(",", F.transform("parts", lambda p: p["src"].cast("string")))).otherwise("")), "mix-texts")
    parts = texts.select("pattern", "size", F.explode("parts").alias("part")).groupBy("pattern", "part.src").agg(F.sum("part.words").alias("words"), F.sum("size").alias("distinct"))
    parts = stage_table(parts.withColumn("bundle", F.pmod(F.xxhash64("pattern"), F.lit(bundles)).cast("int")), "mix-parts")
    single = {r["src"]: (r["distinct"], {r["src"]: r["words"]}) for r in parts.where("pattern = ''").collect()}  # a row per source
    several = parts.where("pattern <> ''")
    heavy = several.groupBy("pattern").agg(F.max("distinct").alias("distinct")).orderBy(F.desc("distinct"), "pattern").limit(most_patterns)
    heavy = stage_table(heavy.select("pattern"), "mix-heavy")
    of: dict[str, tuple[int, dict[int, int]]] = {}
    for r in several.join(heavy, "pattern", "left_semi").collect():  # at most most_patterns x sources rows
        of.setdefault(r["pattern"], (r["distinct"], {}))[1][r["src"]] = r["words"]
    light = several.join(heavy, "pattern", "left_anti")
    # the distinct words of a pattern stand in each of its rows and count once
    once = F.when(F.col("src") == F.split_part("pattern", F.lit(","), F.lit(1)).cast("int"), F.col("distinct")).otherwise(0)
    bundled: dict[int, list] = {}
    for r in light.groupBy("bundle", "src").agg(F.sum("words").alias("words"), F.sum(once).alias("distinct")).collect():  # at most bundles x sources rows
        of_bundle = bundled.setdefault(r["bundle"], [0, {}])
        of_bundle[0] += r["distinct"]
        of_bundle[1][r["src"]] = r["words"]
    heaviest = [(p, *of[p]) for p in sorted(of, key=lambda p: (-of[p][0], p))]
    return texts.where("pattern <> ''").select("h1", "h2", "pattern"), light, heaviest, single, [(b, *bundled[b]) for b in sorted(bundled)]


def _route_bundle(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a bundle gives to each source, routed to its patterns."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pattern", "src"])
        sources = sorted(set(rows["src"]))
        at = {s: i for i, s in enumerate(sources)}
        due = dict(zip(rows["src"], rows["due"]))
        listed: dict[str, tuple[int, dict[int, int]]] = {}
        for pattern, src, words, distinct in zip(rows["pattern"], rows["src"], rows["words"], rows["distinct"]):
            listed.setdefault(pattern, (int(distinct), {}))[1][at[src]] = int(words)
        flows = route(list(listed.values()), [int(due[s]) for s in sources], most)
        out = [(p, sources[s], w, f.get(s, 0)) for (p, (_, words)), f in zip(listed.items(), flows) for s, w in words.items()]
        return pd.DataFrame(out, columns=["pattern", "src", "words", "flow"])

    return run


def _boundary(rows: DataFrame, bucket: str, before: Column) -> DataFrame:
    """Per cell (pattern and source) the bucket in which the remainder ends, and the words of the buckets before it."""
    sums = rows.groupBy(*CELL, bucket).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"), F.first(before).alias("before"))
    ahead = Window.partitionBy(*CELL).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.col("before") + F.coalesce(F.sum("s").over(ahead), F.lit(0)))
    ends = sums.where((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("s")))
    return stage_table(ends.select(*CELL, F.col(bucket).alias(f"{bucket}_end"), F.col("ahead").alias(f"{bucket}_ahead")), f"mix-{bucket}")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), seed: int = 17, most_patterns: int = 2048, bundles: int = 2048, cut: bool = True) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (words, repeats counted).

    Size: runs other than U+0020 and U+0009 to U+000D. Sources, by code point with null last, weigh ``weights`` in turn and share
    ``share`` times all words, none above twice its size. A text that rows of several sources hold belongs to all of those: its
    copies are one membership pattern, and a flow with convex cost per pass over a pattern's distinct words decides which
    source takes how much of it. Within a pattern and source documents are taken in the order of a hash of the seed, ``doc_id``
    and text: whole passes for all, then one more for the first of them; ``cut`` takes a part of the document at the end, else
    that document is taken as a whole if at least half of it is due. No document exceeds twice its size.

    The flow goes in two steps, so that the driver's part is bounded and no overlap leaves it: the driver routes the ``most_patterns``
    heaviest patterns and ``bundles`` of all others (by hash, with their distinct words counted once); then each bundle routes what it
    gives to a source to its own patterns, by the same flow, in a group of its own. Every such share can be routed, so quotas and limits are
    exact; up to ``most_patterns`` patterns the cost is the least of all, above it the least within each bundle.

    The driver sees a row per source and ``most_patterns`` plus ``bundles`` rows by sources. Where a remainder ends is found by sums
    over 256 buckets of the hash, twice; only the rows of one bucket in 65,536 are sorted. Narrow tables are stored in the shared folder.

    Null text: size 0. Null ``source``: the last source. Null ``doc_id``: kept. Repeated rows: one result row each, rows
    that are equal in all of this may swap their share. Other columns, whatever their names, are not read. An empty table gives no rows. The hash of
    the text comes back as ``h1``, ``h2``.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("u"),
    )
    rows = stage_table(rows, "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("words")).collect()
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in sources]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    known = spark.createDataFrame([(r["source"], i, sizes[i], float(targets[i])) for i, r in enumerate(sources)], "name string, src int, source_size bigint, target double")
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    pattern_of, light, heaviest, single, bundled = _patterns(rows, most_patterns, bundles)
    whole = [*heaviest, *[("", *single[s]) for s in sorted(single)]]
    flows = route([(distinct, words) for _, distinct, words in [*whole, *bundled]], [round(t) for t in targets])
    routed = [(p, s, w, flow.get(s, 0)) for (p, _, words), flow in zip(whole, flows) for s, w in words.items()]
    cells = spark.createDataFrame(routed, "pattern string, src int, words bigint, flow bigint")
    if bundled:
        due = [(b, s, flow.get(s, 0)) for (b, _, words), flow in zip(bundled, flows[len(whole) :]) for s in words]
        due = spark.createDataFrame(due, "bundle int, src int, due bigint")
        cells = cells.union(light.join(due, ["bundle", "src"]).groupBy("bundle").applyInPandas(_route_bundle(2), cells.schema))
    passes = F.when(F.col("words") > 0, F.expr("flow div words")).otherwise(0)
    cells = stage_table(cells.select(*CELL, passes.alias("passes"), (F.col("flow") - passes * F.col("words")).alias("rest")), "mix-routed")
    # joined by measured size: a row per source, and per overlapping pattern and source
    rows = rows.join(pattern_of, ["h1", "h2"], "left").withColumn("pattern", F.coalesce("pattern", F.lit(""))).join(cells, CELL, "left")
    rows = rows.withColumn("b1", F.pmod(F.shiftright("u", 8), F.lit(256))).withColumn("b2", F.pmod("u", F.lit(256)))
    rows = stage_table(rows.select("doc_id", "source", "size", "source_size", "target", *CELL, "passes", "rest", "b1", "b2", "u", "h1", "h2"), "mix-cells")
    rows = rows.join(_boundary(rows, "b1", F.lit(0)), CELL, "left")
    rows = rows.join(_boundary(rows.where(F.col("b1") == F.col("b1_end")), "b2", F.col("b1_ahead")), CELL, "left")
    last = (F.col("b1") == F.col("b1_end")) & (F.col("b2") == F.col("b2_end"))
    early = (F.col("b1") < F.col("b1_end")) | (F.col("b1") == F.col("b1_end")) & (F.col("b2") < F.col("b2_end"))
    inside = Window.partitionBy(*CELL).orderBy("u", "doc_id", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    due = F.col("rest") - F.col("b2_ahead") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.least(F.greatest(due, F.lit(0)), F.col("size"))
    if not cut:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    done = rows.where(~F.coalesce(last, F.lit(False))).withColumn("extra", F.when(F.coalesce(early, F.lit(False)), F.col("size")).otherwise(0))
    ending = rows.where(last).withColumn("extra", part)
    every = done.unionByName(ending)
    return every.select("doc_id", "source", "size", "source_size", "target", (F.coalesce(F.col("passes"), F.lit(0)) * F.col("size") + F.col("extra")).alias("taken"), "h1", "h2")


def take_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as its share says, whole documents only; all columns, whatever their names, are kept.

    A row without words is not taken. Of repeated rows the first ones take the passes that do not divide evenly. Null columns, ties
    and empty tables: see ``mix``.
    """
    text = F.coalesce("text", F.lit(""))
    shares = mix(docs, cut=False, **options).groupBy(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("h1").alias("k_h1"), F.col("h2").alias("k_h2"))
    shares = shares.agg(F.sum("taken").alias("k_taken"), F.max("size").alias("k_size"), F.count("*").alias("k_rows")).where("k_taken > 0")
    # the row is one struct, so that its names meet no others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").alias("id"), F.col("source").alias("of"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    keys = [F.col("id").eqNullSafe(F.col("k_id")), F.col("of").eqNullSafe(F.col("k_source")), F.col("h1") == F.col("k_h1"), F.col("h2") == F.col("k_h2")]
    at = rows.join(shares, keys).withColumn("place", F.row_number().over(Window.partitionBy("k_id", "k_source", "k_h1", "k_h2").orderBy("k_h1")))
    passes = (F.col("k_taken") / F.col("k_size")).cast("bigint")
    times = F.floor(passes / F.col("k_rows")) + (F.col("place") <= passes % F.col("k_rows")).cast("bigint")
    return at.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select("document.*")
