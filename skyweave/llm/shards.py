"""Longest-processing-time scheduling of documents into shards; equal texts stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import stage_table


def lpt(sizes: list[tuple], shards: int) -> dict:
    """Shard of each item: the largest first, each to the shard with the fewest bytes so far (ties: the lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[key] = shard
    return out


def _items(rows: DataFrame, shards: int, parts: int) -> tuple[DataFrame, dict]:
    """Large groups alone and bundles of small ones, with bytes and rows; at most 2 x shards x parts of them.

    A group is large if it holds at least one part of all bytes, so that there are at most shards x parts of those. The
    others are bundled by hash.
    """
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    bytes_, n = int(total["b"] or 0), int(total["n"])
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    large = F.col("bytes") * F.lit(shards * parts) >= F.lit(bytes_)
    bundle = F.struct(F.pmod("h1", F.lit(shards * parts)).alias("a"), F.lit(None).cast("bigint").alias("b"))
    items = groups.groupBy(F.when(large, F.struct(F.col("h1").alias("a"), F.col("h2").alias("b"))).otherwise(bundle).alias("item")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return items, {"n": n}


def shard_documents(docs: DataFrame, shards: int = 24, parts: int = 1000, unit: int = 50_000) -> DataFrame:
    """Shard and slot of every row; shards hold near equal bytes.

    Size: UTF-8 bytes plus 8. What must stay together: rows of equal text. Groups of at least 1/(shards x parts) of all
    bytes are items of the heap by themselves, the rest in hash bundles, so that the driver sees at most 2 x shards x parts
    sums whatever the size of the table; the map from item to shard has the same bound and is broadcast. Slots are counted in
    units: an item's rows are dealt by a hash of ``doc_id`` to units of at most 1/4096 of all rows or ``unit`` rows, so a text
    that a third of the rows share is numbered by many tasks.

    Null text: 0 bytes, crc 0, in no group. Null ``doc_id``: kept, first in its unit. Repeated rows: one slot each.
    Other columns are not read. An empty table gives no rows.
    """
    text = F.col("text")
    own = F.when(text.isNull(), F.xxhash64(F.lit("no text"), "doc_id"))
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.coalesce(own, F.xxhash64(text)).alias("h1"),
        F.coalesce(own, F.xxhash64(F.lit(1), text)).alias("h2"),
    )
    rows = stage_table(narrow, "shard-rows")
    items, total = _items(rows, shards, parts)
    sums = items.collect()  # at most 2 x shards x parts rows
    placed = lpt([((r["item"]["a"], r["item"]["b"] is None, r["item"]["b"] or 0), r["bytes"]) for r in sums], shards)
    most = max(1, min(unit, total["n"] // 4096))
    start = [0] * shards
    table = []
    for number, r in enumerate(sorted(sums, key=lambda r: (r["item"]["a"], r["item"]["b"] is None, r["item"]["b"] or 0))):
        a, b = r["item"]["a"], r["item"]["b"]
        shard = placed[(a, b is None, b or 0)]
        table.append((number, a, b, shard, start[shard], -(-r["rows"] // most)))
        start[shard] += r["rows"]
    spark = docs.sparkSession
    known = spark.createDataFrame(table, "item int, a bigint, b bigint, shard int, first bigint, units bigint")
    alone = F.broadcast(known.where("b is not null").select(F.struct("item", "shard", "first", "units").alias("alone"), F.col("a").alias("h1"), F.col("b").alias("h2")))
    bundled = F.broadcast(known.where("b is null").select(F.struct("item", "shard", "first", "units").alias("bundled"), F.col("a").alias("bundle")))
    at = rows.join(alone, ["h1", "h2"], "left").withColumn("bundle", F.pmod("h1", F.lit(shards * parts))).join(bundled, "bundle", "left")
    at = at.withColumn("at", F.coalesce("alone", "bundled")).select("doc_id", "size", "text_crc32", "h1", "h2", "at.*")
    at = at.withColumn("unit", _unit(F.col("units")))
    counts = at.groupBy("item", "unit").agg(F.count("*").alias("n"))
    before = Window.partitionBy("item").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("item", "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("item", "unit").orderBy("doc_id", "h1", "h2", "size")
    numbered = at.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(ahead, ["item", "unit"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("ahead") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _unit(units: Column) -> Column:
    return F.when(units > 1, F.pmod(F.xxhash64(F.lit("unit"), "doc_id"), units)).otherwise(F.lit(0))
