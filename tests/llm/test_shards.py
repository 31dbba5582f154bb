import zlib

from pyspark.sql import functions as F

from skyweave.llm.queries import QUERIES
from skyweave.llm.shards import lpt, shard_documents


def check(rows, texts, shards):
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(d for d, _ in texts if d is not None)
    place = {}
    for r in rows:
        place.setdefault(r.shard, []).append(r.slot)
    for slots in place.values():
        assert sorted(slots) == list(range(len(slots)))
    assert set(place) <= set(range(shards))


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_sharding"](spark, sf_dir).collect()
    check(rows, list(docs.items()), 24)
    groups, load = {}, [0] * 24
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        groups.setdefault(raw, set()).add(r.shard)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in groups.values())
    sizes = {}
    for r in rows:
        sizes[docs[r.doc_id]] = sizes.get(docs[r.doc_id], 0) + r.size
    want = [0] * 24
    for key, shard in lpt(list(sizes.items()), 24).items():
        want[shard] += sizes[key]
    assert max(load) <= max(want) * 1.02


def test_odd_rows(spark):
    texts = [(1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, None), (3, None), (4, ""), (5, "x" * 100000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("shard", F.lit(1)).withColumn("size", F.lit("x"))
    rows = shard_documents(df, shards=3, parts=2).collect()
    check(rows, texts, 3)
    assert len(rows) == len(texts)
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert [(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)] == [(8, 0), (8, 0)]
    assert shard_documents(df.limit(0)).count() == 0


def test_hot_text_is_numbered_in_units(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = shard_documents(df, shards=4, parts=50, unit=100).collect()
    check(rows, [(i, None) for i in range(3000)], 4)
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) == 1


def test_heap_takes_the_largest_first():
    assert lpt([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert lpt([], 2) == {}
