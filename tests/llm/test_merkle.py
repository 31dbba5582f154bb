"""Merkle manifest against SQL and a plain recursive version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skyweave.llm.merkle import TOP, build_manifest, derive, digest, fold, height, in_order, missing, siblings, width
from skyweave.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle_check import compare, connect

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def plain_path(levels, place):
    out = []
    for level in levels[:-1]:
        first = place // 16 * 16
        out.append((level[first:place], level[place + 1 : first + 16]))
        place //= 16
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in sources}
    trees = {s: plain_levels([plain_leaf(r) for r in held[s]]) for s in sources}
    top = plain_levels([trees[s][-1][0] for s in sources])
    out = []
    for u, s in enumerate(sources):
        for place, r in enumerate(held[s]):
            path = plain_path(trees[s], place) + plain_path(top, u)
            leaf = plain_leaf(r)
            changed = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = plain_leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])))
            folded = changed
            for a, b in path:
                folded = sha(*a, folded, *b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(*(h for a, b in path for h in a + b)), folded, folded == top[-1][0]))
    return out


def through_query(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op13_merkle_manifest"](spark, sf_dir).toPandas()
    assert compare(got, connect(sf_dir).execute(ORACLE_SQL["op13_merkle_manifest"]).df()) is None
    assert 0 < (~got["verified"]).sum() < len(got) / 3


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 16, 17, 256, 257, 700], [3] * 40, [4500]])
def test_shapes_of_trees(spark, tmp_path, sizes):
    rng = random.Random(1)
    rows = [(i * 1000 + k, f"s{i}", "en", k, rng.choice(["Aa", "bb", None, ""]) and f"Text {k}") for i, n in enumerate(sizes) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS)
    assert through_query(spark, tmp_path, df) == sorted(brute(rows), key=str)


def test_nulls_ties_repeats_and_clashes(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "", "", 0, ""), (5, "", "É", 1, "É İ A"), (5, "", "É", 1, "É İ A"), (5, "", "É", 1, "other"), (10, "z", None, 3, None), (10, "Z", "x", 3, "A" * 100_000), (15, "é", "x", -3, "B")]
    rows += [(k, "hot", "en", k, "Same") for k in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ["key", "tree", "leaf", "rank", "part", "row", "a.b", "leaves"]:
        df = df.withColumn(name, F.lit("clash"))
    assert through_query(spark, tmp_path, df.repartition(3)) == sorted(brute(rows), key=str)
    none = build_manifest(df.limit(0))
    assert none.root is None and none.prove().count() == 0


def test_partitions_cut_trees_anywhere(spark):
    rows = [(k, f"s{k % 3}" if k % 7 else f"t{k}", "en", k, f"Text {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, COLUMNS)
    want = {r[0]: r[1:5] for r in brute(rows)}
    for part in (1, 7, 50):
        m = build_manifest(docs, part=part)
        got = {r.key: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in m.prove().collect()}
        assert got == want and m.root == want[0][2]
    some = m.prove(m.leaves.where("key % 13 = 0")).collect()
    assert {r.key: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in some} == {k: v for k, v in want.items() if k % 13 == 0}
    lacking = m.coordinates(m.leaves).groupBy("part", "tree", "level", "place").count()
    assert lacking.where("count > 1").count() == 0


def test_missing_is_the_least_union():
    rng = random.Random(4)
    for n in (1, 2, 16, 17, 100, 300, 5000):
        levels = plain_levels([sha(str(i)) for i in range(n)])
        for size in (1, 3, min(n, 40)):
            known = rng.sample(range(n), min(size, n))
            got = missing(known, "t", n)
            own = [(level, p // 16**level) for p in known for level in range(height(n) + 1)]
            beside = {(level, i) for level in range(height(n)) for p in known for i in range(p // 16 ** (level + 1) * 16, min(p // 16 ** (level + 1) * 16 + 16, width(n, level)))}
            assert {g[1:] for g in got} == beside - set(own) and len(got) == len(set(got))
            nodes = {(t, level, p): levels[level][p] for t, level, p in got} | {("t", 0, p): levels[0][p] for p in known}
            derive(nodes, known, "t", n)
            assert nodes["t", height(n), 0] == levels[-1][0]
            for p in known:
                assert fold(levels[0][p], siblings(nodes, "t", n, p)) == levels[-1][0]


def test_order_is_gapless_and_no_window_spans_the_table(spark):
    df = spark.range(5000).selectExpr("id % 3 as a", "-id as b")
    got = in_order(df, ["a", "b"], "order").orderBy("place").collect()
    assert [r.place for r in got] == list(range(5000)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)
    assert TOP == "" and digest(["a", "b"]) == sha("ab")
