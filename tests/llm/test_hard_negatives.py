"""Hard negatives against SQL and a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm.hard_negatives import Search, Slice, fit_codebook, mine
from skyweave.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle_check import compare, connect

COLUMNS = "vec_id bigint, label int, embedding array<double>"


def brute(ids, labels, x, anchors, low=50, high=95):
    out = []
    for a in anchors:
        s = x @ x[a]
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[a]), key=lambda i: (-s[i], ids[i]))
        for place, p in enumerate([i for i in order if labels[i] == labels[a]][:5], 1):
            negatives = [i for i in order if labels[i] != labels[a] and low * s[p] <= 100 * s[i] <= high * s[p]][:3]
            out += [(ids[a], ids[p], rank, ids[n], int(s[p]), int(s[n]), place) for rank, n in enumerate(negatives, 1)]
    return sorted(out)


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op12_hard_negatives"](spark, sf_dir).toPandas()
    assert len(got) and compare(got, connect(sf_dir).execute(ORACLE_SQL["op12_hard_negatives"]).df()) is None


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_equals_plain_search(spark, kind):
    rng = np.random.default_rng(7)
    n, d = 700, 9
    x = {"clusters": lambda: rng.normal(0, 1, (12, d))[rng.integers(0, 12, n)] + rng.normal(0, 0.2, (n, d)), "noise": lambda: rng.normal(0, 1, (n, d)), "ties": lambda: rng.integers(-1, 2, (n, d)) / 16}[kind]()
    x[100:330] = x[100]  # a third are copies
    labels = rng.integers(0, 3, n)
    df = spark.createDataFrame([(int(i), int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, x))], COLUMNS).repartition(4)
    got = sorted(tuple(r) for r in mine(df, F.col("vec_id") % 20 == 0, block=10, words=4, sample=64).collect())
    assert got == brute(range(n), labels, np.floor(256 * x), range(0, n, 20))


def test_odd_rows(spark):
    ok = [(0, 1, [1.0, 0.0, 0.5]), (1, 1, [1.0]), (2, 2, [0.6, 0.1]), (3, 2, [-1.0, 0.0]), (4, 1, [0.9, 0.0, 0.0]), (4, 1, [0.9, 0.0, 0.0]), (50, 3, [1.0, 1.0]), (100, 4, []), (150, 2, [0.0, 0.0, 0.0])]
    odd = [(7, None, [1.0]), (200, 1, None), (250, 1, [1.0, None]), (300, 1, [float("nan")]), (9, 2, [float("inf")]), (None, 1, [1.0])]
    df = spark.createDataFrame(ok + odd, COLUMNS)
    for name in ["rank", "score", "cell", "_asks", "a.b", "query_id"]:
        df = df.withColumn(name, F.lit("clash"))
    x = np.zeros((len(ok), 3))
    for i, r in enumerate(ok):
        x[i, : len(r[2])] = np.floor(256 * np.array(r[2]))
    got = sorted(tuple(r) for r in mine(df, F.col("vec_id") % 50 == 0).collect())
    want = brute([r[0] for r in ok], [r[1] for r in ok], x, [0, 6, 7, 8])
    assert got == want and len(want) == 9
    assert mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mine(df, F.col("vec_id") == -1).count() == 0


def parts(seed, n=3000, d=32):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(0, 60, (15, d))[rng.integers(0, 15, n)] + rng.normal(0, 6, (n, d)))
    books = fit_codebook(x[:500, : d // 2], 16), fit_codebook(x[:500, d // 2 :], 16)
    return x, Slice(np.arange(n), rng.integers(0, 4, n), x, books)


def test_cells_hold_every_row_once_in_order_of_true_bounds():
    x, part = parts(1)
    for q in x[:5]:
        first, second = part.halves(q[None])
        seen, last = [], np.inf
        for bound, rows in part.visit(first[0], second[0]):
            assert bound <= last + 1e-6 and (x[rows] @ q <= bound + 1e-3).all()
            last = bound
            seen += rows.tolist()
        assert sorted(seen) == list(range(len(x)))


def test_bounds_prune_most_rows():
    x, part = parts(2)
    every = [(np.array([-np.inf]), np.array([np.inf]))] * 60
    search = Search(np.arange(60), part.labels[:60], x[:60], every, True, 5)
    search.add(part)
    for q in range(60):
        s = x @ x[q]
        same = [i for i in range(len(x)) if i != q and part.labels[i] == part.labels[q]]
        assert search.best[q].found[0][1].tolist() == sorted(same, key=lambda i: (-s[i], i))[:5]
    assert search.scored < 0.2 * 60 * (part.labels == 0).sum()
