import numpy as np
from pyspark.sql import functions as F

from skyweave.llm.queries import ORACLE_SQL, QUERIES
from skyweave.llm.topk import SEGMENTS, TopK, statistics, top_k
from tests.oracle_check import compare, connect


def brute(ids, x, asking, k):
    out = []
    for q in asking:
        s = [(-int(x[i] @ x[q]), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
        out += [(ids[q], rank, i, -v) for rank, (v, i) in enumerate(sorted(s)[:k], 1)]
    return out


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op10_topk"](spark, sf_dir).toPandas()
    assert compare(got, connect(sf_dir).execute(ORACLE_SQL["op10_topk"]).df()) is None


def test_ties_blocks_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (400, 20)) / 256.0
    x[100:300] = x[100]
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")], 1), (1150, [float("inf")], 1), (None, [9.0] * 20, 1), (1200, [], 1), (1250, [0.5, -0.25], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, rank int").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), k=5, block=3).collect())
    ids = [*range(400), 1200, 1250]
    full = np.floor(256 * np.vstack([x, np.zeros((2, 20))]))
    full[-1, :2] = [128, -64]
    assert got == sorted(brute(ids, full, [i for i, v in enumerate(ids) if v % 50 == 0], 5))


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (7, [1.0]), (7, [1.0])], "vec_id int, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect()) == [(0, 1, 7, 65536), (0, 2, 7, 65536)]
    assert top_k(df, df.where("vec_id = 1")).count() == 0 and top_k(df.limit(0), df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert top_k(one, one).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (20, 64))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 4, (4000, 64)))
    for s in SEGMENTS:
        assert (statistics(x[:50], s) @ statistics(x, s).T + 1e-6 >= x[:50] @ x.T).all()
    top = TopK(np.arange(50), x[:50], 5)
    for a in range(0, 4000, 500):
        top.add(np.arange(a, a + 500), x[a : a + 500])
    assert top.exact < 0.2 * top.pairs
    assert (top.score[:, 0] == np.where(np.eye(50, 4000, dtype=bool), -np.inf, x[:50] @ x.T).max(axis=1)).all()
