"""Boosting against a plain procedure over single rows, and its edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import boosting, models
from skyweave.session import shared_path

FEATS = ["a", "b", "c"]


def plain_boosting(x, y, w, outputs, edges, rounds, depth, rate, l2=1.0, least=1.0):
    """Scores of every row after the last round; every split looks at every row of its node."""
    score = np.full((len(x), outputs), y.mean() if outputs == 1 else 0.0)

    def grow(rows, g, h, level, out):
        gt, ht = g[rows].sum(), h[rows].sum()
        best = (1e-12, None)
        if level < depth:
            for f in range(x.shape[1]):
                for edge in edges[f]:
                    left = rows[x[rows, f] <= edge]
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl < least or ht - hl < least:
                        continue
                    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, edge))
        if best[1] is None:
            out[rows] += -rate * gt / (ht + l2)
            return
        f, edge = best[1]
        grow(rows[x[rows, f] <= edge], g, h, level + 1, out)
        grow(rows[x[rows, f] > edge], g, h, level + 1, out)

    for _ in range(rounds):
        if outputs == 1:
            g, h = (score - y[:, None]) * w[:, None], np.repeat(w[:, None], 1, axis=1)
        else:
            p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
            g, h = (p - np.eye(outputs)[y.astype(int)]) * w[:, None], 2 * p * (1 - p) * w[:, None]
        step = np.zeros_like(score)
        for k in range(outputs):
            grow(np.arange(len(x)), g[:, k], h[:, k], 0, step[:, k])
        score = score + step
    return score


def table(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    code = np.where(x[:, 0] > 0.7, 1, np.where(x[:, 1] + x[:, 0] > 1, 2, 0))
    value = 40 + 12 * (x[:, 0] > 0) + 5 * x[:, 2] + rng.normal(0, 0.3, n)
    rows = [("k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *map(float, x[i]), int(code[i]), float(value[i]), float(1 + i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "city string, datetime timestamp_ntz, a double, b double, c double, event_code int, v double, w double"), x, code, value


EDGES = [[-1.0, -0.3, 0.0, 0.7, 1.1], [-0.5, 0.2, 0.9], [-1.2, 0.1, 0.4, 2.0]]


@pytest.mark.parametrize("label, outputs", [("event_code", 3), ("v", 1)])
def test_equals_the_plain_procedure(spark, label, outputs):
    df, x, code, value = table(spark)
    y, w = (code if outputs > 1 else value).astype(float), 1.0 + np.arange(len(x)) % 3
    model = boosting.fit_boosted(df.repartition(5), FEATS, label, outputs, "w", rounds=4, depth=3, rate=0.3, subsample=1.0, columns=1.0, edges=EDGES, store_every=3)
    if outputs == 1:
        model_base = model.base[0]
        assert model_base == pytest.approx(value.mean())
    got = np.array([r[0] for r in boosting.boosted_scores(df, model, "s").orderBy("datetime").select("s").collect()])
    want = plain_boosting(x, y, w, outputs, EDGES, 4, 3, 0.3)
    if outputs > 1:
        want = np.exp(want) / np.exp(want).sum(axis=1, keepdims=True)
    np.testing.assert_allclose(got, want, atol=1e-4)


def test_trees_do_not_depend_on_layout(spark):
    df, *_ = table(spark)
    fits = [boosting.fit_boosted(d, FEATS, "event_code", 3, rounds=4, depth=3, edges=EDGES, store_every=s) for d, s in ((df.coalesce(1), 10), (df.repartition(7), 2))]
    assert fits[0].nodes == fits[1].nodes
    used = {(n[0], n[1]): set() for n in fits[0].nodes}
    for n in fits[0].nodes:
        used[n[0], n[1]].add(n[3])
    assert all(len(f - {-1}) <= 2 for f in used.values())  # three quarters of three features


def test_learns_and_comes_back_from_disk(spark):
    df, _, code, value = table(spark, 1500)
    held = F.hour("datetime") % 5 == 0
    model = models.fit_classifier(df.filter(~held), FEATS, algo="gbt", trees=25, depth=4, rate=0.3)
    path = shared_path(spark, "boosted")
    models.save_model(model, path)
    again = models.load_model(path)
    assert again == model
    out = models.class_probabilities(df.filter(held), again)
    assert out.filter("model_code = event_code").count() >= 0.95 * out.count()
    assert out.filter(F.abs(F.aggregate("prob", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).count() == 0
    names = [n for n, _ in models.feature_importance(model)]
    assert names[-1] == "c" and sum(v for _, v in models.feature_importance(model)) == pytest.approx(1)


def test_missing_values_empty_tables_and_single_classes(spark):
    df, *_ = table(spark, 60)
    odd = df.withColumns({"a": F.when(F.hour("datetime") > 3, F.col("a")), "b": F.when(F.hour("datetime") > 6, F.col("b")).otherwise(F.lit(float("nan")))})
    odd = odd.withColumn("event_code", F.when(F.hour("datetime") > 1, F.col("event_code")))
    model = boosting.fit_boosted(odd, FEATS, "event_code", 3, rounds=2, depth=2)
    out = boosting.boosted_scores(odd, model).collect()
    assert len(out) == 60 and all(sum(r.prob) == pytest.approx(1) for r in out)
    none = boosting.fit_boosted(df.limit(0), FEATS, "v", rounds=2)
    assert none.nodes == [] and boosting.boosted_scores(df, none, "s").filter("s[0] <> 0").count() == 0
    assert boosting.boosted_scores(df.limit(0), model).count() == 0
    same = boosting.fit_boosted(df.withColumn("v", F.lit(7.0)), FEATS, "v", rounds=2)
    assert boosting.boosted_scores(df, same, "s").filter("abs(s[0] - 7) > 1e-9").count() == 0
