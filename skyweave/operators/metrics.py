"""Classification and regression metrics from partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CLASSES, label_of
from ..session import Stage, lazy
from .order_stats import RANGE_ROWS, below_counts


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(label, pred, n): at most classes squared rows; all other metrics start from it."""
    return pred.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, classes: int = len(CLASSES)) -> DataFrame:
    """One row per true class: counts per predicted class, recall = tp / max(total, 1)."""
    per = [F.count_if(F.col("pred") == c).alias(f"pred_{c}") for c in range(classes)]
    hit = F.count_if(F.col("label") == F.col("pred"))
    total = F.count(F.lit(1))
    return pred.groupBy("label").agg(*per, (hit / F.greatest(total, F.lit(1))).alias("recall"))


def per_class(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    cells = confusion_counts(pred, by)
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col("pred").alias("cls"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("tp"),
        ),
    )
    flat = cells.select(*by, F.inline(sides))
    sums = flat.groupBy(*by, "cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    rated = sums.withColumns({"precision": _safe(F.col("tp"), F.col("predicted")), "recall": _safe(F.col("tp"), F.col("support"))})
    f1 = _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", f1)


def classification_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, f1_macro and f1_weighted."""
    table = per_class(pred, by)
    n = F.sum("support")
    return table.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )


def classification_report(pred: DataFrame) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg."""
    table = per_class(pred)
    rows = table.select(label_of("cls").alias("name"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    weighted = {c: (F.sum(F.col(c) * F.col("support")) / n) for c in ("precision", "recall", "f1")}
    overall = table.agg(
        (F.sum("tp") / n).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in weighted],
        *[e.alias(f"w_{c}") for c, e in weighted.items()],
        n.alias("support"),
    )
    none = F.lit(None).cast("double")
    tail = F.array(
        F.struct(F.lit("accuracy").alias("name"), none.alias("precision"), none.alias("recall"), F.col("acc").alias("f1"), F.col("support")),
        F.struct(F.lit("macro avg").alias("name"), F.col("m_precision").alias("precision"), F.col("m_recall").alias("recall"), F.col("m_f1").alias("f1"), F.col("support")),
        F.struct(F.lit("weighted avg").alias("name"), F.col("w_precision").alias("precision"), F.col("w_recall").alias("recall"), F.col("w_f1").alias("f1"), F.col("support")),
    )
    return rows.unionByName(overall.select(F.inline(tail)))


def roc_auc_ovr(pred: DataFrame, prob: str = "prob", classes: Sequence[int] = tuple(range(len(CLASSES))), rows: int = RANGE_ROWS) -> DataFrame:
    """One-vs-rest area under the curve per class that has positives and negatives.

    ``prob`` is an array of class probabilities. Every positive is credited with the
    negatives scored below it and half of those tied with it; scores are first reduced to
    their distinct values and cut into ranges of about ``rows``. The predictions are read once.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("cls"), F.get(F.col(prob), F.lit(c)).alias("score"), (F.col("label") == c).cast("bigint").alias("pos")) for c in classes])
    long = pred.select(F.inline(pairs))
    counts = long.groupBy("cls", "score").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    ranked = below_counts(counts, "score", ["neg", "pos"], "cls", rows)
    credit = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    area = ranked.groupBy("cls").agg(credit.alias("credit"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return area.filter((F.col("p") > 0) & (F.col("n") > 0)).select("cls", label_of("cls").alias("name"), (F.col("credit") / (F.col("p") * F.col("n"))).alias("auc"))


def macro_auc(auc: DataFrame) -> DataFrame:
    return auc.agg(F.avg("auc").alias("macro_auc"))


def regression_metrics(pred: DataFrame, target: str = "target_24h", value: str = "prediction") -> DataFrame:
    """Mean absolute error and R squared in one pass; the spread of the target is its population variance, which merges stably."""
    err = F.col(target) - F.col(value)
    both = F.when(err.isNotNull(), F.col(target))
    return pred.agg(
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(F.avg(err * err), F.var_pop(both))).alias("r2"),
    )


def overfit_verdict(gap: Column, train_test: bool = False) -> Column:
    """none below 0.03; with folds mild below 0.08 and significant above, else some."""
    if train_test:
        return F.when(gap < 0.03, "none").otherwise("some")
    return F.when(gap < 0.03, "none").when(gap < 0.08, "mild").otherwise("significant")


def fold_summary(per_fold: DataFrame, metrics: Sequence[str] = ("accuracy", "f1_macro", "f1_weighted")) -> DataFrame:
    """Per metric: mean on the training and test part, population deviation on the test part.

    ``per_fold`` has (fold, part, metrics...), part being train or test.
    """
    train = F.when(F.col("part") == "train", F.col("v"))
    test = F.when(F.col("part") == "test", F.col("v"))
    long = per_fold.unpivot(["fold", "part"], list(metrics), "metric", "v")
    return long.groupBy("metric").agg(F.avg(train).alias("train"), F.avg(test).alias("test"), F.stddev_pop(test).alias("std"))


def min_max_score(df: DataFrame, raw: str, keys: Sequence[str] = ("city",), name: str = "anomaly_score", stage: Stage = lazy) -> DataFrame:
    """1 - (raw - min) / (max - min + 1e-9) per series; bounds are a partial aggregate."""
    bounds = stage(df.groupBy(*keys).agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi")), "bounds")
    scaled = 1 - (F.col(raw) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-9))
    return df.join(bounds, list(keys), "left").withColumn(name, scaled).drop("_lo", "_hi")
