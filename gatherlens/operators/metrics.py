"""Classification metrics and benchmark tables.

A prediction table has ``label`` and ``prediction`` and any number of key
columns (model, task, topic_num ...).  Everything is computed from the
confusion cells, so the prediction rows are read once and aggregated map-side;
the rest works on at most keys x classes^2 rows.

F1 weighting: ``weight_by='label'`` weights each class's F1 by its number of
true rows (the usual weighted F1); ``weight_by='prediction'`` weights it by the
number of rows predicted as that class, which is what the reference's published
scores compute (its metric call has the arguments swapped).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A22 + A25: (keys..., label, prediction, n, pct) with pct = share of the true class.

    All pairs of the classes that occur as label or prediction of a key are there, with
    n = 0 where no row has them; pct is null for a class without true rows.  Classes are
    collected per key (two lists as long as the number of classes).
    """
    keys = list(keys)
    cells = pred.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    classes = F.array_distinct(F.concat(F.collect_set("label"), F.collect_set("prediction")))
    grid = cells.groupBy(*keys).agg(classes.alias("c")).select(
        *keys, F.explode("c").alias("label"), "c").select(*keys, "label", F.explode("c").alias("prediction"))
    seen = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("label").alias("_label"),
                        F.col("prediction").alias("_prediction"), "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "label", "prediction"]]
    full = grid.join(seen, same, "left").select(*keys, "label", "prediction", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    per_label = F.sum("n").over(Window.partitionBy(*keys, "label"))
    return full.withColumn("pct", F.try_divide(F.col("n") * 100.0, per_label))


def class_scores(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., cls, tp, actual, predicted, f1) per class from confusion cells."""
    keys = list(keys)
    actual = cells.groupBy(*keys, F.col("label").alias("cls")).agg(F.sum("n").alias("actual"))
    predicted = cells.groupBy(*keys, F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = cells.filter(F.col("label") == F.col("prediction")) \
              .select(*keys, F.col("label").alias("cls"), F.col("n").alias("tp"))
    per = (actual.join(predicted, [*keys, "cls"], "full")
                 .join(tp, [*keys, "cls"], "left")
                 .na.fill(0, subset=["actual", "predicted", "tp"]))
    f1 = 2.0 * F.col("tp") / (F.col("actual") + F.col("predicted"))
    return per.withColumn("f1", f1)


def weighted_f1(cells: DataFrame, keys: Sequence[str] = (), weight_by: str = "label") -> DataFrame:
    """(keys..., f1) -- per-class F1 weighted by true or predicted class sizes."""
    if weight_by not in ("label", "prediction"):
        raise ValueError("weight_by must be 'label' or 'prediction'")
    w = F.col("actual") if weight_by == "label" else F.col("predicted")
    per = class_scores(cells, keys)
    return per.groupBy(*keys).agg((F.sum(F.col("f1") * w) / F.sum(w)).alias("f1"))


def accuracy(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., acc) -- share of rows whose prediction equals the label."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    return cells.groupBy(*keys).agg((F.sum(hit) / F.sum("n")).alias("acc"))


def summary(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., f1, f1_by_prediction, acc) from confusion cells in one aggregation."""
    keys = list(keys)
    per = class_scores(cells, keys)
    return per.groupBy(*keys).agg(
        (F.sum(F.col("f1") * F.col("actual")) / F.sum("actual")).alias("f1"),
        (F.sum(F.col("f1") * F.col("predicted")) / F.sum("predicted")).alias("f1_by_prediction"),
        (F.sum("tp") / F.sum("actual")).alias("acc"))


def evaluate(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., f1, f1_by_prediction, acc) for every key group of a
    prediction table; the prediction rows are read once."""
    keys = list(keys)
    cells = pred.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return summary(cells, keys)


def metric_pivot(metrics: DataFrame, row: str, column: str, metric: str = "f1",
                 values: Sequence[str] | None = None) -> DataFrame:
    """One row per ``row`` value, one column per ``column`` value (e.g. model)."""
    return metrics.groupBy(row).pivot(column, list(values) if values else None) \
                  .agg(F.first(metric))


def rank_models(metrics: DataFrame, where: dict | None = None, metric: str = "f1",
                model: str = "model") -> DataFrame:
    """Models ranked by ``metric`` descending (ties by model name)."""
    df = metrics
    for k, v in (where or {}).items():
        df = df.filter(F.col(k) == v)
    w = Window.orderBy(F.desc(metric), F.asc(model))
    return df.withColumn("rank", F.row_number().over(w))
