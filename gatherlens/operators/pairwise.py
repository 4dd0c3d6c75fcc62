"""One-vs-one linear SVM.

One ``LinearSVC`` for every pair of classes, fitted on the rows of these two only, with
regParam 1 / (C n) for the n rows of the pair.  A row's prediction is the class with most
votes; of classes with equally many the lowest, as in the reference.

The fitted model is a ``PipelineModel`` of the pair models and a ``SQLTransformer`` that
counts the votes: prediction is one projection without a shuffle, and Spark ML's own
persistence saves and loads it.
"""
from __future__ import annotations

import itertools
import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasParallelism, HasTol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.session import stored

VOTE = "_vote"


def votes_sql(classes: list[float]) -> str:
    """The statement that turns the pair models' 0/1 columns into ``prediction``."""
    won = {c: [] for c in classes}
    pairs = list(itertools.combinations(range(len(classes)), 2))
    for k, (i, j) in enumerate(pairs):
        won[classes[i]].append(f"(1D - {VOTE}{k})")
        won[classes[j]].append(f"{VOTE}{k}")
    votes = "array(" + ", ".join(" + ".join(won[c]) or "0D" for c in classes) + ")"
    names = "array(" + ", ".join(f"{c!r}D" for c in classes) + ")"
    helpers = ", ".join([f"{VOTE}{k}" for k in range(len(pairs))] + ["_votes"])
    # array_position finds the first of equal votes: the lowest class.
    return (f"SELECT * EXCEPT ({helpers}), element_at({names}, CAST(array_position(_votes, array_max(_votes)) AS INT)) AS prediction "
            f"FROM (SELECT *, {votes} AS _votes FROM __THIS__)")


class OneVsOneSVC(Estimator, HasLabelCol, HasFeaturesCol, HasMaxIter, HasTol, HasParallelism):
    """K (K - 1) / 2 linear SVMs for K classes; up to ``parallelism`` are fitted at once.

    Classes are the labels of the training rows (one row each on the driver).  Rows with a
    null label play no part.  One class only: every row is predicted as that class.  No
    labelled rows: ``ValueError``.
    """

    C = Param(Params._dummy(), "C", "weight of the losses against the margin", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, labelCol="label", featuresCol="features", C=1.0, maxIter=100, tol=1e-3, parallelism=4):
        super().__init__()
        self._setDefault(C=1.0, maxIter=100, tol=1e-3, parallelism=4)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        # Every iteration of a fit is a job: stored rows are read in partitions by bytes, not as
        # many as the input had (a rebalanced table that is kept has one for each shuffle partition).
        rows = stored(dataset.select(F.col(label).cast("double").alias("label"), F.col(features).alias(features))
                             .filter("label IS NOT NULL"), "rows")
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        classes = sorted(counts)
        total, parts = sum(counts.values()), rows.rdd.getNumPartitions()
        if not classes:
            raise ValueError("no labelled rows to fit")

        def fit(task):
            k, (low, high) = task
            pair = rows.filter(F.col("label").isin(low, high)).select(
                features, (F.col("label") == high).cast("double").alias("label"))
            share = (counts[low] + counts[high]) / total
            pair = pair.coalesce(max(1, math.ceil(parts * share)))
            svm = LinearSVC(featuresCol=features, labelCol="label", predictionCol=f"{VOTE}{k}", rawPredictionCol="",
                            maxIter=self.getMaxIter(), tol=self.getTol(),
                            regParam=1.0 / (self.getOrDefault(self.C) * (counts[low] + counts[high])))
            return svm.fit(pair)
        tasks = list(enumerate(itertools.combinations(classes, 2)))
        with ThreadPool(max(1, min(self.getParallelism(), len(tasks)))) as pool:
            models = pool.map(inheritable_thread_target(dataset.sparkSession)(fit), tasks)
        return PipelineModel(stages=[*models, SQLTransformer(statement=votes_sql(classes))])
