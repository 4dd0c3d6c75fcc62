"""One-vs-one SVM: votes by hand, one model per pair on its own rows, saved and loaded."""
import itertools
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gatherlens.operators.pairwise import OneVsOneSVC, votes_sql

CENTRES = {0.0: (4, 0), 2.0: (0, 4), 5.0: (-4, -4)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(c, [x + rng.gauss(0, .5), y + rng.gauss(0, .5)], 1.5) for c, (x, y) in CENTRES.items() for _ in range(20)]
    df = spark.createDataFrame(data + [(None, [9.0, 9.0], 0.0)], "label double, features array<double>, _votes_of double")
    return df.withColumn("features", array_to_vector("features"))


def test_votes_and_ties(spark):
    classes = [0.0, 2.0, 5.0]
    cases = list(itertools.product([0.0, 1.0], repeat=3))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, _vote0 double, _vote1 double, _vote2 double")
    df.createOrReplaceTempView("vote_cases")
    got = {r["i"]: r["prediction"] for r in spark.sql(votes_sql(classes).replace("__THIS__", "vote_cases")).collect()}
    for i, (a, b, c) in enumerate(cases):
        votes = [(1 - a) + (1 - b), a + (1 - c), b + c]
        assert got[i] == classes[int(np.argmax(votes))]  # argmax: the first of equal ones


def test_one_model_per_pair(spark, rows, tmp_path):
    model = OneVsOneSVC().fit(rows)
    svms = model.stages[:-1]
    assert len(svms) == 3
    by_class = {c: (np.array([r["features"].toArray() for r in rows.filter(F.col("label") == c).collect()])) for c in CENTRES}
    for m, (low, high) in zip(svms, itertools.combinations(sorted(CENTRES), 2)):
        margin = lambda x: x @ m.coefficients.toArray() + m.intercept  # noqa: B023, E731
        assert (margin(by_class[low]) < 0).all() and (margin(by_class[high]) > 0).all()
    out = model.transform(rows)
    assert out.columns == ["label", "features", "_votes_of", "prediction"]
    assert out.filter("label = prediction").count() == 60 and out.filter("prediction IS NULL").count() == 0
    model.write().overwrite().save(str(tmp_path / "ovo"))
    again = PipelineModel.load(str(tmp_path / "ovo")).transform(rows)
    assert [r["prediction"] for r in again.collect()] == [r["prediction"] for r in out.collect()]


def test_one_class_and_none(rows):
    one = OneVsOneSVC().fit(rows.filter("label = 2"))
    assert {r["prediction"] for r in one.transform(rows).collect()} == {2.0}
    with pytest.raises(ValueError):
        OneVsOneSVC().fit(rows.filter("label IS NULL"))


def test_fits_have_few_partitions(spark, monkeypatch):
    """A fit's jobs have tasks by bytes, whatever the number of shuffle partitions."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.linalg import Vectors

    from gatherlens.operators.pairwise import OneVsOneSVC
    df = spark.createDataFrame([(float(i % 3), Vectors.dense([float(i % 3), 1.0])) for i in range(60)], ["label", "features"])
    parts, fit = [], LinearSVC.fit
    monkeypatch.setattr(LinearSVC, "fit", lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        model = OneVsOneSVC().fit(df.repartition(3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(parts) == 3 and max(parts) <= 4
    assert all(r["label"] == r["prediction"] for r in model.transform(df).collect())
