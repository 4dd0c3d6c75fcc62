import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gatherlens.operators import models as ML
from gatherlens.operators import network as N
from gatherlens.operators import textfeat as TF

ROWS = [(1, "aa bb  cc aa"), (1, " bb aa zz cc"), (2, None), (3, ""), (None, "cc cc"), (None, "  aa qq bb"), (4, "zz zz"),
        (5, "bb"), (2, "cc bb"), (6, "qq aa   bb aa"), (6, "  "), (6, "bb bb aa bb"), *[(i, "aa zz cc") for i in range(10, 40)]]


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture()
def index(spark):
    return spark.createDataFrame([("aa", 3), ("bb", 1), ("cc", 2)], "word string, id int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_looked_up_not_exploded(corpus, index, monkeypatch):
    monkeypatch.setattr(TF, "LOOKED_UP", 4)
    seqs = TF.token_sequences(corpus, index)
    assert "Generate" not in plan(seqs)
    assert sorted(map(str, seqs.collect())) == sorted(map(str, TF._joined_sequences(corpus, index).collect()))


def test_large_or_repeated_indexes_are_joined(corpus, index, monkeypatch):
    twice = index.union(index.selectExpr("word", "id + 5"))
    assert "Generate" in plan(TF.token_sequences(corpus, twice))
    monkeypatch.setattr(TF, "LOCAL_ROWS", 2)
    assert "Generate" in plan(TF.token_sequences(corpus, index))


def test_vectors_are_averaged_without_exploding(spark, monkeypatch):
    seqs = spark.createDataFrame([(1, [1, 2, 2, 9]), (2, [3]), (2, [1, 1]), (3, []), (4, None), (None, [2]), (5, [None, 1])],
                                 "doc_id long, seq array<int>")
    table = spark.createDataFrame([(0, [0., 0.]), (1, [1., .5]), (2, [0., 1.]), (2, [5., 2.]), (3, None), (None, [7., 7.])],
                                  "id int, vec array<float>")

    def rows(df):
        return sorted((str(r.doc_id), r.features.toArray().round(12).tolist()) for r in df.collect())

    means = ML.mean_sequence_vectors(seqs, table, 2)
    assert "Generate" not in plan(means)
    assert rows(means) == rows(ML._joined_vectors(seqs, table, 2))
    assert all(v == [0, 0] for _, v in rows(ML.mean_sequence_vectors(seqs, table.limit(0), 2)))
    monkeypatch.setattr(ML, "LOCAL_ROWS", 2)
    assert "Generate" in plan(ML.mean_sequence_vectors(seqs, table, 2))


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    sizes = [3, 4, 2]
    x, y, w = rng.normal(size=(50, 3)).astype(np.float32), rng.integers(0, 2, 50).astype(np.int32), rng.normal(size=26)

    def loss(w):
        return N.loss_and_gradient([(x[:30], y[:30]), (x[30:], y[30:])], w, sizes)

    at = loss(w)
    assert at[-1] == 50
    for i in range(26):
        e = np.eye(26)[i] * 1e-2
        assert abs((loss(w + e)[-2] - loss(w - e)[-2]) / 2e-2 - at[i]) < 2e-2


def test_the_fit_follows_sparks(spark):
    # Spark averages the means of blocks of 128 rows; here all blocks are full.
    rows = spark.range(0, 512, 1, 4).select((F.col("id") % 3).cast("double").alias("label"), array_to_vector(F.array(*[
        F.cos((F.col("id") % 3) * k) + (F.abs(F.xxhash64("id", F.lit(k))) % 100) / 100.0 for k in range(1, 5)])).alias("features"))
    own = ML.mlp(4, 3, hidden=(5,), max_iter=4).fit(rows)
    spark_own = MultilayerPerceptronClassifier(layers=[4, 5, 3], maxIter=4, seed=42).fit(rows)
    assert type(own) is type(spark_own)
    assert np.allclose(own.weights.toArray(), spark_own.weights.toArray(), atol=1e-3)
    assert "MultilayerPerceptronClassificationModel" in repr(own)
