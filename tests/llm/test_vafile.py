"""Top-k against all scores."""
import math

import numpy as np
from pyspark.sql import functions as F

from gatherlens.llm import vafile as V


def brute(rows, k, asked):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if asked(i):
            hits = sorted((-max(-V.LONG - 1, min(V.LONG, sum(a * b for a, b in zip(q, v)))), j)
                          for j, v in ok if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)}
    return out


def run(spark, rows, k=10, every=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("dim", F.lit(1))
    out = V.top_k(df.repartition(3), "vec_id", "embedding", F.col("v_id") % every == 0, k)
    return {tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()}


def test_equals_all_scores_with_ties(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [float(x) for x in rng.randn(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400 + i, [0.5] * 8) for i in range(40)]
    assert run(spark, rows) == brute(rows, 10, lambda i: i % 5 == 0)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, []), (None, [1.0, 1.0]), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (25, [None, 1.0]),
            (30, [1.0, 2.0, 3.0]), (35, [-1.0, 0.5]), (36, [1e-9, 1e15]), (40, [1e300, 1.0])]
    assert run(spark, rows) == brute(rows[:-1], 10, lambda i: i % 5 == 0)  # the last has a component beyond a long
    assert run(spark, rows[:1]) == set() and run(spark, rows[1:3]) == set()


def test_large_integers_are_exact():
    q = np.array([[float(1 << 40), 3.0]])
    v = np.array([[float(1 << 20), 1.0], [float(1 << 30), 0.0]])
    assert V.exact_dot(q, v).tolist() == [[(1 << 60) + 3, V.LONG]]
