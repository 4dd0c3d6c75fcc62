import random

import numpy as np

from gatherlens.operators import quantiles as Q


def test_exact_median_matches_numpy_with_a_hot_key(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(3000)]          # a third of the rows and more
    rows += [(f"k{i % 40}", rnd.random() * 100) for i in range(2000)]
    rows += [("even", 1.0), ("even", 4.0), ("even", float("nan")), ("nan_only", float("nan"))]
    rows += [("ties", 2.0)] * 5 + [("ties", 9.0)] * 2
    rows += [("inf", float("inf")), ("inf", 2.0), ("inf", float("-inf")), ("none", None)]
    rows += [("same", 5.0)] * 2000                                  # a hot key of equal values
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in Q.exact_median(df, ["k"], "v").collect()}
    expect = {}
    for k in {r[0] for r in rows}:
        vals = [v for kk, v in rows if kk == k and v is not None and not np.isnan(v)]
        if vals:
            expect[k] = float(np.median(vals))
    assert set(got) == set(expect)
    for k in expect:
        assert abs(got[k] - expect[k]) < 1e-12, k
    ints = {r.k: r.median_value for r in Q.nan_median_int(df, ["k"], "v").collect()}
    assert ints["even"] == 2 and ints["ties"] == 2     # 2.5 rounds half-even to 2


def test_equal_values_of_a_hot_key_are_spread(spark):
    from pyspark.sql import functions as F
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(3.0).alias("v"))
    got = Q.exact_median(df, ["k"], "v").first()
    assert got.median == 3.0


def test_any_cut_points_give_the_same_medians(spark):
    """Counting and ranking agree whatever the cut points, rows in any order."""
    rnd = random.Random(3)
    rows = [(f"k{i % 5}" if i % 7 else None, float(rnd.randrange(50))) for i in range(1501)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: float(np.median([v for kk, v in rows if kk == k])) for k in {r[0] for r in rows}}
    for cuts in ([], [10.0], [float(x) for x in range(50)], None):
        for part in (1, 7):
            got = {r.k: r.median for r in Q.exact_median(df.repartition(part), ["k"], "v", cuts=cuts).collect()}
            assert got == want


def test_a_hot_value_beside_rare_ones_is_one_row_of_a_task(spark):
    rows = [("k", 5.0)] * 4000 + [("k", float(i)) for i in range(6000)] + [("k", 5.25), ("k", 4.75)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    out = Q.exact_median(df, ["k"], "v", cuts=[0.0, 4.5, 5.5])  # 5.0 shares its bucket with rare values
    assert out.first()["median"] == float(np.median([v for _, v in rows]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    wide = [("k", 5.0)] * 4000 + [("k", 4.75)] * 1500 + [("k", 5.25)] * 3000
    out = Q.exact_median(spark.createDataFrame(wide, "k string, v double"), ["k"], "v", cuts=[4.5, 5.5])
    assert out.first()["median"] == 5.0
