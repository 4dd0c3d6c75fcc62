"""Poisson mixing: distribution, order, edges."""
import math

import pytest
from pyspark.sql import functions as F

from gatherlens.llm import mixing as M


@pytest.mark.parametrize("rate", [0.0, 1e-9, 0.3, 1.0, 7.5, 60.0, 5000.0])
def test_distribution_function(rate):
    lo, cdf = M.poisson_cdf(rate)
    assert cdf == sorted(cdf) and cdf[-1] >= 1 - 1e-9
    if rate < 100:
        total = 0.0
        for k, c in enumerate(cdf):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0
            assert abs(c - total) < 1e-9 and lo == 0


def test_means_follow_the_targets(spark):
    df = spark.range(12000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 9000, "a").when(F.col("id") < 11900, "b").alias("source"),
                                   F.lit("t").alias("text"), F.lit(5).alias("mix_copy"))
    n = {r["source"]: r["count"] for r in M.mix_sources(df, targets={"a": 1, "b": 2, None: 1}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(3000, rel=0.06) and n["b"] == pytest.approx(6000, rel=0.06) and n[None] == pytest.approx(3000, rel=0.4)
    only = M.mix_sources(df, targets={"b": 1}).select("source").distinct().collect()
    assert [r[0] for r in only] == ["b"]


def test_same_rows_however_partitioned(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    a, b = (sorted(map(tuple, M.mix_sources(x).collect())) for x in (df, df.repartition(7)))
    assert a == b and all(0 <= r[-1] < 1 for r in a)
    orders = [r["mix_order"] for r in M.mix_sources(df.coalesce(1)).collect()]
    ids = [r["doc_id"] for r in M.mix_sources(df.coalesce(1)).collect()]
    assert ids != sorted(ids) and len(set(orders)) == len(orders)


def test_edges(spark):
    schema = "doc_id long, source string, `a b` string"
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "s", None)], schema)
    out = M.mix_sources(df)
    assert out.columns == ["doc_id", "source", "a b", "mix_rate", "mix_copy", "mix_order"]
    assert out.where("doc_id = 1").count() % 2 == 0
    assert M.mix_sources(df.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["__n", "__rate", "__source", "__lo", "__cdf", "n", "row", "key", "rate", "m_source", "m_lo", "cdf", "a.b"]
    df = spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", *[f"id + {i} AS `{n}`" for i, n in enumerate(names)])
    plain = {(r["doc_id"], r["mix_copy"]) for r in M.mix_sources(df.select("doc_id", "source")).collect()}
    rows = M.mix_sources(df).collect()
    assert {(r["doc_id"], r["mix_copy"]) for r in rows} == plain
    assert all(r[n] == r["doc_id"] + i for r in rows for i, n in enumerate(names))
    dotted = df.select("doc_id", df["source"].alias("the.source"))
    assert M.mix_sources(dotted, source="the.source").count() == len(rows)
