"""Exact medians without gathering a group in one place.

``exact_median`` cuts the value range at a fixed number of global cut points (quantiles
of all values, put into the plan as constants), counts the rows of each key and bucket,
and finds the bucket that holds the key's middle rank from running sums of those counts.
Only that bucket is ranked, by its distinct values and their counts, and not even they
where its smallest value equals its largest, so a hot key's equal values are never gathered.

The cut points only decide how rows are dealt: with any cut points the result is exact,
and nothing depends on partition ids or on a materialised order, so a recomputation
after an executor loss gives the same counts and ranks.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512


def cut_points(values: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """About ``buckets`` - 1 distinct quantiles of all values."""
    probs = [i / buckets for i in range(1, buckets)]
    return sorted({c for c in values.approxQuantile(value, probs, 0.5 / buckets) if abs(c) != float("inf")})


def exact_median(df: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS,
                 cuts: Sequence[float] | None = None) -> DataFrame:
    """(keys..., median): the exact median of the non-null, non-NaN ``value`` per key.

    Keys whose values are all null or NaN do not appear; a null key is a key.  ``cuts``
    gives the cut points; by default they are taken from the values.
    """
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("v"))
    v = v.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    cuts = cut_points(v, "v", buckets) if cuts is None else sorted(set(cuts))
    v = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="v", outputCol="b").transform(v)
    counts = v.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("c").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "b", "c", "least", "most", before.alias("before"), F.sum("c").over(whole).alias("n"))
    counts = counts.withColumns({"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2)})
    middle = counts.filter((F.col("before") <= F.col("hi")) & (F.col("before") + F.col("c") > F.col("lo")))

    def share(rank, size):
        """How often a run of equal rows from ``rank`` on holds the two middle ranks."""
        return sum(((F.col(m) >= rank) & (F.col(m) < rank + size)).cast("int") for m in ("lo", "hi"))

    flat = middle.filter("least = most").select(*keys, "least", share(F.col("before"), F.col("c")).alias("times"))
    wide = middle.filter("least < most").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b").alias("_b"),
                                                "before", "lo", "hi")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("b") == F.col("_b"))
    # Equal values are counted before they meet: a bucket is ranked by its distinct values.
    inside = v.join(wide, same).groupBy(*keys, "b", "v", "before", "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
    less = F.sum("c").over(Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("rank", F.col("before") + F.coalesce(less, F.lit(0))).select(
        *keys, F.col("v").alias("least"), share(F.col("rank"), F.col("c")).alias("times"))
    both = flat.unionByName(inside.filter("times > 0"))
    return both.groupBy(*keys).agg((F.sum(F.col("least") * F.col("times")) / 2).alias("median"))


def nan_median_int(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A19 as an aggregate: (keys..., median_value) = the exact median of the
    non-NaN values rounded half-to-even to an integer."""
    med = exact_median(df, keys, value)
    return med.select(*keys, F.bround("median", 0).cast("int").alias("median_value"))
