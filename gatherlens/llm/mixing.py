"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its share of the target weights times the
number of all documents, divided by its own number of documents.  Each document
draws how often it is repeated by inverting the Poisson distribution of that mean
at a uniform number hashed from the seed and its doc_id; it is exploded by the
count, and the copies are shuffled globally by another hash.

Counts per source are grouped sums (combined before the shuffle).  The rates are a
staged table with one row per source, which the planner broadcasts only if its
measured size is below its threshold; beyond, it is a sort-merge join of plain
exchanges whose hot source the adaptive planner splits.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import staged

SEED = 7
# Target weight of a source of n documents: n to this power.
TEMPERATURE = 0.7
GRID = 1 << 52


def uniform(*parts) -> F.Column:
    """Uniform number in [0, 1) on a grid of 2^-52 from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(GRID))


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """First count and the distribution function from there on, up to where it is
    1 on the grid; counts before the first have less than 2^-60 together."""
    lo = max(0, math.floor(rate - 12 * math.sqrt(rate) - 30))
    hi = math.ceil(rate + 12 * math.sqrt(rate) + 30)
    k = np.arange(lo, hi + 1, dtype=np.float64)
    if rate <= 0:
        return 0, [1.0]
    steps = np.log(rate) - np.log(np.maximum(k[1:], 1))
    log_p = (lo * math.log(rate) - rate - math.lgamma(lo + 1)) + np.concatenate([[0.0], np.cumsum(steps)])
    cdf = np.cumsum(np.exp(log_p))
    return lo, cdf[: int(np.searchsorted(cdf, 1 - 2.0 ** -53)) + 1].tolist()


def _cdfs(parts):
    for pdf in parts:
        pairs = [poisson_cdf(r) for r in pdf["rate"]]
        yield pd.DataFrame({"m_source": pdf["m_source"], "rate": pdf["rate"], "m_lo": [p[0] for p in pairs],
                            "cdf": [p[1] for p in pairs]})


def rates(docs: DataFrame, source: str = "source", targets: dict | None = None,
          temperature: float = TEMPERATURE) -> DataFrame:
    """(m_source, rate, m_lo, cdf) per source.  ``targets`` maps sources to weights
    (a source it lacks has weight 0); without it the weight is n ** temperature."""
    n = F.col("n").cast("double")
    counts = docs.groupBy(F.col(f"`{source}`").alias("m_source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weight = F.pow(n, F.lit(float(temperature)))
    else:
        rows = [(None if k is None else str(k), float(v)) for k, v in targets.items()]
        given = docs.sparkSession.createDataFrame(rows, "t_source string, w double")
        counts = counts.join(given, F.col("m_source").cast("string").eqNullSafe(F.col("t_source")), "left")
        weight = F.coalesce(F.col("w"), F.lit(0.0))
    counts = staged(counts.select("m_source", "n", weight.alias("w")), "source-counts")
    all_n, all_w = counts.agg(F.sum("n"), F.sum("w")).first()
    rate = F.lit(float(all_n or 0)) * F.col("w") / F.lit(float(all_w or 1) or 1.0) / n
    kind = counts.schema["m_source"].dataType.simpleString()
    return staged(counts.select("m_source", rate.alias("rate")).mapInPandas(
        _cdfs, f"m_source {kind}, rate double, m_lo long, cdf array<double>"), "source-rates")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source: str = "source", targets: dict | None = None,
                temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each repeated by its Poisson count and shuffled globally
    (dealt to partitions by a hash of ``mix_order`` and sorted by it in each), with
    ``mix_rate`` (the source's mean), ``mix_copy`` (from 0) and ``mix_order`` (uniform
    in [0, 1), hashed from seed, doc_id and copy).

    Null sources are one source.  Rows that share a doc_id draw the same count; a
    null doc_id draws as the text 'null'.  Empty tables give no rows.  All columns of
    ``docs`` stay as they are, whatever their names (these three replace columns so named).
    """
    for c in ("mix_rate", "mix_copy", "mix_order"):
        docs = docs.drop(c)
    r = rates(docs, source, targets, temperature)
    # The row goes along as one value, so no name of its columns meets those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("key"),
                       F.col(f"`{source}`").alias("source"))
    below = F.size(F.filter(F.col("cdf"), lambda c: c <= uniform(F.lit(seed), F.col("key"))))
    copies = rows.join(r, rows["source"].eqNullSafe(r["m_source"])).withColumn(
        "n", F.when(F.col("rate") > 0, F.col("m_lo") + below).otherwise(F.lit(0)).cast("int"))
    out = copies.where("n > 0").select(
        "row", "key", F.col("rate").alias("mix_rate"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("mix_copy"))
    out = out.withColumn("mix_order", uniform(F.lit(seed), F.lit("order"), F.col("key"), F.col("mix_copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "mix_order").sortWithinPartitions("mix_order", "key").select(
        "row.*", "mix_rate", "mix_copy", "mix_order")
