"""Sinks and their readers.

Each result table is written once, partitioned by the key its consumers filter
on, so a reader of one city or one grain touches only that folder (partition
pruning) instead of the writer running one job per key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherlens.sources import schemas as SC


def _write(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    # Rebalanced by the key: the rows of a small key meet in one task (one file), and the
    # adaptive planner splits a key that is larger than its advisory partition size.
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_occurrence(cube: DataFrame, path: str) -> None:
    """The occurrence table (all grains) partitioned by ``grain``."""
    _write(cube, path, ["grain"])


def read_occurrence(spark: SparkSession, path: str, grain: str, city: str | None = None) -> DataFrame:
    """One grain of the occurrence table (optionally one city)."""
    df = spark.read.parquet(path).filter(F.col("grain") == grain)
    if city is not None:
        df = df.filter(F.col("city") == city)
    return df


def write_by_city(venues: DataFrame, path: str) -> None:
    """Frequent venues, one folder per city, in one job."""
    _write(venues, path, ["city"])


def read_city(spark: SparkSession, path: str, city: str) -> DataFrame:
    """The rows of one city from a table written by ``write_by_city``."""
    return spark.read.parquet(path).filter(F.col("city") == city)


def write_city_topic(event_times: DataFrame, path: str) -> None:
    """S18 writer: event times partitioned by (city, topic)."""
    _write(event_times, path, ["city", "topic"])


def read_city_topic(spark: SparkSession, path: str, city: str, topic: str) -> DataFrame:
    """The events of one (city, topic), read from that folder only."""
    return spark.read.parquet(path).filter((F.col("city") == city) & (F.col("topic") == topic))


def write_corpora(ranked: DataFrame, path: str) -> None:
    """The documents of :func:`gatherlens.operators.corpus.ranked_corpus`, each text
    once, partitioned by (split, rank)."""
    _write(ranked, path, ["split", "rank"])


def read_corpus(spark: SparkSession, path: str, split: str, topic_n: int) -> DataFrame:
    """One split of the corpus of the top ``topic_n`` topics, with ``label`` the rank
    from 0; only the folders of those ranks are read."""
    df = spark.read.parquet(path).filter((F.col("split") == split) & (F.col("rank") <= topic_n))
    return df.withColumn("label", (F.col("rank") - 1).cast("int"))


def save_model(model, path: str) -> None:
    """Persist a fitted model (``PipelineModel`` or any MLWritable), overwriting."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a model saved by :func:`save_model`."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The metrics summary (topic_num, model, f1, acc) as CSV with a header."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read a metrics summary written by :func:`write_metrics` or by hand."""
    return spark.read.schema(SC.METRICS).option("header", True).csv(path)
