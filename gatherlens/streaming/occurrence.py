"""Incremental occurrence counts (the batch A1-A4 counts over arriving files).

The reference only processes batches; this is the same count, kept current
while new JSON-lines event files land in a folder.  New files are parsed with
the event parser, joined to the (static) group table, converted to local time,
and counted per (city, topic, bucket).  The streaming state is one count per
key, bounded by cities x topics x buckets, so no watermark is needed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatherlens.functions.scalars import day_type
from gatherlens.operators.occurrence import event_time_info
from gatherlens.sources import schemas as SC
from gatherlens.sources.entities import typed_event


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Typed events from the JSON-lines files arriving under ``path``."""
    reader = spark.readStream.schema(SC.RAW_EVENT).option("mode", "DROPMALFORMED")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed_event(reader.json(path))


def occurrence_counts(events: DataFrame, groups: DataFrame, bucket: str = "weekday",
                      weekend_start: int = 6) -> DataFrame:
    """Streaming (city, topic, [day_type,] bucket, n) counts; ``events`` may be a stream."""
    eti = event_time_info(events, groups)
    keys = ["city", "topic", bucket]
    if bucket == "hour":
        eti = eti.withColumn("day_type", day_type("weekday", weekend_start))
        keys = ["city", "topic", "day_type", "hour"]
    return eti.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def start_occurrence(events: DataFrame, groups: DataFrame, out_path: str, checkpoint: str,
                     bucket: str = "weekday", available_now: bool = False) -> StreamingQuery:
    """Run :func:`occurrence_counts` and rewrite ``out_path`` (parquet) with the
    full, current table after every micro-batch.  ``checkpoint`` must be on
    shared storage so the query restarts where it stopped."""
    counts = occurrence_counts(events, groups, bucket)

    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    writer = (counts.writeStream.outputMode("complete")
                    .option("checkpointLocation", checkpoint)
                    .foreachBatch(publish))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
