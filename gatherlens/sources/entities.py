"""Entity scans and parsers.

Raw entities arrive as JSON lines (gzip or not).  ``read_entity`` scans them with
the JSON source and a declared schema -- no inference, no Python per line -- and
``typed_*`` project the raw columns to the typed tables of
:mod:`gatherlens.sources.schemas`.  ``parse_lines`` does the same for a string
column of JSON lines that is already in a DataFrame.

Parsing rules (the reference's, with its failure cases made total):
* nested fields: ``organizer.member_id``, ``topics.urlkey`` (array of structs ->
  array of values), ``group.id`` ...
* counts and ratings: 0 becomes null; a missing value stays null.
* epoch milliseconds -> UTC wall time floored to the second, and epoch seconds.
* names and descriptions are cleaned (X5).
* groups without a category are dropped; the topic comes from the
  category -> topic table (unmapped categories keep a null topic, unless
  ``unmapped`` says otherwise: see ``category_topics``).
* a malformed line fails the job, as in the reference; ``on_error='drop'`` leaves
  such lines out, and ``rejected_lines`` returns them.
* counts are read as doubles and then cut to integers, so 3.5 is 3, not a
  malformed line.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherlens.functions import scalars as X
from gatherlens.functions.text import clean_text
from gatherlens.operators.corpus import category_topics
from gatherlens.session import materialize
from gatherlens.sources import schemas as SC

ENTITY_DIRS = {"group": "groups", "event": "events", "venue": "venues", "rsvp": "rsvps"}


# What to do with a malformed line, by the JSON reader's name for it.
MODES = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}


def read_entity(spark: SparkSession, path: str, entity: str, on_error: str = "fail") -> DataFrame:
    """The raw records of one entity under ``path`` (files or a directory).

    A malformed line fails the job; with ``on_error='drop'`` it is left out."""
    return (spark.read.schema(SC.RAW[entity])
                 .option("mode", MODES[on_error])
                 .json(path))


def _parsed(lines: DataFrame, entity: str, col: str) -> DataFrame:
    schema = T.StructType(SC.RAW[entity].fields + [T.StructField("_corrupt", T.StringType())])
    return lines.withColumn("r", F.from_json(F.col(col), schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def _well_formed():
    return F.col("r").isNotNull() & F.col("r._corrupt").isNull()


def parse_lines(lines: DataFrame, entity: str, col: str = "value", on_error: str = "fail") -> DataFrame:
    """S3-S6 on a column of JSON strings: raw struct columns.  A malformed line (null and
    blank ones too) fails the job; with ``on_error='drop'`` it is left out."""
    if on_error not in MODES:
        raise ValueError(f"on_error must be one of {sorted(MODES)}, not {on_error!r}")
    parsed, ok = _parsed(lines, entity, col), _well_formed()
    if on_error == "drop":
        return parsed.filter(ok).select("r.*").drop("_corrupt")
    checked = F.when(ok, F.col("r")).otherwise(
        F.raise_error(F.concat(F.lit(f"malformed {entity} line: "), F.coalesce(F.col(col), F.lit("null"))))
        .cast(parsed.schema["r"].dataType))
    return parsed.select(checked.alias("r")).select("r.*").drop("_corrupt")


def rejected_lines(lines: DataFrame, entity: str, col: str = "value") -> DataFrame:
    """The rows of ``lines`` that ``parse_lines(on_error='drop')`` leaves out."""
    return _parsed(lines, entity, col).filter(~F.coalesce(_well_formed(), F.lit(False))).drop("r")


def _int(c):
    return X.zero_as_null(c).cast("int")


def _dbl(c):
    return X.zero_as_null(c).cast("double")


def typed_group(raw: DataFrame, category_map: DataFrame | None = None,
                unmapped: str = "keep") -> DataFrame:
    """S3 + S7 + F1 + J6: raw groups -> typed groups with a topic."""
    g = raw.filter(F.col("category.id").isNotNull()).select(
        F.col("id").alias("group_id"),
        clean_text("name").alias("name"),
        "city", "state", "timezone",
        X.from_epoch_ms("created").alias("created"),
        _int("members").alias("members"),
        F.col("organizer.member_id").alias("organizer"),
        F.col("topics.urlkey").alias("tags"),
        _dbl("rating").alias("rating"),
        clean_text("description").alias("description"),
        "link",
        F.col("group_photo.photo_link").alias("group_photo_link"),
        F.col("category.id").alias("category"),
        "who",
        _dbl("lat").alias("lat"),
        _dbl("lon").alias("lon"),
    )
    if category_map is not None:
        g = category_topics(g, category_map, unmapped)
    else:
        g = g.withColumn("topic", F.lit(None).cast("string"))
    return g.select([f.name for f in SC.GROUP.fields])


def typed_event(raw: DataFrame) -> DataFrame:
    """S4 + S7: raw events -> typed events."""
    return raw.select(
        F.col("id").alias("event_id"),
        X.from_epoch_ms("time").alias("time"),
        _int("yes_rsvp_count").alias("yes_rsvp"),
        _dbl("rating.average").alias("rating"),
        _int("rating.count").alias("rating_count"),
        F.col("event_hosts.member_id").alias("hosts"),
        F.col("group.id").alias("group_id"),
        F.col("venue.id").alias("venue_id"),
        X.epoch_seconds("created").alias("event_create_stamp"),
        X.epoch_seconds("time").alias("event_time_stamp"),
        clean_text("name").alias("name"),
        clean_text("description").alias("description"),
        _int("maybe_rsvp_count").alias("maybe_rsvp"),
        _int("waitlist_count").alias("waitlist"),
        X.from_epoch_ms("created").alias("created"),
        X.from_epoch_ms("updated").alias("updated"),
    )


def typed_venue(raw: DataFrame) -> DataFrame:
    """S5 + S7: raw venues -> typed venues."""
    return raw.select(
        F.col("id").alias("venue_id"),
        clean_text("name").alias("name"),
        "city", "state",
        _dbl("lat").alias("lat"),
        _dbl("lon").alias("lon"),
        "zip",
        _dbl("rating").alias("rating"),
        _int("rating_count").alias("rating_count"),
        F.col("address_1").alias("address"),
    )


def typed_rsvp(raw: DataFrame) -> DataFrame:
    """S6 + S7: raw RSVPs -> typed RSVPs."""
    return raw.select(
        "rsvp_id",
        X.from_epoch_ms("created").alias("created"),
        X.from_epoch_ms("mtime").alias("mtime"),
        "response",
        F.col("member.member_id").alias("member_id"),
        F.col("event.id").alias("event_id"),
        F.col("venue.id").alias("venue_id"),
        X.epoch_seconds("created").alias("rsvp_create_stamp"),
        X.epoch_seconds("mtime").alias("rsvp_mtime_stamp"),
        F.col("group.id").alias("group_id"),
    )


def load_entity(spark: SparkSession, data_dir: str, entity: str,
                category_map: DataFrame | None = None, unmapped: str = "keep",
                dedupe: bool = False, on_error: str = "fail") -> DataFrame:
    """S1 + S7: read ``data_dir/<entities>`` and return the typed table.

    ``dedupe`` keeps one row per id (Q12); off by default, as in the reference.
    """
    raw = read_entity(spark, f"{data_dir.rstrip('/')}/{ENTITY_DIRS[entity]}", entity, on_error)
    typed = {"group": lambda r: typed_group(r, category_map, unmapped),
             "event": typed_event, "venue": typed_venue, "rsvp": typed_rsvp}[entity](raw)
    if dedupe:
        key = {"group": "group_id", "event": "event_id", "venue": "venue_id", "rsvp": "rsvp_id"}[entity]
        typed = typed.dropDuplicates([key])
    return typed


def rechunk_lines(spark: SparkSession, src: str, dest: str, part_num: int = 200,
                  max_num: int | None = None) -> None:
    """S8 + T10: copy JSON lines, in order of file name and line, into gzip files of
    ``part_num`` lines each (the last may have fewer); ``max_num`` copies the first lines only.

    Every line gets its number: a scan reads a split's lines in order, so a line's place in
    its split is the difference of row ids, and the splits' lines before it are a running sum
    over one short row per split.  Lines are dealt by the number of their file, so no task
    gets more than its files.  Gzip files cannot be split by a reader, so many small gzip
    files are what lets a later scan run in parallel.
    """
    split = ["path", "start"]
    lines = spark.read.text(src).select("value", F.monotonically_increasing_id().alias("row"),
                                        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    sizes = lines.groupBy(*split).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select(*split, "first", before.alias("before")))
    number = F.col("before") + F.col("row") - F.col("first")
    lines = lines.join(sizes, split).select("value", number.alias("line"))
    if max_num is not None:
        lines = lines.filter(F.col("line") < max_num)
    lines = lines.withColumn("file", F.floor(F.col("line") / part_num))
    # A task writes its files one after another; all but the last are full, so none is mixed.
    (lines.repartition("file").sortWithinPartitions("file", "line").select("value")
          .write.mode("overwrite").option("maxRecordsPerFile", part_num).option("compression", "gzip").text(dest))
