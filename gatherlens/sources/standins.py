"""Driver tables in the roles of the entities (FIXTURES.md section 5).

These functions rename, reshape or render (as raw JSON lines) columns of the
given parquet tables so they have the schema or format an operator expects;
the rule "predictions" and the word -> vector keying are stated in their
docstrings.  They do none of an operator's work; the operators are written for
any data with that schema.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherlens.session import table_path

# Fixed values of the stand-in mapping: region key -> time zone of the group.
REGION_TIMEZONES = [
    (0, "America/New_York"),
    (1, "America/Chicago"),
    (2, "America/Denver"),
    (3, "America/Los_Angeles"),
    (4, "UTC"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _timezone(region_key) -> F.Column:
    expr = F.when(F.lit(False), F.lit(None))
    for key, tz in REGION_TIMEZONES:
        expr = expr.when(region_key == key, F.lit(tz))
    return expr


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group := customer joined to nation: city := nation name, topic := market segment
    and the last digit of the key in base 5 (25 topics)."""
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .select(F.col("c_custkey").alias("group_id"),
                     F.col("c_name").alias("name"),
                     F.col("n_name").alias("city"),
                     F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 5).cast("string")).alias("topic"),
                     _timezone(F.col("n_regionkey")).alias("timezone")))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event := events: time := ts (UTC wall time), group_id := user_id."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("time"), F.col("user_id").alias("group_id"))


def hosted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event at a venue := line item of an order: group := customer, venue := part."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("o_custkey").alias("group_id"),
                      F.col("l_partkey").alias("venue_id")))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue := part; its point is (brand number, size / 1000) read as (lat, lon)."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("venue_id"),
                    F.col("p_name").alias("name"),
                    F.regexp_extract("p_brand", r"(\d+)$", 1).cast("double").alias("lat"),
                    (F.col("p_size").cast("double") / 1000).alias("lon"),
                    F.col("p_retailprice").alias("rating"))


def city_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city lookup := nation: lat := 11 + 10 * (key / 5) + key % 5, lon := 0.02, so each
    brand number is the latitude of one city."""
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("city"),
                    (11 + 10 * F.floor(F.col("n_nationkey") / 5) + F.col("n_nationkey") % 5).cast("double").alias("lat"),
                    F.lit(0.02).alias("lon"))


def topic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic table := the distinct document sources numbered by their digits times 10."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("topic")).distinct()
    return d.select("topic", (F.regexp_extract("topic", r"(\d+)$", 1).cast("int") * 10).alias("topic_id"))


def rated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with missing ratings: value := null for every fifth user, NaN for every
    seventh of the others."""
    e = read(spark, sf_dir, "events")
    value = F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_type", value.alias("value"))


def wide_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors of large numbers := embeddings times 1000."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 1000).alias("embedding"))


def stem_table(terms: DataFrame) -> DataFrame:
    """lemma table := the terms' first three letters (a lookup of any kind does)."""
    return terms.select("term").distinct().select("term", F.substring("term", 1, 3).alias("lemma"))


def documents(spark: SparkSession, sf_dir: str, topic: str = "source") -> DataFrame:
    """documents with a topic label column (``source``: 20 classes, ``lang``: 4)."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.col(topic).alias("topic"), "n_chars")


def rule_predictions(spark: SparkSession, sf_dir: str, min_chars: int = 1000,
                     target: str = "quality") -> DataFrame:
    """predictions := documents joined to labels; prediction := n_chars > min_chars."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = read(spark, sf_dir, "labels").select("doc_id", target)
    return (d.join(lab, "doc_id")
             .select("doc_id", F.col(target).alias("label"),
                     (F.col("n_chars") > min_chars).cast("int").alias("prediction")))


# Fixed values of the stand-in rule predictors: a document is predicted
# positive when it is longer than the threshold (in characters).
RULE_THRESHOLDS = (500, 1000, 2000)
RULE_TARGETS = ("quality", "toxic")


def rule_sweep_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions of several rule "models" on several label columns:
    (task, model, doc_id, label, prediction), one row per document, task and model."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = read(spark, sf_dir, "labels")
    runs = F.array(*[
        F.struct(F.lit(t).alias("task"), F.lit(f"chars_gt_{m}").alias("model"),
                 F.col(t).alias("label"), (F.col("n_chars") > m).cast("int").alias("prediction"))
        for t in RULE_TARGETS for m in RULE_THRESHOLDS])
    return (d.join(lab, "doc_id")
             .select("doc_id", F.explode(runs).alias("r"))
             .select("r.task", "r.model", "doc_id", "r.label", "r.prediction"))


def word_vectors(spark: SparkSession, sf_dir: str, corpus_words: DataFrame) -> DataFrame:
    """word vectors := embeddings keyed by words.

    A word takes the vector whose ``vec_id`` equals a hash of the word modulo
    twice the number of vectors, so about half of the words have no vector and
    exercise the zero-vector default.
    """
    emb = read(spark, sf_dir, "embeddings")
    n_vec = emb.select(F.count(F.lit(1))).scalar()
    words = corpus_words.select("word").distinct()
    slot = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long"), n_vec * 2)
    return (words.withColumn("vec_id", slot)
                 .join(emb.select("vec_id", F.col("embedding").alias("vec")), "vec_id")
                 .select("word", "vec"))


def raw_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw event JSON lines := events rendered in the raw event record format:
    id := event_id (as text), time := ts in epoch ms, group.id := user_id,
    rating := {count: whole part of value, average: value}, name := event_type,
    description := props."""
    e = read(spark, sf_dir, "events")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rec = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("name"),
        F.struct(F.col("value").cast("long").alias("count"),
                 F.col("value").alias("average")).alias("rating"),
        F.col("props").alias("description"),
        F.struct(F.col("user_id").alias("id")).alias("group"),
        F.timestamp_diff("MILLISECOND", epoch, F.col("ts")).alias("time"),
    )
    return e.select(F.to_json(rec).alias("value"))


def _epoch_ms(ts):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts)


def raw_group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw group JSON lines := customers rendered in the raw group format:
    id := custkey, name := customer name, city := nation name, timezone by
    region, category.id := nation key, rating := account balance,
    description := market segment, topics := [market segment]."""
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    rec = F.struct(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        _timezone(F.col("n_regionkey")).alias("timezone"),
        F.col("c_acctbal").alias("rating"),
        F.col("c_mktsegment").alias("description"),
        F.struct(F.col("c_nationkey").alias("id")).alias("category"),
        F.array(F.struct(F.col("c_mktsegment").alias("urlkey"))).alias("topics"),
    )
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.to_json(rec).alias("value"))


def raw_venue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw venue JSON lines := parts: id := partkey, name := part name,
    rating := retail price, rating_count := size, lat := size, lon := -size,
    address_1 and zip := brand, city := type."""
    p = read(spark, sf_dir, "part")
    rec = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("rating"), F.col("p_size").alias("rating_count"),
        F.col("p_size").cast("double").alias("lat"), (-F.col("p_size")).cast("double").alias("lon"),
        F.col("p_brand").alias("address_1"), F.col("p_brand").alias("zip"),
        F.col("p_type").alias("city"),
    )
    return p.select(F.to_json(rec).alias("value"))


def raw_rsvp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw RSVP JSON lines := orders: rsvp_id := orderkey, response := status,
    member.id := custkey, event.id := orderkey as text, created := order date
    (epoch ms), mtime := created + total price in ms."""
    o = read(spark, sf_dir, "orders")
    created = _epoch_ms(F.col("o_orderdate"))
    rec = F.struct(
        F.col("o_orderkey").alias("rsvp_id"), F.col("o_orderstatus").alias("response"),
        F.struct(F.col("o_custkey").alias("member_id")).alias("member"),
        F.struct(F.col("o_orderkey").cast("string").alias("id")).alias("event"),
        created.alias("created"),
        (created + F.col("o_totalprice").cast("long")).alias("mtime"),
    )
    return o.select(F.to_json(rec).alias("value"))
