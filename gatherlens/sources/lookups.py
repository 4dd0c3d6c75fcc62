"""Lookup tables: cities, category -> topic, topic -> label id,
stop words, word vectors.

Each table has a loader for a user's file and, where the values are fixed by
the reference, a built-in copy.  All are small, one row per key; joins against
them are left to AQE, which broadcasts them after measuring.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherlens.functions.text import default_stop_words
from gatherlens.sources import schemas as SC

# The 30 cities and their centres (city, latitude, longitude).
CITIES = [
    ("New York", 40.7128, -74.0060),
    ("Chicago", 41.8781, -87.6298),
    ("San Diego", 32.7157, -117.1611),
    ("Washington", 38.9072, -77.0369),
    ("Los Angeles", 34.0522, -118.2437),
    ("Houston", 29.7604, -95.3698),
    ("Atlanta", 33.7490, -84.3880),
    ("San Francisco", 37.7749, -122.4194),
    ("Seattle", 47.6062, -122.3321),
    ("Austin", 30.2672, -97.7431),
    ("Philadelphia", 39.9526, -75.1652),
    ("Denver", 39.7392, -104.9903),
    ("Dallas", 32.7767, -96.7970),
    ("Portland", 45.5122, -122.6587),
    ("Boston", 42.3601, -71.0589),
    ("Raleigh", 35.7796, -78.6382),
    ("Brooklyn", 40.6782, -73.9442),
    ("Orlando", 28.5383, -81.3792),
    ("Phoenix", 33.4484, -112.0740),
    ("Las Vegas", 36.1699, -115.1398),
    ("Minneapolis", 44.9778, -93.2650),
    ("Charlotte", 35.2271, -80.8431),
    ("Sacramento", 38.5816, -121.4944),
    ("San Antonio", 29.4241, -98.4936),
    ("Tampa", 27.9506, -82.4572),
    ("Fort Lauderdale", 26.1224, -80.1373),
    ("San Jose", 37.3382, -121.8863),
    ("Saint Louis", 38.6270, -90.1994),
    ("Miami", 25.7617, -80.1918),
    ("Pittsburgh", 40.4406, -79.9959),
]

# Group category id -> topic (ids 7, 19 and 35 have no topic).
CATEGORY_TOPICS = [
    (1, "arts-culture"),
    (2, "career-business"),
    (3, "outdoors-adventure"),
    (4, "movements"),
    (5, "dancing"),
    (6, "education"),
    (8, "fashion-beauty"),
    (9, "sports-fitness"),
    (10, "food"),
    (11, "games-sci-fi"),
    (12, "lgbtq"),
    (13, "movements"),
    (14, "health-wellness"),
    (15, "hobbies-crafts"),
    (16, "language"),
    (17, "Lifestyle"),
    (18, "book-clubs"),
    (20, "film"),
    (21, "music"),
    (22, "beliefs"),
    (23, "outdoors-adventure"),
    (24, "beliefs"),
    (25, "parents-family"),
    (26, "pets"),
    (27, "photography"),
    (28, "beliefs"),
    (29, "games-sci-fi"),
    (30, "singles"),
    (31, "social"),
    (32, "sports-fitness"),
    (33, "health-wellness"),
    (34, "tech"),
    (36, "writing"),
]

# Topic -> classifier label id.
TOPIC_IDS = [
    ("career-business", 0),
    ("tech", 1),
    ("health-wellness", 2),
    ("beliefs", 3),
    ("social", 4),
    ("sports-fitness", 5),
    ("outdoors-adventure", 6),
    ("movements", 7),
    ("games-sci-fi", 8),
    ("parents-family", 9),
    ("food", 10),
    ("language", 11),
    ("music", 12),
    ("education", 13),
    ("arts-culture", 14),
    ("lgbtq", 15),
    ("dancing", 16),
    ("hobbies-crafts", 17),
    ("book-clubs", 18),
    ("pets", 19),
    ("writing", 20),
    ("photography", 21),
    ("film", 22),
    ("singles", 23),
    ("Lifestyle", 24),
    ("fashion-beauty", 25),
]


def cities(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(city, lat, lon); from ``path`` (lines ``city,lat,lon``) or the built-in list."""
    if path:
        return spark.read.schema(SC.CITIES).csv(path)
    return spark.createDataFrame(CITIES, SC.CITIES)


def category_topics(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(category_id, topic); from ``path`` (whitespace-separated) or built-in."""
    if path:
        parts = F.split(F.trim(F.col("value")), r"\s+")
        return (spark.read.text(path).filter(F.trim("value") != "")
                     .select(parts.getItem(0).cast("int").alias("category_id"),
                             parts.getItem(1).alias("topic")))
    return spark.createDataFrame(CATEGORY_TOPICS, SC.CATEGORY_TOPICS)


def topic_ids(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(topic, topic_id); from ``path`` (lines ``topic, id``) or built-in."""
    if path:
        return (spark.read.schema(SC.TOPIC_IDS)
                     .option("ignoreLeadingWhiteSpace", True)
                     .option("ignoreTrailingWhiteSpace", True)
                     .csv(path))
    return spark.createDataFrame(TOPIC_IDS, SC.TOPIC_IDS)


def topics(spark: SparkSession, path: str | None = None, topic_num: int | None = None) -> DataFrame:
    """The topic list in label-id order, optionally the first ``topic_num``."""
    t = topic_ids(spark, path)
    if topic_num is not None:
        t = t.filter(F.col("topic_id") < topic_num)
    return t.select("topic", "topic_id")


def stop_words(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Distinct stop words (one per line in ``path``), else MLlib's English list."""
    if path:
        return (spark.read.text(path).select(F.trim("value").alias("word"))
                     .filter(F.col("word") != "").distinct())
    return spark.createDataFrame([(w,) for w in default_stop_words()], "word STRING")


def word_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(word, vec ARRAY<FLOAT>) from a text file of ``word v1 ... vD`` lines."""
    parts = F.split(F.trim(F.col("value")), " +")
    vec = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float"))
    df = (spark.read.text(path).filter(F.trim("value") != "")
               .select(F.element_at(parts, 1).alias("word"), vec.alias("vec")))
    if dim is not None:
        df = df.filter(F.size("vec") == dim)
    return df
