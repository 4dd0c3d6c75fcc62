"""Raw and typed schemas of the four entities (group, event, venue, rsvp).

Raw schemas describe the JSON-lines records as they arrive; only the fields the
typed tables use are declared, so the JSON source skips everything else.  Typed
schemas are what the parsers in :mod:`gatherlens.sources.entities` return.

Type choices: ids and epoch seconds are 64-bit, coordinates and ratings are
double (coordinates are join keys), instants are ``timestamp_ntz`` holding UTC
wall time so that no session time zone leaks into the local-time derivation.
"""
from pyspark.sql import types as T

_ID = T.StructType([T.StructField("id", T.LongType())])
_MEMBER = T.StructType([T.StructField("member_id", T.LongType())])

RAW_GROUP = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("members", T.DoubleType()),
    T.StructField("created", T.LongType()),
    T.StructField("organizer", _MEMBER),
    T.StructField("category", T.StructType([T.StructField("id", T.IntegerType())])),
    T.StructField("who", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StructType([T.StructField("urlkey", T.StringType())]))),
    T.StructField("link", T.StringType()),
    T.StructField("group_photo", T.StructType([T.StructField("photo_link", T.StringType())])),
])

RAW_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("venue", _ID),
    T.StructField("rating", T.StructType([
        T.StructField("count", T.DoubleType()),
        T.StructField("average", T.DoubleType()),
    ])),
    T.StructField("event_hosts", T.ArrayType(_MEMBER)),
    T.StructField("yes_rsvp_count", T.DoubleType()),
    T.StructField("maybe_rsvp_count", T.DoubleType()),
    T.StructField("waitlist_count", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("group", _ID),
    T.StructField("created", T.LongType()),
    T.StructField("time", T.LongType()),
    T.StructField("updated", T.LongType()),
])

RAW_VENUE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("rating_count", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("address_1", T.StringType()),
    T.StructField("zip", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
])

RAW_RSVP = T.StructType([
    T.StructField("rsvp_id", T.LongType()),
    T.StructField("response", T.StringType()),
    T.StructField("member", _MEMBER),
    T.StructField("event", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("venue", _ID),
    T.StructField("group", _ID),
    T.StructField("created", T.LongType()),
    T.StructField("mtime", T.LongType()),
])

RAW = {"group": RAW_GROUP, "event": RAW_EVENT, "venue": RAW_VENUE, "rsvp": RAW_RSVP}

# Typed tables: the column order of the reference's typed tables first, then the
# fields it parsed and dropped (Catalyst prunes whatever a query does not read).
GROUP = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("created", T.TimestampNTZType()),
    T.StructField("members", T.IntegerType()),
    T.StructField("organizer", T.LongType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("topic", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("group_photo_link", T.StringType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("who", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("yes_rsvp", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("rating_count", T.IntegerType()),
    T.StructField("hosts", T.ArrayType(T.LongType())),
    T.StructField("group_id", T.LongType()),
    T.StructField("venue_id", T.LongType()),
    T.StructField("event_create_stamp", T.LongType()),
    T.StructField("event_time_stamp", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("maybe_rsvp", T.IntegerType()),
    T.StructField("waitlist", T.IntegerType()),
    T.StructField("created", T.TimestampNTZType()),
    T.StructField("updated", T.TimestampNTZType()),
])

VENUE = T.StructType([
    T.StructField("venue_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("zip", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("rating_count", T.IntegerType()),
    T.StructField("address", T.StringType()),
])

RSVP = T.StructType([
    T.StructField("rsvp_id", T.LongType()),
    T.StructField("created", T.TimestampNTZType()),
    T.StructField("mtime", T.TimestampNTZType()),
    T.StructField("response", T.StringType()),
    T.StructField("member_id", T.LongType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("venue_id", T.LongType()),
    T.StructField("rsvp_create_stamp", T.LongType()),
    T.StructField("rsvp_mtime_stamp", T.LongType()),
    T.StructField("group_id", T.LongType()),
])

TYPED = {"group": GROUP, "event": EVENT, "venue": VENUE, "rsvp": RSVP}

# Lookup tables.
CITIES = "city STRING, lat DOUBLE, lon DOUBLE"
CATEGORY_TOPICS = "category_id INT, topic STRING"
TOPIC_IDS = "topic STRING, topic_id INT"
METRICS = "topic_num INT, model STRING, f1 DOUBLE, acc DOUBLE"
