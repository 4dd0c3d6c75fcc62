"""When events happen: local time, occurrence counts, topic shares and lift.

SURVEY R1-R5: J1, X7-X13, A1-A4, A8-A11, A13-A18, T4-T7, F4, F5, F7.

Inputs are typed tables:

* ``events``: ``event_id``, ``group_id``, ``time`` (UTC wall time, timestamp_ntz)
* ``groups``: ``group_id``, ``city``, ``topic``, ``timezone``

Scale notes.  Only one step touches the event rows: the join to groups and the
first aggregation.  Everything after works on counts whose size is bounded by
cities x topics x buckets, not by events.  The group join is a plain equi-join:
AQE turns it into a broadcast join when the measured group side is small and
otherwise runs a sort-merge join whose skewed partitions (one group holding a
large share of events) it splits.  Aggregations are partial-then-final, so a hot
(city, topic) key is combined map-side before the shuffle.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatherlens.functions import scalars as X

# Fixed value: the label of the all-cities roll-up rows.
ALL_CITIES = "US"

_BUCKET_VALUES = {"weekday": list(range(7)), "hour": list(range(24))}


def event_time_info(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Events joined to their group, with local wall time, year, weekday, hour."""
    e = events.select("event_id", "group_id", "time")
    g = groups.select("group_id", "city", "topic", "timezone")
    local = X.local_time("time", "timezone")
    return (e.join(g, "group_id")
             .withColumn("local_time", local)
             .withColumns({
                 "year": X.year("local_time"),
                 "weekday": X.weekday("local_time"),
                 "hour": X.hour("local_time"),
             }))


def _with_day_type(eti: DataFrame, weekend_start: int) -> DataFrame:
    return eti.withColumn("day_type", X.day_type("weekday", weekend_start))


def occurrence(eti: DataFrame, bucket: str, include_all: bool = True,
               weekend_start: int = 6) -> DataFrame:
    """A1-A4 (+A9): event counts per city, topic and time bucket.

    ``bucket`` is ``'year'``, ``'weekday'`` or ``'hour'``; hourly counts are split
    by ``day_type`` (weekday/weekend, cut at ``weekend_start``).  With
    ``include_all`` the same single aggregation also emits the all-cities roll-up,
    labelled ``city = 'US'`` (grouping sets over the per-city counts, not a
    second pass over the events).
    Columns: city, topic, [day_type,] bucket, n.
    """
    if bucket not in ("year", "weekday", "hour"):
        raise ValueError(f"unknown bucket {bucket!r}")
    df = eti
    keys = ["topic", bucket]
    if bucket == "hour":
        df = _with_day_type(eti, weekend_start)
        keys = ["topic", "day_type", "hour"]
    # The event rows are counted once at the finest grain; the grouping sets
    # (which copy each input row once per set) then run on those counts only.
    fine = df.groupBy("city", *keys).agg(F.count(F.lit(1)).alias("n"))
    if not include_all:
        return fine
    sets = [["city", *keys], list(keys)]
    agg = (fine.groupingSets(sets, "city", *keys)
               .agg(F.sum("n").alias("n"), F.grouping("city").alias("_all")))
    city = F.when(F.col("_all") == 1, F.lit(ALL_CITIES)).otherwise(F.col("city"))
    return agg.select(city.alias("city"), *keys, "n")


def occurrence_cube(eti: DataFrame, weekend_start: int = 6) -> DataFrame:
    """S15 source table: every grain of A1-A4 (+A9) in one long table.

    Columns: grain ('yearly' | 'daily' | 'hourly_weekday' | 'hourly_weekend'),
    city, topic, bucket, n.  The events are counted once at the finest grain and
    every grain is a grouping set over those counts.
    """
    df = _with_day_type(eti, weekend_start)
    grains = [("yearly", "year", []), ("daily", "weekday", []), ("hourly", "hour", ["day_type"])]
    sets = []
    for _, b, extra in grains:
        sets.append(["city", "topic", *extra, b])
        sets.append(["topic", *extra, b])
    cols = ["city", "topic", "day_type", "year", "weekday", "hour"]
    # Count the events once at the finest grain, then roll the counts up.
    fine = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    agg = (fine.groupingSets(sets, *cols)
               .agg(F.sum("n").alias("n"),
                  F.grouping("city").alias("_all"),
                  F.grouping("year").alias("_y"),
                  F.grouping("weekday").alias("_w")))
    grain = (F.when(F.col("_y") == 0, F.lit("yearly"))
              .when(F.col("_w") == 0, F.lit("daily"))
              .otherwise(F.concat(F.lit("hourly_"), F.col("day_type"))))
    bucket = F.coalesce(F.when(F.col("_y") == 0, F.col("year")),
                        F.when(F.col("_w") == 0, F.col("weekday")),
                        F.col("hour"))
    city = F.when(F.col("_all") == 1, F.lit(ALL_CITIES)).otherwise(F.col("city"))
    return agg.select(grain.alias("grain"), city.alias("city"), "topic",
                      bucket.alias("bucket"), "n")


def bucket_pivot(counts: DataFrame, index: Sequence[str], bucket: str,
                 values: Iterable | None = None, names: Sequence[str] | None = None,
                 value_col: str = "n") -> DataFrame:
    """Long counts -> one column per bucket value, missing cells = 0.

    Pass ``values`` (e.g. the 7 weekdays); without them Spark first collects the
    distinct bucket values, which is only sensible for small domains.
    """
    if values is None:
        values = _BUCKET_VALUES.get(bucket)
    values = list(values) if values is not None else None
    wide = counts.groupBy(*index).pivot(bucket, values).agg(F.sum(value_col))
    value_cols = [c for c in wide.columns if c not in index]
    wide = wide.na.fill(0, subset=value_cols)
    if names is not None:
        wide = wide.withColumnsRenamed(dict(zip(value_cols, names)))
    return wide


def distinct_topics(df: DataFrame) -> DataFrame:
    """The topics present."""
    return df.select("topic").distinct()


def city_topic_counts(eti: DataFrame) -> DataFrame:
    """Events per (city, topic), all years together."""
    return eti.groupBy("city", "topic").agg(F.count(F.lit(1)).alias("n"))


def within_cities(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Keep the rows of the listed cities (a semi-join on ``city``);
    shares computed afterwards are over those cities only."""
    return df.join(cities.select("city"), "city", "left_semi")


def topic_city_pivot(counts: DataFrame, cities: Iterable[str] | None = None) -> DataFrame:
    """Topic x city table of (city, topic, n) counts, missing cells = 0.

    ``cities`` names the columns; None takes the distinct cities of the data
    (one small extra job, as Spark's pivot does).
    """
    return bucket_pivot(counts, ["topic"], "city", cities)


def topic_share_all(eti: DataFrame) -> DataFrame:
    """Each topic's share (percent) of all events in all cities."""
    counts = eti.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def topic_share_city(counts: DataFrame) -> DataFrame:
    """Topic share (percent) within each city, from (city, topic, n)."""
    n_city = F.sum("n").over(Window.partitionBy("city"))
    return counts.withColumn("pct", F.col("n") * 100.0 / n_city)


def topic_lift(counts: DataFrame) -> DataFrame:
    """Location quotient n_ct * N * 100 / (n_c * n_t); 100 is the average.

    The grand total N is a scalar subquery, the marginals are window sums over
    the (city, topic) counts, whose size is bounded by cities x topics.
    """
    total = counts.select(F.sum("n").cast("double")).scalar()
    n_city = F.sum("n").over(Window.partitionBy("city")).cast("double")
    n_topic = F.sum("n").over(Window.partitionBy("topic")).cast("double")
    # Doubles from the first product on: products of two counts can exceed a long.
    return counts.withColumn("lift", F.col("n").cast("double") * total * 100.0 / (n_city * n_topic))


def top_k_per(df: DataFrame, part: str | Sequence[str], order_col: str, k: int,
              tie: str = "topic") -> DataFrame:
    """T4: the k rows with the largest ``order_col`` per partition, ties by ``tie``."""
    part = [part] if isinstance(part, str) else list(part)
    w = Window.partitionBy(*part).orderBy(F.desc(order_col), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, order_col: str, k: int, tie: str = "topic") -> DataFrame:
    """The k rows with the largest ``order_col`` overall (a top-k report)."""
    return df.orderBy(F.desc(order_col), F.asc(tie)).limit(k)


def daily_heat(daily: DataFrame, top_n: int = 10, weekend_start: int = 5) -> DataFrame:
    """R5 (A17, A18, T6, T7, A13): weekday shares of the top-N topics per scope.

    ``daily`` is the weekday occurrence table (city, topic, weekday, n), usually
    with the 'US' roll-up rows, so every city and the whole country come out of
    one job.  Per scope: topics ranked by total events (ties by name), the top
    ``top_n`` kept, each weekday's share of the topic's events, the weekend share
    (weekday >= ``weekend_start``), and ``heat_order`` ranking topics by weekend
    share ascending (ties by name).  Missing weekdays appear with n = 0.
    """
    days = [str(d) for d in range(7)]
    wide = bucket_pivot(daily, ["city", "topic"], "weekday", range(7))
    total = sum((F.col(d) for d in days[1:]), F.col(days[0]))
    weekend = sum((F.col(d) for d in days[weekend_start + 1:]), F.col(days[weekend_start]))
    wide = wide.withColumns({"total": total, "weekend_prop": weekend / total})
    by_total = Window.partitionBy("city").orderBy(F.desc("total"), F.asc("topic"))
    top = wide.withColumn("topic_rank", F.row_number().over(by_total)) \
              .filter(F.col("topic_rank") <= top_n)
    by_weekend = Window.partitionBy("city").orderBy(F.asc("weekend_prop"), F.asc("topic"))
    top = top.withColumn("heat_order", F.row_number().over(by_weekend))
    long = top.unpivot(["city", "topic", "total", "weekend_prop", "heat_order"], days,
                       "weekday", "n")
    return long.select(
        "city", "topic", F.col("weekday").cast("int").alias("weekday"),
        X.weekday_name(F.col("weekday").cast("int")).alias("day"),
        "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"),
        "weekend_prop", "heat_order")


def event_scatter(eti: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
    """R4 (F7, X12, X13): one row per event with weekday name and fractional hour.

    ``years`` keeps only those local years (the reference's comparison view uses
    2015-2017); None keeps every year.
    """
    df = eti if years is None else eti.filter(F.col("year").isin(list(years)))
    return df.select("city", "topic", "event_id", "year", "weekday",
                     X.weekday_name("weekday").alias("day"),
                     X.fractional_hour("local_time").alias("time_of_day"))
