"""Where events happen: canonical locations, group-venue hosting, venue maps.

SURVEY R7-R9: J2-J5, A5, A6, X6, X14, X15, F6, F8, F9, J9, S16.

Inputs are typed tables:

* ``events``: ``group_id``, ``venue_id`` (one row per hosted event)
* ``venues``: ``venue_id``, ``name``, ``lat``, ``lon``, ``rating``
* ``groups``: ``group_id``, ``name``, ``topic``, ``city``

Venues at exactly the same (lat, lon) are one location, named by the smallest
venue id there; venues without coordinates never match a location.

Scale notes.  Hostings are counted per (group, venue) before any join, so the
event rows are combined map-side and only distinct (group, venue) pairs are
shuffled; a venue that holds a large share of events shrinks to one row per
hosting group there.  The venue -> location mapping comes from the venue table
alone.  The remaining joins are equi-joins on aggregated rows; AQE picks
broadcast or sort-merge from measured sizes and splits skewed partitions.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.functions import scalars as X
from gatherlens.session import materialize

# Fixed value: half-width of the reference's map viewport, metres.
VIEW_SCOPE_M = 10000.0


def _points(venues: DataFrame, precision: int | None) -> DataFrame:
    if precision is None:
        return venues
    return venues.withColumns({"lat": F.round("lat", precision), "lon": F.round("lon", precision)})


def canonical_locations(venues: DataFrame, precision: int | None = None) -> DataFrame:
    """A5: one row per distinct (lat, lon) with the smallest venue id there (``loc_id``).

    Points merge only when exactly equal (the reference's rule); ``precision``
    (decimal places) rounds the coordinates first so that near points merge (Q9).
    """
    return _points(venues, precision).groupBy("lat", "lon").agg(F.min("venue_id").alias("loc_id"))


def venue_locations(venues: DataFrame, precision: int | None = None) -> DataFrame:
    """J3 on the venue side: each venue with coordinates -> its location id."""
    v = _points(venues, precision).select("venue_id", "lat", "lon")
    # The locations are cut off from their aggregation, so that the join is one of two
    # plain exchanges, whose partition with a hot point the adaptive planner splits.
    return v.join(materialize(canonical_locations(venues, precision)), ["lat", "lon"]) \
            .select("venue_id", "lat", "lon", "loc_id")


def group_location_hosts(events: DataFrame, venues: DataFrame,
                         precision: int | None = None) -> DataFrame:
    """A6 (+J2, J3): events per (group, location) as ``host_num``."""
    per_venue = events.groupBy("group_id", "venue_id").agg(F.count(F.lit(1)).alias("k"))
    return (per_venue.join(venue_locations(venues, precision), "venue_id")
                     .groupBy("group_id", "loc_id", "lat", "lon")
                     .agg(F.sum("k").alias("host_num")))


def group_venue_info(events: DataFrame, venues: DataFrame, groups: DataFrame,
                     precision: int | None = None) -> DataFrame:
    """Hosting counts per (group, location) with group and venue attributes.

    Columns: venue_id (the location's canonical venue), group_id, lat, lon,
    host_num, topic, group, city, venue, rating.
    """
    g = groups.select("group_id", "topic", F.col("name").alias("group"), "city")
    attrs = venues.select(F.col("venue_id").alias("loc_id"), F.col("name").alias("venue"), "rating")
    out = (group_location_hosts(events, venues, precision)
           .join(g, "group_id")
           .join(attrs, "loc_id"))
    return out.select(F.col("loc_id").alias("venue_id"), "group_id", "lat", "lon", "host_num",
                      "topic", "group", "city", "venue", "rating")


def group_venue_flag(info: DataFrame, floor: int = 2) -> DataFrame:
    """R8 (X6): adds ``host`` = 1 when the group hosted at least ``floor`` events there."""
    return info.withColumn("host", X.host_flag("host_num", floor))


def frequent_venues(info: DataFrame, min_hosts: int = 3,
                    cities: DataFrame | None = None) -> DataFrame:
    """(group, location) pairs with more than ``min_hosts`` events.

    ``cities`` (a DataFrame with a ``city`` column) keeps only those cities, by a
    semi-join.  Write the result with :func:`gatherlens.sources.sinks.write_by_city`
    to get the per-city files in one job.
    """
    df = info.filter(F.col("host_num") > min_hosts)
    if cities is not None:
        df = df.join(cities.select("city"), "city", "left_semi")
    return df.select("city", "venue_id", "group_id", "lat", "lon", "topic", "host_num")


def venue_map(frequent: DataFrame, city_coords: DataFrame,
              topics: Iterable[str] | None = None, scope: float = VIEW_SCOPE_M,
              x_move: float = 0.0, y_move: float = 0.0) -> DataFrame:
    """R9 map layer (J9, X14, X15, F8, F9): Web Mercator points and marker sizes.

    ``city_coords`` has (city, lat, lon) of each city centre.  ``in_view`` marks
    points inside the square of half-width ``scope`` metres around the centre,
    shifted by (x_move, y_move).  ``topics`` keeps only those topics.
    """
    df = frequent
    if topics is not None:
        df = df.filter(F.col("topic").isin(list(topics)))
    centres = city_coords.select("city", X.mercator_x("lon").alias("city_x"),
                                 X.mercator_y("lat").alias("city_y"))
    df = df.join(centres, "city").withColumns({
        "x": X.mercator_x("lon"),
        "y": X.mercator_y("lat"),
        "size": X.marker_size("host_num"),
    })
    cx = F.col("city_x") + x_move
    cy = F.col("city_y") + y_move
    in_view = (F.col("x").between(cx - scope, cx + scope)
               & F.col("y").between(cy - scope, cy + scope))
    return df.withColumn("in_view", in_view).select(
        "city", "venue_id", "group_id", "lat", "lon", "topic", "host_num", "x", "y", "size", "city_x", "city_y", "in_view")
