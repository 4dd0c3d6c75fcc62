from gatherlens.operators import venues as V


def make(spark):
    venues = spark.createDataFrame([
        (10, "hall a", 40.0, -74.0, 4.5),
        (7, "hall b", 40.0, -74.0, 3.0),     # same point as 10 -> location 7
        (12, "park", 41.0, -73.0, None),
        (13, "nowhere", None, None, 1.0),    # no coordinates: never a location
    ], "venue_id long, name string, lat double, lon double, rating double")
    groups = spark.createDataFrame([(1, "chess", "games", "NYC"), (2, "run", "sports", "NYC")],
                                   "group_id long, name string, topic string, city string")
    events = spark.createDataFrame(
        [(1, 10), (1, 7), (1, 10), (1, 12), (2, 12), (2, 13), (2, None), (3, 10)],
        "group_id long, venue_id long")
    return events, venues, groups


def test_canonical_locations(spark):
    _, venues, _ = make(spark)
    got = sorted((r.lat, r.lon, r.loc_id) for r in V.canonical_locations(venues).collect()
                 if r.lat is not None)
    assert got == [(40.0, -74.0, 7), (41.0, -73.0, 12)]


def test_group_venue_info(spark):
    events, venues, groups = make(spark)
    info = V.group_venue_info(events, venues, groups)
    got = sorted((r.group_id, r.venue_id, r.host_num, r.venue, r.topic) for r in info.collect())
    # group 1: three events at the two venues of point (40, -74) -> location 7
    assert got == [(1, 7, 3, "hall b", "games"), (1, 12, 1, "park", "games"),
                   (2, 12, 1, "park", "sports")]
    flags = {(r.group_id, r.venue_id): r.host for r in V.group_venue_flag(info).collect()}
    assert flags == {(1, 7): 1, (1, 12): 0, (2, 12): 0}


def test_frequent_venues_and_map(spark):
    events, venues, groups = make(spark)
    info = V.group_venue_info(events, venues, groups)
    freq = V.frequent_venues(info, min_hosts=1)
    assert [(r.group_id, r.venue_id) for r in freq.collect()] == [(1, 7)]
    cities = spark.createDataFrame([("NYC", 40.0, -74.0), ("Elsewhere", 0.0, 0.0)],
                                   "city string, lat double, lon double")
    only = V.frequent_venues(info, min_hosts=0, cities=cities.filter("city = 'Elsewhere'"))
    assert only.count() == 0
    m = V.venue_map(freq, cities).first()
    assert m.in_view and abs(m.x - m.city_x) < 1e-6
    far = V.venue_map(freq, cities, x_move=50000.0).first()
    assert not far.in_view
    assert V.venue_map(freq, cities, topics=["sports"]).count() == 0


def test_precision_merges_near_points(spark):
    venues = spark.createDataFrame([(1, "a", 40.00001, -74.0, 1.0), (2, "b", 40.00002, -74.0, 1.0)],
                                   "venue_id long, name string, lat double, lon double, rating double")
    assert V.canonical_locations(venues).count() == 2
    merged = V.canonical_locations(venues, precision=3).collect()
    assert [(r.lat, r.lon, r.loc_id) for r in merged] == [(40.0, -74.0, 1)]
