import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatherlens.operators import density as K
from gatherlens.operators import occurrence as O

GROUPS = [(1, "NYC", "tech", "America/New_York", "g1"),
          (2, "NYC", "food", "America/New_York", "g2"),
          (3, "LA", "tech", "America/Los_Angeles", "g3"),
          (4, "LA", "tech", None, "g4")]


@pytest.fixture()
def eti(spark):
    rows = [
        ("e1", 1, dt.datetime(2024, 1, 1, 23, 30)),   # NYC Mon 18:30
        ("e2", 1, dt.datetime(2024, 1, 6, 20, 0)),    # NYC Sat 15:00
        ("e3", 1, dt.datetime(2024, 1, 7, 20, 0)),    # NYC Sun 15:00
        ("e4", 2, dt.datetime(2024, 1, 2, 12, 0)),    # NYC Tue 07:00
        ("e5", 3, dt.datetime(2024, 1, 1, 3, 0)),     # LA Sun 2023-12-31 19:00
        ("e6", 3, dt.datetime(2023, 6, 1, 17, 0)),    # LA Thu 10:00 (PDT)
        ("e7", 9, dt.datetime(2024, 1, 1, 0, 0)),     # no such group: dropped by the join
    ]
    events = spark.createDataFrame(rows, "event_id string, group_id long, time timestamp_ntz")
    groups = spark.createDataFrame(GROUPS, "group_id long, city string, topic string, timezone string, name string")
    return O.event_time_info(events, groups)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_event_time_info_local_fields(eti):
    got = {r.event_id: (r.year, r.weekday, r.hour) for r in eti.collect()}
    assert got == {"e1": (2024, 0, 18), "e2": (2024, 5, 15), "e3": (2024, 6, 15),
                   "e4": (2024, 1, 7), "e5": (2023, 6, 19), "e6": (2023, 3, 10)}


def test_occurrence_with_all_cities_rollup(eti):
    yearly = O.occurrence(eti, "year")
    assert rows(yearly, "city", "topic", "year", "n") == [
        ("LA", "tech", 2023, 2), ("NYC", "food", 2024, 1), ("NYC", "tech", 2024, 3),
        ("US", "food", 2024, 1), ("US", "tech", 2023, 2), ("US", "tech", 2024, 3)]
    hourly = O.occurrence(eti, "hour", include_all=False)  # Sunday-only weekend
    assert ("NYC", "tech", "weekend", 15, 1) in rows(hourly, "city", "topic", "day_type", "hour", "n")
    assert ("NYC", "tech", "weekday", 15, 1) in rows(hourly, "city", "topic", "day_type", "hour", "n")
    sat_sun = O.occurrence(eti, "hour", include_all=False, weekend_start=5)
    assert ("NYC", "tech", "weekend", 15, 2) in rows(sat_sun, "city", "topic", "day_type", "hour", "n")


def test_occurrence_cube_equals_single_grains(eti):
    cube = O.occurrence_cube(eti)
    daily = O.occurrence(eti, "weekday")
    assert rows(cube.filter("grain = 'daily'"), "city", "topic", "bucket", "n") == \
        rows(daily, "city", "topic", "weekday", "n")
    assert set(r.grain for r in cube.select("grain").distinct().collect()) == \
        {"yearly", "daily", "hourly_weekday", "hourly_weekend"}


def test_pivot_fills_missing_days(eti):
    daily = O.occurrence(eti, "weekday", include_all=False)
    wide = O.bucket_pivot(daily, ["city", "topic"], "weekday", range(7),
                          ["mon", "tue", "wed", "thu", "fri", "sat", "sun"])
    got = {(r.city, r.topic): (r.mon, r.tue, r.wed, r.thu, r.fri, r.sat, r.sun) for r in wide.collect()}
    assert got[("NYC", "tech")] == (1, 0, 0, 0, 0, 1, 1)
    assert got[("LA", "tech")] == (0, 0, 0, 1, 0, 0, 1)


def test_shares_and_lift(eti):
    counts = O.city_topic_counts(eti)
    share = O.topic_share_city(counts)
    per_city = share.groupBy("city").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 for r in per_city)
    lift = {(r.city, r.topic): r.lift for r in O.topic_lift(counts).collect()}
    # N = 6, NYC = 4, LA = 2, tech = 5, food = 1
    assert lift[("NYC", "food")] == pytest.approx(1 * 6 * 100 / (4 * 1))
    assert lift[("LA", "tech")] == pytest.approx(2 * 6 * 100 / (2 * 5))
    us = {r.topic: r.pct for r in O.topic_share_all(eti).collect()}
    assert us["tech"] == pytest.approx(500 / 6)


def test_top_k_ties_by_name(spark):
    df = spark.createDataFrame([("c", "b", 10.0), ("c", "a", 10.0), ("c", "z", 5.0), ("d", "x", 1.0)],
                               "city string, topic string, pct double")
    got = rows(O.top_k_per(df, "city", "pct", 2), "city", "topic", "rank")
    assert got == [("c", "a", 1), ("c", "b", 2), ("d", "x", 1)]
    assert [r.topic for r in O.top_k(df, "pct", 2).collect()] == ["a", "b"]


def test_daily_heat_zero_cells_and_order(eti):
    daily = O.occurrence(eti, "weekday")
    heat = O.daily_heat(daily, top_n=10, weekend_start=5)
    us = heat.filter("city = 'US'")
    assert us.count() == 14  # two topics x seven days, missing days as zeros
    tech = {r.weekday: r for r in us.filter("topic = 'tech'").collect()}
    assert tech[2].n == 0 and tech[2].pct == 0
    assert tech[5].weekend_prop == pytest.approx(3 / 5)
    order = {r.topic: r.heat_order for r in us.select("topic", "heat_order").distinct().collect()}
    assert order == {"food": 1, "tech": 2}  # food has no weekend events
    top1 = O.daily_heat(daily, top_n=1).filter("city = 'US'")
    assert {r.topic for r in top1.collect()} == {"tech"}


def test_event_scatter_year_filter(eti):
    s = O.event_scatter(eti, years=[2024])
    assert s.count() == 4
    e1 = s.filter("event_id = 'e1'").first()
    assert e1.day == "Mon" and e1.time_of_day == 18.5


def test_density_matches_scipy_definition(spark):
    import numpy as np
    hist = [("t", 9, 3), ("t", 12, 5), ("t", 20, 2), ("one", 10, 4)]
    df = spark.createDataFrame(hist, "topic string, hour int, n long")
    dens = K.hourly_density(df, -30.0, 60.0, 901)
    t = sorted((r.x, r.density) for r in dens.filter("topic = 't'").collect())
    data = np.repeat([9.0, 12.0, 20.0], [3, 5, 2])
    n, s = len(data), data.std(ddof=1)
    bw = (n * 3 / 4) ** (-1 / 5) / 0.6 * s
    xs = np.array([x for x, _ in t])
    expect = np.exp(-0.5 * ((xs[:, None] - data[None, :]) / bw) ** 2).sum(1) / (n * bw * np.sqrt(2 * np.pi))
    assert np.allclose([d for _, d in t], expect)
    assert abs(np.trapezoid([d for _, d in t], xs) - 1) < 1e-3   # integrates to 1
    one = dens.filter("topic = 'one'").collect()
    assert len(one) == 901 and all(r.density is None for r in one)   # a single hour: no bandwidth
    only_t = K.hourly_density(df, -30.0, 60.0, 901, topics=["t"])
    assert {r.topic for r in only_t.select("topic").distinct().collect()} == {"t"}
    peak = K.best_hour(dens).filter("topic = 't'").first()
    assert abs(peak.peak_x - xs[np.argmax(expect)]) < 1e-9


def test_within_cities_and_city_pivot(spark, eti):
    counts = O.city_topic_counts(eti)
    la = O.within_cities(counts, spark.createDataFrame([("LA",)], "city string"))
    assert {r.city for r in la.collect()} == {"LA"}
    shares = O.topic_share_city(la)
    assert shares.first().pct == 100.0
    piv = {r.topic: (r.LA, r.NYC) for r in O.topic_city_pivot(counts).collect()}
    assert piv == {"tech": (2, 3), "food": (0, 1)}


def test_lift_of_counts_whose_product_exceeds_a_long(spark):
    df = spark.createDataFrame([("a", "x", 4_000_000_000), ("a", "y", 1), ("b", "x", 4_000_000_000), ("b", "y", 4_000_000_000)],
                               "city string, topic string, n long")
    got = {(r.city, r.topic): r.lift for r in O.topic_lift(df).collect()}
    assert abs(got["a", "x"] - 150.0) < 1e-6 and abs(got["b", "y"] - 150.0) < 1e-6
