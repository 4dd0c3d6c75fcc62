import datetime as dt
import math

from pyspark.sql import functions as F

from gatherlens.functions import scalars as X
from gatherlens.functions.text import clean_text, default_stop_words


def one(df):
    return [tuple(r) for r in df.collect()]


def test_zero_as_null(spark):
    df = spark.createDataFrame([(0, 0.0), (3, 2.5), (None, None)], "i long, d double")
    got = one(df.select(X.zero_as_null("i"), X.zero_as_null("d")))
    assert got == [(None, None), (3, 2.5), (None, None)]


def test_epoch_conversion(spark):
    df = spark.createDataFrame([(1500000000999,), (None,), (-1,)], "ms long")
    got = one(df.select(X.from_epoch_ms("ms"), X.epoch_seconds("ms")))
    assert got[0] == (dt.datetime(2017, 7, 14, 2, 40, 0), 1500000000)
    assert got[1] == (None, None)
    # floor, not truncation, before 1970
    assert got[2] == (dt.datetime(1969, 12, 31, 23, 59, 59), -1)


def test_local_time_across_dst(spark):
    # 2024-03-10 is the spring-forward day in America/New_York.
    rows = [(dt.datetime(2024, 3, 10, 6, 30), "America/New_York"),
            (dt.datetime(2024, 3, 10, 7, 30), "America/New_York"),
            (dt.datetime(2024, 1, 1, 0, 0, 7), "America/New_York"),
            (dt.datetime(2024, 1, 1, 0, 0, 7), "UTC")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, tz string")
    got = one(df.select(X.local_time("ts", "tz")))
    assert got == [(dt.datetime(2024, 3, 10, 1, 30),), (dt.datetime(2024, 3, 10, 3, 30),),
                   (dt.datetime(2023, 12, 31, 19, 0, 7),), (dt.datetime(2024, 1, 1, 0, 0, 7),)]


def test_weekday_hour_names(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 13, 45),), (dt.datetime(2024, 1, 7, 0, 0),)],
                               "ts timestamp_ntz")
    got = one(df.select(X.weekday("ts"), X.weekday_name(X.weekday("ts")), X.hour("ts"),
                        X.fractional_hour("ts"), X.day_type(X.weekday("ts")),
                        X.day_type(X.weekday("ts"), 5)))
    assert got == [(0, "Mon", 13, 13.75, "weekday", "weekday"), (6, "Sun", 0, 0.0, "weekend", "weekend")]


def test_host_flag_marker_mercator(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 45.0, 90.0), (5, 90.0, -180.0)],
                               "h long, lat double, lon double")
    got = one(df.select(X.host_flag("h"), X.marker_size("h"), X.mercator_x("lon"), X.mercator_y("lat")))
    assert [g[0] for g in got] == [0, 1, 1]
    assert math.isclose(got[1][1], math.log(2) * 3)
    assert math.isclose(got[1][2], 90 * 6378137 * math.pi / 180)
    assert math.isclose(got[1][3], math.log(math.tan((90 + 45) * math.pi / 360)) * 6378137)
    assert abs(got[0][3]) < 1e-6
    assert got[2][3] is None  # the pole has no Mercator y


def test_linspace_matches_numpy(spark):
    import numpy as np
    got = spark.range(1).select(X.linspace(6, 24, 90).alias("g")).first()["g"]
    assert np.allclose(got, np.linspace(6, 24, 90))
    assert got[0] == 6.0 and abs(got[-1] - 24.0) < 1e-12


def test_nan_median_of_a_list(spark):
    rows = [([1.0, 2.0, float("nan")],), ([2.0, 3.0, 4.0, 5.0],), ([float("nan")],), ([],), (None,),
            ([7.0, 1.0, 3.0],), ([0.5, None, 2.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [r[0] for r in df.select(X.nan_median("v")).collect()]
    # 1.5 -> 2 and 3.5 -> 4 (half-even), no value -> null, odd count -> middle value
    assert got == [2, 4, None, None, None, 3, 1]


def test_recent_and_repeat(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 2), 3), (dt.datetime(2017, 6, 1), 0)],
                               "ts timestamp_ntz, n long")
    got = one(df.select(X.recent("ts"), X.repeat_by_count(F.lit(7), "n")))
    assert got == [(True, [7, 7, 7]), (False, [])]


def test_clean_text_rules(spark):
    rows = [(1, None), (2, ""), (3, "<p>Hello World</p>"), (4, "<a\nhref='x'>Link text</a> ab cd"),
            (5, "Café déjà vu, naïve résumé!"), (6, "<b></b>   <i> </i>"), (7, "one two three four")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = dict(one(df.select("id", clean_text("t"))))
    assert got[1] is None and got[2] is None
    assert got[3] == "hello world"
    assert got[4] == "link text"          # a tag spanning a newline is removed
    assert got[5] == ""                   # accented letters split words into short pieces
    assert got[6] == ""
    assert got[7] == "three four"


def test_stop_words_list():
    words = default_stop_words()
    assert len(words) == 181 and "the" in words and "they" in words
