"""The pivot and the round trips over all cities: non-empty, and nothing is lost."""
import datetime as dt

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_every_event_is_in_one_cell_of_the_pivot(spark):
    rows = E.queries()["topic_all_cities_pivot"](spark, SF_SMALL).collect()
    cells = [c for c in rows[0].asDict() if c != "topic"]
    events = E.queries()["event_time_info"](spark, SF_SMALL)
    held = {r["city"] for r in events.select("city").distinct().collect()}
    assert len(cells) == 26 and len(held) > 1 and {c for c in cells if any(r[c] for r in rows)} == held
    assert sum(r[c] for r in rows for c in cells) == events.count()


def test_round_trips_give_back_what_was_written(spark):
    for name, source in (("city_topic_round_trip_whole", "event_time_info"), ("city_venues_round_trip_whole", "frequent_venues")):
        got = E.queries()[name](spark, SF_SMALL)
        want = E.queries()[source](spark, SF_SMALL).select(*got.columns)
        assert got.select("city").distinct().count() > 1
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scatter_of_both_years_in_query_and_sql(spark, tmp_path):
    import duckdb
    tables = {
        "nation": spark.createDataFrame([(1, "A", 0), (2, "B", 4)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": spark.createDataFrame([(1, "x", 1, "M"), (2, "y", 2, "M")],
                                          "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        # Early on New Year's Day in UTC is still the old year in New York.
        "events": spark.createDataFrame([(10 * y + u, dt.datetime(y, 1, 1, 2), u) for y in (2022, 2023, 2024, 2025, 2026) for u in (1, 2)],
                                        "event_id long, ts timestamp_ntz, user_id long")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted((r["event_id"], r["year"]) for r in E.queries()["event_scatter_years"](spark, str(tmp_path)).collect())
    assert got == [(20232, 2023), (20241, 2023), (20242, 2024), (20251, 2024)]
    sql = E.oracle_sql()["event_scatter_years"]
    assert sorted(con.execute(f"SELECT event_id, year FROM ({sql})").fetchall()) == got
