"""The driver contract: entry() runs, every query with an oracle matches DuckDB."""
import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE, SF_SMALL
from tools.check_oracle import TABLES, normalise, schema_problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["city", "topic", "weekday", "n"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 40


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


# No pair of the smallest table has more than 3 hostings.
MAY_BE_EMPTY = {"frequent_venues_cut"}


def test_subsets_remove_rows_and_pivots_lose_none(spark):
    q = E.queries()
    whole = q["event_scatter"](spark, SF_ORACLE).count()
    # The table's local years are 2023 and 2024; tests/test_whole.py has rows of other years.
    assert 0 < q["event_scatter_years"](spark, SF_ORACLE).count() <= whole
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert q["occurrence_all_months"](spark, SF_SMALL).agg({"n": "sum"}).first()[0] == events
    for name in ("topic_city_pivot", "topic_all_cities_pivot"):
        df = q[name](spark, SF_SMALL).drop("topic")
        sums = df.groupBy().sum().first()
        assert sum(sums) == events and sum(sums[:-1]) > 0
    yearly = q["occurrence_yearly_pivot"](spark, SF_SMALL).drop("topic").where("city <> 'US'").drop("city")
    assert sum(yearly.groupBy().sum().first()) == events


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    found = duck.execute(E.oracle_sql()[name])
    assert not schema_problems(df.schema, found.description)
    got, want = df.toPandas(), found.df()
    assert len(got) == len(want)
    assert len(got) or name in MAY_BE_EMPTY
    a, b = normalise(got), normalise(want)
    for c in a.columns:
        assert a[c].equals(b[c]), c
