"""Every registered query against its SQL, on the smallest data."""

import pytest

from strandline.plans import insight_queries, platform_queries, problem_queries
from tests.compare import FOLDER, database, same

QUERIES = {n: q for m in (problem_queries, insight_queries, platform_queries) for n, q in m.QUERIES.items()}
SQL = {n: q for m in (problem_queries, insight_queries, platform_queries) for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    same(QUERIES[name](spark, FOLDER), db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_every_query(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


LARGER = FOLDER.replace("sf0.001", "sf0.01")  # has events years before the others


@pytest.mark.parametrize("name", ["trends_total", "funnel_ordered", "paths_all", "web_overview", "stickiness_day"])
def test_headline_queries_run_over_all_event_times(spark, name):
    same(QUERIES[f"{name}_whole"](spark, LARGER), database(LARGER), SQL[f"{name}_whole"])


def test_no_event_is_outside_all_event_times():
    whole = insight_queries.WHOLE
    inside = f"count(*) FILTER (WHERE epoch_us(timestamp) >= {whole.start} AND epoch_us(timestamp) < {whole.end})"
    for folder in (FOLDER, LARGER):
        assert database(folder).execute(f"SELECT count(*) - {inside} FROM captured_events").fetchone()[0] == 0
