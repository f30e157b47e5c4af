"""The registered llm queries against their SQL, or run, on the smallest data."""

import pytest

from strandline.llm import bitmaps, queries
from strandline.session import materialize
from tests.compare import FOLDER, database, same


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, db, name):
    same(queries.QUERIES[name](spark, FOLDER), db, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"p3_found"}))
def test_query_runs(spark, name):
    queries.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()


def grow(sequences, threshold, longest, prefix=(), ends=None):
    """Frequent subsequences by plain extension, one item at a time."""
    found = {}
    ends = ends if ends is not None else [(i, 0) for i in range(len(sequences))]
    steps = {}
    for i, at in ends:
        seen = set()
        for j in range(at, len(sequences[i])):
            if sequences[i][j] not in seen:
                seen.add(sequences[i][j])
                steps.setdefault(sequences[i][j], []).append((i, j + 1))
    for item, following in steps.items():
        if len(following) >= threshold:
            found[(*prefix, item)] = len(following)
            if len(prefix) + 1 < longest:
                found |= grow(sequences, threshold, longest, (*prefix, item), following)
    return found


def test_p3_equals_brute_force(spark, db):
    sequences = [r[0] for r in db.execute("SELECT list(event ORDER BY timestamp, uuid) FROM (SELECT * FROM captured_events QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY timestamp) = 1) u WHERE event NOT LIKE '$%' GROUP BY distinct_id").fetchall()]
    n = db.execute("SELECT count(DISTINCT distinct_id) FROM captured_events").fetchone()[0]
    expected = {" > ".join(p): s for p, s in grow(sequences, -(-n // 100), 5).items() if len(p) >= 3}
    assert {r["pattern"]: r["support"] for r in queries.p3_found(spark, FOLDER).collect()} == expected


def test_the_trailing_week_is_made_of_stored_daily_buckets(spark, db, monkeypatch):
    stored = []
    monkeypatch.setattr(queries, "materialize", lambda df: stored.append(materialize(df)) or stored[-1])
    same(queries.p1_trailing_week(spark, FOLDER), db, queries.SQL["p1_trailing_week"])
    assert [set(df.columns) for df in stored] == [{"project_id", "day_no", "bucket", "words"}]
    daily = bitmaps.cardinality(bitmaps.unpack(stored[0], ["project_id", "day_no"]), ["project_id", "day_no"])
    same(daily.drop("error_bound"), db, "SELECT project_id, epoch_us(timestamp) // 86400000000 AS day_no, count(DISTINCT distinct_id) AS n_distinct FROM captured_events WHERE distinct_id IS NOT NULL GROUP BY ALL")
