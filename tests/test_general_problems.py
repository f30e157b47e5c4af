import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions.times import DAY, HOUR, MINUTE
from strandline.files import names
from strandline.operators import compaction, data_diff, feature_table, late_events, sessions
from strandline.operators.unique_events import earliest
from strandline.session import scratch
from strandline.sources import lake
from strandline.streaming.panes import PaneStore, late_counts

GAP = 30 * MINUTE


# ---- unique events


def test_earliest_prefers_first_then_smallest_values(spark, rows):
    df = spark.createDataFrame([("a", 5, "x"), ("a", 3, "z"), ("a", 3, "y"), ("b", None, "n"), ("b", 9, "m"), (None, 1, "p"), (None, 2, "q")], "uuid string, t long, event string")
    assert rows(earliest(df, F.col("uuid"), F.col("t"), event=F.col("event"))) == [("a", 3, "y"), ("b", 9, "m"), (None, 1, "p")]


def test_earliest_of_nothing(spark):
    df = spark.createDataFrame([], "uuid string, t long, key string, at string")
    assert earliest(df, F.col("uuid"), F.col("t"), event=F.col("key")).count() == 0


# ---- sessions


def events(spark, data):
    return spark.createDataFrame(data, "distinct_id string, session_id string, at long, slot string, session_no int, starts string")


def with_extra(*r):
    return (*r, "x", 7, "y")


def test_a_gap_of_exactly_the_limit_keeps_the_session_open(spark, rows):
    data = [with_extra("u", None, t) for t in (0, GAP, 2 * GAP + 1, 2 * GAP + 1)]
    found = sessions.event_sessions(events(spark, data)).drop("session_no", "duration_us")
    assert rows(found) == [("u", "", 0, GAP, 2), ("u", "", 2 * GAP + 1, 2 * GAP + 1, 2)]


def test_sessions_with_nulls_and_nothing(spark, rows):
    data = [with_extra(None, None, 5), with_extra(None, "", 6), with_extra("u", "s", None), with_extra("u", "s", -5)]
    found = sessions.event_sessions(events(spark, data)).drop("session_no", "duration_us")
    assert rows(found) == [("u", "s", -5, -5, 1), (None, "", 5, 6, 2)]
    assert sessions.event_sessions(events(spark, [])).count() == 0


def test_sessions_equal_a_plain_walk(spark, rows):
    random.seed(3)
    data = [with_extra(random.choice("abc"), random.choice([None, "s1"]), random.randrange(0, 40) * GAP // 3 + random.choice([0, 1])) for _ in range(400)]
    expected = []
    groups = {}
    for d, s, t, *_ in data:
        groups.setdefault((d, s or ""), []).append(t)
    for (d, s), times in groups.items():
        run = []
        for t in sorted(times):
            if run and t - run[-1] > GAP:
                expected.append((d, s, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        expected.append((d, s, run[0], run[-1], len(run)))
    found = sessions.event_sessions(events(spark, data)).drop("session_no", "duration_us")
    assert rows(found) == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


# ---- differences


def test_differences_field_by_field(spark, rows):
    schema = "k string, a string, b long, surplus int"
    left = spark.createDataFrame([("1", "x", 1, 0), ("2", "x", None, 0), ("3", "x", 3, 0), (None, "n", 1, 0), ("5", "e", 5, 9)], schema)
    right = spark.createDataFrame([("1", "x", 1, 5), ("2", "y", 2, 0), ("4", "x", 3, 0), (None, "n", 2, 0), ("5", "e", 5, 9)], schema)
    found = data_diff.diff_copies(left, right, "k", ["a", "b"], "no_right", "no_left").select("k", "field")
    assert rows(found) == [("2", "a"), ("2", "b"), ("3", "no_right"), ("4", "no_left"), (None, "b")]


def test_surplus_copies_and_empty_sides(spark, rows):
    left = spark.createDataFrame([("1", "x")] * 3, "k string, a string")
    right = left.limit(1)
    found = data_diff.diff_copies(left, right, "k", ["a"], "no_right", "no_left")
    assert rows(found) == [("1", "no_right", 2, 0)]
    empty = spark.createDataFrame([], "k string, a string")
    assert data_diff.diff_copies(empty, empty, "k", ["a"], "l", "r").count() == 0
    assert rows(data_diff.diff_copies(empty, right, "k", ["a"], "l", "r")) == [("1", "r", 0, 1)]


# ---- late events


def arrivals(spark, data):
    return spark.createDataFrame(data, "uuid string, project_id string, at long, arrived_us long, pane string")


def test_the_cut_off_is_inclusive(spark, rows):
    times = [None, HOUR, HOUR + 1, 49 * HOUR, 49 * HOUR + 1]
    found = late_events.compose(late_events.pane_deltas(arrivals(spark, [(str(i), "p", 10, t, "x") for i, t in enumerate(times)]), ["project_id"]), ["project_id"])
    assert rows(found) == [("p", 0, 2, 4, 1)]


def test_no_events_and_events_without_time(spark, rows):
    assert late_events.pane_deltas(arrivals(spark, []), ["project_id"]).count() == 0
    found = late_events.pane_deltas(arrivals(spark, [("a", None, -1, None, "x"), ("b", None, None, 5, "x")]), ["project_id"])
    assert rows(found) == [(None, -HOUR, 1, 0, 0)]


def test_windows_are_sums_of_their_panes(spark):
    random.seed(1)
    data = [(str(i), random.choice("pq"), random.randrange(20 * HOUR), random.choice([None, random.randrange(90 * HOUR)]), "x") for i in range(300)]
    panes = late_events.pane_deltas(arrivals(spark, data), ["project_id"])
    whole = {(r["project_id"], r["window_start"]): r for r in late_events.compose(panes, ["project_id"], 6 * HOUR, 2 * HOUR).collect()}
    plain = {(r["project_id"], r["pane"]): r for r in panes.collect()}
    for (p, start), w in whole.items():
        inside = [r for (q, pane), r in plain.items() if q == p and start <= pane < start + 6 * HOUR]
        assert w["n_first"] == sum(r["n_first"] for r in inside)
        assert w["n_final"] == sum(r["n_first"] + r["n_in_time"] for r in inside)
    with pytest.raises(ValueError):
        late_events.covering(panes, HOUR + 1, HOUR)


def test_batches_add_up_to_the_whole_and_a_repeated_batch_changes_nothing(spark, rows):
    random.seed(2)
    data = [(f"u{i % 150}", "p", (i % 150) * HOUR // 7, random.randrange(30 * HOUR), "x") for i in range(200)]
    store = PaneStore(spark, scratch(spark), ["project_id"])
    changed = [store.add(arrivals(spark, data[k : k + 50]), n) for n, k in enumerate(range(0, 200, 50))]
    assert rows(store.add(arrivals(spark, data[50:100]), 1)) == rows(changed[1])
    first = {d[0]: d for d in reversed(data)}
    assert rows(store.panes()) == rows(late_events.pane_deltas(arrivals(spark, list(first.values())), ["project_id"]))
    again = store.windows(changed[1], 2 * HOUR, HOUR)
    whole = late_events.compose(store.panes(), ["project_id"], 2 * HOUR, HOUR)
    touched = {(r["project_id"], w) for r in changed[1].collect() for w in (r["pane"], r["pane"] - HOUR)}
    assert rows(again) == [r for r in rows(whole) if (r[0], r[1]) in touched]


def test_a_retry_inside_a_batch_counts_at_its_earliest_time(spark, rows):
    """As in the batch form: the earliest event and the first arrival, whatever order they come in."""
    data = [("u", "p", 5 * HOUR, 9 * HOUR, "x"), ("u", "p", 2 * HOUR, 8 * HOUR, "x"), ("u", "p", 7 * HOUR, 3 * HOUR, "x"), ("v", "p", 1, None, "x"), (None, "p", 3, 4, "x")]
    store = PaneStore(spark, scratch(spark), ["project_id"])
    for given in (data, data[::-1]):
        store = PaneStore(spark, scratch(spark), ["project_id"])
        store.add(arrivals(spark, given), 0)
        assert rows(store.panes()) == [("p", 0, 2, 0, 0), ("p", 2 * HOUR, 1, 0, 0)]


def test_the_store_stays_bounded_and_forgets_old_uuids(spark, rows):
    random.seed(4)
    root = scratch(spark)
    store = PaneStore(spark, root, ["project_id"], lateness_us=2 * HOUR, remember_us=10 * HOUR, fold_every=3)
    data = [[(f"u{n}-{i}", "p", max(0, n - random.randrange(4)) * HOUR, n * HOUR + i, "x") for i in range(5)] for n in range(16)]
    for n, batch in enumerate(data):
        retry = data[n - 1][:2] if n else []
        changed = store.add(arrivals(spark, batch + retry), n)
        assert rows(store.add(arrivals(spark, batch + retry), n)) == rows(changed)  # tried again
        assert len(names(spark, f"{root}/deltas")) <= 4 and len(names(spark, f"{root}/taken")) <= 15 and len(names(spark, f"{root}/folds")) <= 1
    assert len(names(spark, f"{root}/taken")) < 16
    whole = [r for batch in data for r in batch]
    assert rows(store.panes()) == rows(late_events.pane_deltas(arrivals(spark, whole), ["project_id"], lateness_us=2 * HOUR))
    again = store.windows(changed, 3 * HOUR, HOUR)
    expected = {(r["project_id"], r["window_start"]): tuple(r) for r in late_events.compose(store.panes(), ["project_id"], 3 * HOUR, HOUR).collect()}
    assert rows(again) and all(expected[r[:2]] == r for r in rows(again))
    store.add(arrivals(spark, [data[0][0]]), 16)  # longer ago than it remembers: counts once more
    assert sum(r["n_first"] + r["n_in_time"] + r["n_too_late"] for r in store.panes().collect()) == len(whole) + 1


def test_stream_of_late_counts(spark, tmp_path):
    schema = "uuid string, project_id string, timestamp timestamp, arrived_us long"
    source, out = str(tmp_path / "in"), []
    make = lambda name, us, arrived: spark.createDataFrame([(name, "p", us, arrived)], "uuid string, project_id string, us long, arrived_us long").select("uuid", "project_id", F.timestamp_micros("us").alias("timestamp"), "arrived_us").coalesce(1).write.mode("append").parquet(source)
    make("a", 10, 20)
    for batch in (None, ("b", 11, 3 * HOUR), ("c", 12, 100 * HOUR)):
        if batch:
            make(*batch)
        query = late_counts(spark.readStream.schema(schema).parquet(source), str(tmp_path / "store"), str(tmp_path / "cp"), lambda w, n: out.append([tuple(r) for r in w.collect()]), ["project_id"], availableNow=True)
        query.awaitTermination()
    assert out == [[("p", 0, 1, 1, 0)], [("p", 0, 1, 2, 0)], [("p", 0, 1, 2, 1)]]


# ---- small files


@given(st.lists(st.integers(0, 120), max_size=60), st.integers(50, 100))
def test_first_fit_decreasing_equals_the_plain_rule(sizes, capacity):
    found = compaction.first_fit_decreasing(np.array(sizes, dtype=np.int64), capacity) if sizes else []
    free, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i] > capacity:
            continue
        for b, room in enumerate(free):
            if room >= sizes[i]:
                break
        else:
            free.append(capacity)
            b = len(free) - 1
        free[b] -= sizes[i]
        expected[i] = b
    assert {i: int(found[i]) for i in expected} == expected
    large = [int(found[i]) for i in range(len(sizes)) if sizes[i] > capacity]
    assert len(set(large)) == len(large) and not set(large) & set(expected.values())


FILES = "id long, project_id string, day string, relative_path string, rows long, bytes long, level int, created_generation long, retired_generation long, bin string"


def file(i, path, size, day="2018-01-01", retired=None, project="p"):
    return (i, project, day, path, 1, size, 0, 1, retired, "x")


def test_plan_counts_a_file_once_however_it_is_spelled(spark, rows):
    data = [file(1, "p/2018-01-01/a.parquet", 10), file(2, "./p//2018-01-01/a.parquet", 10), file(3, "/lake/p/2018-01-01/b.parquet", None), file(4, r"p\2018-01-01\c.parquet", 40_000), file(5, "p/2018-01-02/a.parquet", 5, "2018-01-02"), file(6, "p/2018-01-01/d.parquet", 5, retired=3), file(7, "p/2018-01-01/x/../b.parquet", None), file(8, None, 1), file(9, None, 1, "2018-01-02")]
    found = compaction.plan(spark.createDataFrame(data, FILES))
    assert rows(found.select("id", "bin")) == [(1, 0), (3, 0), (5, 0), (8, 0), (9, 0)]
    assert compaction.plan(spark.createDataFrame([], FILES)).count() == 0


def test_a_day_of_many_files_is_packed_in_chunks(spark):
    data = [file(i, f"p/2018-01-01/{i}.parquet", 10) for i in range(100)]
    found = compaction.plan(spark.createDataFrame(data, FILES), files_a_chunk=30, target_bytes=100)
    assert found.count() == 100 and found.select("chunk").distinct().count() > 1
    assert found.groupBy("chunk", "bin").count().agg(F.max("count")).first()[0] <= 10


def test_compaction_keeps_every_row_once_and_commits_at_the_end(spark, rows, tmp_path):
    data = [file(i, f"p/2018-01-01/{i}.parquet", 10) for i in range(5)] + [file(9, "./p/2018-01-01/1.parquet", 10)]
    manifest = compaction.plan(spark.createDataFrame(data, FILES), target_bytes=30)
    events = spark.createDataFrame([(f"e{i % 7}", None if i % 3 else "n", i % 6 if i % 6 != 5 else 9) for i in range(60)], "event string, note string, file_id long")
    report = compaction.compact(events, manifest, str(tmp_path), 1)
    assert sum(r["n_rows"] for r in report.collect()) == 60
    assert [p["generation"] for p in compaction.published(spark, str(tmp_path))] == [1]
    written = spark.read.parquet(str(tmp_path / "generation-1")).select("event", "note")
    assert rows(written) == rows(events.select("event", "note"))
    with pytest.raises(ValueError):
        compaction.compact(events, manifest, str(tmp_path), 1)
    assert [p["generation"] for p in compaction.published(spark, str(tmp_path))] == [1]


# ---- feature table


def test_features_of_entities_with_and_without_events(spark):
    schema = "project_id string, distinct_id string, event string, session_id string, at long, amount double, n int, person_id int"
    data = [("p", "a", "buy", "s1", 5, 1.5, 0, 0), ("p", "a2", "buy", None, 9, None, 0, 0), ("p", "a2", "view", None, 9 + GAP + 1, 2.0, 0, 0), ("p", "lost", None, None, 3, None, 0, 0), ("p", "a", "buy", "s2", None, None, 0, 0)]
    ids = spark.createDataFrame([("p", "a", "P", 0), ("p", "a2", "old", 0), ("p", "a2", "P", 2)], "project_id string, distinct_id string, person_id string, seq long")
    entities = spark.createDataFrame([("p", "P"), ("p", "none"), ("p", "lost")], "project_id string, person_id string")
    cells = feature_table.activity(spark.createDataFrame(data, schema).drop("person_id"), ids)
    found = {r["person_id"]: r for r in feature_table.feature_table(entities, cells, 3, 2).collect()}
    p = found["P"]
    assert (p["event_count"], p["first_seen"], p["last_seen"], p["session_count"]) == (4, 5, 9 + GAP + 1, 4)
    assert {k: tuple(v) for k, v in p["features"].items()} == {"buy": (3, 9, 1.5), "view": (1, 9 + GAP + 1, 2.0)}
    assert tuple(found["none"])[2:] == (0, None, None, 0, {})
    assert found["lost"]["features"][""]["n"] == 1


def test_null_and_empty_event_names_of_one_person_are_one_name(spark):
    schema = "project_id string, distinct_id string, event string, session_id string, at long, amount double"
    events = spark.createDataFrame([("p", "a", None, "s", 5, 1.0), ("p", "a", "", "s", 6, 2.0), ("p", "a", "x", None, 7, None)], schema)
    ids = spark.createDataFrame([], "project_id string, distinct_id string, person_id string, seq long")
    entities = spark.createDataFrame([("p", "a")], "project_id string, person_id string")
    found = feature_table.feature_table(entities, feature_table.activity(events, ids)).first()
    assert {k: tuple(v) for k, v in found["features"].items()} == {"": (2, 6, 3.0), "x": (1, 7, None)}
    assert found["event_count"] == 3 and found["session_count"] == 2


def test_stale_stats(spark, rows):
    schema = "project_id string, person_id string, event_count long, first_seen long, last_seen long, session_count long"
    a = spark.createDataFrame([("p", "same", 1, 2, 3, 1), ("p", "new", 0, None, None, 0), ("p", "wrong", 1, 2, 3, 1)], schema)
    b = spark.createDataFrame([("p", "same", 1, 2, 3, 1), ("p", "same", 1, 2, 3, 1), ("p", "gone", 0, None, None, 0), ("p", "wrong", 1, 2, None, 1)], schema)
    assert rows(feature_table.stale_stats(a, b)) == [("p", "gone"), ("p", "new"), ("p", "wrong")]


# ---- lake


def test_publication_and_reading_back(spark, tmp_path):
    base = ("e", "d", "{}") + (None,) * 14
    data = [(u, base[0], base[1], t, *base[2:], "p") for u, t in (("1", 0), ("1", 5), ("2", DAY), ("3", 2 * DAY))]
    columns = [f.name for f in lake.EVENT_SCHEMA]
    schema = ", ".join(f"{n} {'long' if n == 'timestamp' else 'string'}" for n in columns) + ", project_id string"
    events = spark.createDataFrame([tuple(d) for d in data], schema).withColumn("timestamp", F.timestamp_micros("timestamp"))
    root = str(tmp_path / "lake")
    lake.publish(events, root)
    # directories carry partition names here; the catalog form has bare ones
    read = spark.read.parquet(root)
    assert read.count() == 3
    lake.rewrite_days(spark, root, spark.createDataFrame(read.where("day = '1970-01-01'").collect(), read.schema))
    assert spark.read.parquet(root).count() == 3
    snap = lake.directory_snapshot(spark, root, "project_id=p", "day=1970-01-01", "day=1970-01-02")
    assert lake.read(spark, snap).count() == 1
    assert lake.read(spark, lake.Snapshot((), "0")).count() == 0


def lake_events(spark, rows):
    """Events (uuid, distinct_id, event, us, project) in the lake's schema."""
    base = spark.createDataFrame([(u, e, d, us, "{}", p) for u, d, e, us, p in rows], "uuid string, event string, distinct_id string, us long, properties string, project_id string")
    missing = {f.name: F.lit(None).cast("string") for f in lake.EVENT_SCHEMA if f.name not in base.columns and f.name != "timestamp"}
    return base.withColumn("timestamp", F.timestamp_micros("us")).withColumns(missing).select("project_id", *lake.EVENT_SCHEMA.names)


def test_a_lake_is_changed_one_commit_at_a_time(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    assert lake.catalog(spark, root).count() == 0 and lake.generation(spark, root) == 0
    live = lambda: lake.catalog(spark, root).where("retired_generation IS NULL")
    held = lambda: sorted((r["uuid"], r["project_id"], r["day"]) for r in lake.read_lake(spark, root, live()).collect())
    first = lake_events(spark, [("1", "a", "x", 0, "p"), ("1", "a", "x", 5, "p"), ("2", "b", "x", DAY, "p"), ("3", "a", "y", 1, "q: %1+")])
    assert lake.commit(spark, root, first, None, 0, tag="batch-0") == 1
    assert lake.commit(spark, root, first, None, 0, tag="batch-0") == 0  # tried again
    assert lake.commit(spark, root, lake_events(spark, [("1", "a", "x", 0, "p"), ("4", "b", "y", 7, "p")]), None, 0, tag="batch-1") == 2
    assert lake.commit(spark, root, first.limit(0), None, 0, tag="batch-2") == 3
    assert held() == [("1", "p", "1970-01-01"), ("1", "p", "1970-01-01"), ("2", "p", "1970-01-02"), ("3", "q: %1+", "1970-01-01"), ("4", "p", "1970-01-01")]
    found = lake.read(spark, lake.catalog_snapshot(lake.catalog(spark, root), root, "p", "1970-01-01", "1970-01-02"))
    assert sorted(r["uuid"] for r in found.collect()) == ["1", "1", "4"]
    assert {(r["rows"], r["level"]) for r in live().collect()} == {(1, 0), (2, 0)} and live().where("bytes > 0").count() == live().count() == 4
    with lake.hold(spark, root):
        assert lake.compact(spark, root, 0) == 2  # the day with two small files
        assert held() == [("1", "p", "1970-01-01"), ("2", "p", "1970-01-02"), ("3", "q: %1+", "1970-01-01"), ("4", "p", "1970-01-01")]
        assert lake.vacuum(spark, root) == 0  # held
        assert sorted(r["uuid"] for r in found.collect()) == ["1", "1", "4"]
    assert lake.vacuum(spark, root) == 2
    before = {r["relative_path"] for r in live().where("day = '1970-01-02'").collect()}
    gone = spark.createDataFrame([("p", "a"), ("q: %1+", "nobody")], "project_id string, distinct_id string")
    assert lake.erase(spark, root, gone, 0) == 1 and lake.erase(spark, root, gone, 0) == 0
    assert held() == [("2", "p", "1970-01-02"), ("3", "q: %1+", "1970-01-01"), ("4", "p", "1970-01-01")]
    assert before <= {r["relative_path"] for r in live().collect()}  # untouched
    assert lake.retire(spark, root, "1970-01-02", 0, 0) == 2 and held() == [("2", "p", "1970-01-02")]
    number = lake.generation(spark, root)
    for i in range(12):
        lake.commit(spark, root, lake_events(spark, [(f"n{i}", "c", "x", 2 * DAY, "p")]), None, 0)
    lake.merge_commits(spark, root)
    assert lake.generation(spark, root) == number + 12 and len(held()) == 13
    assert len(names(spark, f"{root}/catalog")) == lake.KEPT_COMMITS + 1


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    rows_ = [(f"{i:05d}", "a", f"e{i % 7}", i, "hot") for i in range(4000)] + [(f"c{i}", "a", "e", i * DAY, "cold") for i in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if each part were large
    try:
        lake.publish(lake_events(spark, rows_), str(tmp_path / "lake"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    read = spark.read.parquet(str(tmp_path / "lake"))
    spans = read.where("project_id = 'hot'").groupBy("_metadata.file_path").agg(F.min("event").alias("lo"), F.max("event").alias("hi"), F.count("*").alias("n")).orderBy("lo", "hi").collect()
    assert len(spans) > 1 and max(s["n"] for s in spans) < 4000 and read.count() == 4005
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:]))


def test_scratch_data_is_written_in_the_shared_folder_and_can_be_cleaned(spark, rows):
    from pathlib import Path

    from strandline.session import clean, materialize

    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    written = materialize(df)
    assert rows(written) == rows(df) and written.schema == df.schema
    folder = Path(scratch(spark)).parent
    assert any(folder.iterdir())
    clean(spark)
    assert not folder.exists()
