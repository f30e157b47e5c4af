import base64
import gzip
import hashlib
import json
import random
from urllib.parse import quote

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.contract import InvalidQuery, check_pattern
from strandline.functions.times import DAY
from strandline.operators import flags, identity, sql_tab
from strandline.plans import engine
from strandline.sources import capture, demo, lake
from strandline.sources.lake import by_day
from strandline.streaming.ingest import BODY_SCHEMA, ingest
from tests.test_insights import make, us

NOW = us("2026-03-15T12:00:00")


# ---- flags


def ids(spark, names, properties="{}"):
    people = spark.createDataFrame([("p", n, properties, f"first-{n}") for n in names], "project_id string, id string, properties string, first_seen_key string")
    return spark.createDataFrame([("p", n, n) for n in names], "project_id string, distinct_id string, person_id string"), people


def plain_hash(key, who, salt=""):
    return int(hashlib.sha1(f"{key}.{who}{salt}".encode()).hexdigest()[:15], 16) / 0xFFFFFFFFFFFFFFF


def test_rollout_and_variants_of_a_thousand_ids(spark):
    names = [f"distinct_id_{i}" for i in range(1000)]
    shares = [("first-variant", 50), ("second-variant", 20), ("third-variant", 20), ("fourth-variant", 5), ("fifth-variant", 5)]
    definitions = [
        {"key": "simple-flag", "filters": {"groups": [{"rollout_percentage": 45}]}},
        {"key": "multivariate-flag", "filters": {"groups": [{"rollout_percentage": 55}], "multivariate": {"variants": [{"key": k, "rollout_percentage": s} for k, s in shares]}}},
    ]
    found = {(r["flag"], r["distinct_id"]): r for r in flags.evaluate_all(definitions, *ids(spark, names), NOW).collect()}
    for who in names:
        assert found["simple-flag", who]["enabled"] == (plain_hash("simple-flag", who) <= 0.45)
        on = plain_hash("multivariate-flag", who) <= 0.55
        low, variant = 0.0, None
        for k, s in shares:
            if low <= plain_hash("multivariate-flag", who, "variant") < low + s / 100:
                variant = k
            low += s / 100
        assert (found["multivariate-flag", who]["enabled"], found["multivariate-flag", who]["variant"]) == (on, variant if on else None)


@pytest.mark.parametrize(
    "operator, value, stored, expected",
    [
        ("exact", "Team", '"team"', True),
        ("exact", ["a", "B"], '"b"', True),
        ("exact", "true", "true", True),
        ("exact", True, '"True"', True),
        ("exact", "false", '"anything"', True),
        ("exact", [], "5", False),
        ("exact", 5, "5", True),
        ("is_not", "x", '"x"', False),
        ("is_not", "x", None, False),
        ("is_set", None, "null", True),
        ("is_not_set", None, None, True),
        ("icontains", "EA", '"team"', True),
        ("not_icontains", "EA", '"team"', False),
        ("not_icontains", "x", "null", False),
        ("regex", "^t", '"team"', True),
        ("regex", "(", '"team"', False),
        ("not_regex", "(", '"team"', False),
        ("gt", 9, '" 10"', True),
        ("gt", "9", '"abc"', True),
        ("lt", "b", '"abc"', True),
        ("lte", 10, "10.0", True),
        ("is_date_before", "-1d", '"2026-03-10"', True),
        ("is_date_after", "2026-03-01", '"2026-03-10T00:00:00Z"', True),
        ("is_date_after", "soon", '"2026-03-10"', False),
    ],
)
def test_flag_operators(spark, operator, value, stored, expected):
    document = "{}" if stored is None else '{"k":' + stored + "}"
    df = spark.createDataFrame([(document,)], "d string").select(F.from_json("d", "map<string,string>").alias("m"))
    assert df.select(flags.property_condition({"key": "k", "operator": operator, "value": value}, F.col("m"), NOW)).first()[0] is expected


def test_closest_miss_payload_override_and_continuity(spark):
    groups = [{"properties": [{"key": "plan", "value": "no"}]}, {"rollout_percentage": 0}, {"variant": "b", "properties": [{"key": "plan", "value": "pro"}]}]
    flag = {"key": "f", "ensure_experience_continuity": True, "filters": {"groups": groups, "multivariate": {"variants": [{"key": "a", "rollout_percentage": 100}, {"key": "b", "rollout_percentage": 0}]}, "payloads": {"b": {"x": 1}}}}
    off = {"key": "off", "active": False, "filters": {"groups": [{}]}}
    r = {x["flag"]: x for x in flags.evaluate_all([flag, off], *ids(spark, ["u"], '{"plan":"pro"}'), NOW).collect()}
    assert (r["f"]["enabled"], r["f"]["variant"], json.loads(r["f"]["payload"]), r["f"]["condition_index"]) == (True, "b", {"x": 1}, 2)
    assert (r["off"]["enabled"], r["off"]["reason"]) == (False, "disabled")
    missed = flags.evaluate_all([flag], *ids(spark, ["u"]), NOW).first()
    assert (missed["reason"], missed["condition_index"]) == ("out_of_rollout_bound", 1)
    assert [f["key"] for f in flags.definitions([flag, off])["flags"]] == ["f"]
    for bad in ({"key": "a b"}, {"key": "x", "filters": {"groups": [{"rollout_percentage": 101}]}}, {"key": "x", "filters": {"multivariate": {"variants": [{"key": "a", "rollout_percentage": 50}]}}}):
        with pytest.raises(InvalidQuery):
            flags.validate([bad])


# ---- identity


def told(spark, data):
    rows = [("p", who, event, i * 10, json.dumps(props), i) for i, (event, who, props) in enumerate(data)]
    return spark.createDataFrame(rows, "project_id string, distinct_id string, event string, at long, properties string, seq long")


def owners(spark, data):
    return {r["distinct_id"]: r["person_id"] for r in identity.resolve(told(spark, data)).collect()}


def test_merges_and_refusals(spark):
    ident = lambda who, anon: ("$identify", who, {"$anon_distinct_id": anon})
    assert owners(spark, [("x", "a", {}), ident("u", "a"), ("x", "a", {})]) == {"a": "u", "u": "u"}
    assert owners(spark, [ident("u", "a"), ident("v", "a")]) == {"a": "u", "u": "u", "v": "v"}
    assert owners(spark, [("$identify", "u", {}), ("$create_alias", "a", {"alias": "u"})]) == {"a": "u", "u": "u"}
    assert owners(spark, [("$identify", "u", {}), ("$identify", "v", {}), ("$create_alias", "v", {"alias": "u"})]) == {"u": "u", "v": "v"}
    assert owners(spark, [("$identify", "u", {}), ("$identify", "v", {}), ("$merge_dangerously", "v", {"alias": "u"})]) == {"u": "v", "v": "v"}
    assert owners(spark, [ident("u", ""), ident("w", "w"), ("$identify", "n", {"$anon_distinct_id": None})]) == {"u": "u", "w": "w", "n": "n"}


def test_properties_and_first_key_of_a_merged_person(spark):
    data = [("$set", "a", {"$set": {"plan": "free", "x": 1}}), ("$identify", "u", {"$anon_distinct_id": "a", "$set": {"plan": "pro"}, "$set_once": {"x": 2, "y": 3}, "$unset": ["z"]})]
    rows = {r["distinct_id"]: r for r in identity.resolve(told(spark, data)).collect()}
    u = rows["u"]
    assert (json.loads(u["properties"]), u["first_seen_key"], u["created_us"], u["last_seen_us"], u["is_identified"]) == ({"plan": "pro", "x": 1, "y": 3}, "a", 0, 10, True)
    assert not rows["a"]["is_person"]
    resolved = identity.resolve(told(spark, data))
    assert [tuple(r) for r in identity.overrides(resolved).collect()] == [("p", "a", "u")]


def plainly(data):
    """Every event in turn, every id's owner in a dict: id -> (person, seq), person -> identified, first key, properties."""
    owner, moved, people = {}, {}, {}
    for seq, (event, who, props) in enumerate(data):
        other = props.get("$anon_distinct_id") if event == "$identify" else props.get("alias") if event in ("$create_alias", "$merge_dangerously") else None
        ensure = [who] + ([other] if other and other != who else [])
        for i in ensure:
            if i not in owner:
                owner[i], moved[i], people[i] = i, 0, [False, (seq, i), {}]
        if len(ensure) == 2 and owner[who] != owner[other]:
            win, lose = owner[who], owner[other]
            refused = people[lose][0] and (event == "$identify" or event == "$create_alias" and people[win][0])
            if not refused:
                if people[lose][0] and event == "$create_alias":
                    win, lose = lose, win
                gone = people.pop(lose)
                people[win] = [True, min(people[win][1], gone[1]), gone[2] | people[win][2]]
                for i in owner:
                    if owner[i] == lose:
                        owner[i], moved[i] = win, seq
        if event in ("$identify", "$create_alias"):
            people[owner[who]][0] = True
        people[owner[who]][2].update(props.get("$set", {}))
    return {i: (owner[i], moved[i]) for i in owner}, {p: (v[0], v[2]) for p, v in people.items()}


def test_the_fold_equals_one_event_after_the_other(spark):
    """With repeated identity events, refusals, swaps and properties."""
    random.seed(11)
    for _ in range(4):
        data = []
        for n in range(150):
            who, other = (f"i{random.randrange(12)}" for _ in "ab")
            event = random.choice(["$identify", "$create_alias", "$merge_dangerously", "x", "x", "$set"] if n > 20 else ["$identify", "$create_alias", "x"])
            props = {"$anon_distinct_id" if event == "$identify" else "alias": other} if event in identity.JOINS else {"$set": {"k": n}} if event == "$set" else {}
            data.append((event, who, props))
        expected = plainly(data)
        found = identity.resolve(told(spark, data)).collect()
        assert {r["distinct_id"]: (r["person_id"], r["seq"]) for r in found} == expected[0]
        assert {r["person_id"]: (r["is_identified"], json.loads(r["properties"])) for r in found if r["is_person"]} == expected[1]


def test_the_fold_of_a_hot_component_grows_with_its_events_only():
    """A chain of 20,000 merges that move ever more ids, and an id with 100,000 events, in batches."""
    import time

    n = 20_000
    merges = [("p", "c", i, i, "$merge_dangerously", f"w{i + 1}", f"w{i}", None) for i in range(n)]
    sets = [("p", "c", n + i, i, "$set", "w0", None, json.dumps({"$set": {f"k{i % 5}": i}})) for i in range(100_000)]
    columns = ["project_id", "component", "seq", "at", "event", "distinct_id", "other", "changes"]
    rows = merges + sets
    frames = (pd.DataFrame(rows[i : i + 10_000], columns=columns) for i in range(0, len(rows), 10_000))
    began = time.perf_counter()
    (found,) = identity.fold(frames)
    assert time.perf_counter() - began < 20
    assert len(found) == n + 1 and set(found["person_id"]) == {f"w{n}"}
    assert found.set_index("distinct_id")["seq"].loc["w0"] == n - 1
    assert json.loads(found[found["is_person"]]["properties"].iloc[0])["k4"] == 99_999


def test_unguarded_merges_are_connected_components(spark):
    random.seed(4)
    pairs = [(f"n{random.randrange(40):02d}", f"n{random.randrange(40):02d}") for _ in range(30)]
    found = owners(spark, [("$merge_dangerously", a, {"alias": b}) for a, b in pairs])
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = lambda owner: {frozenset(n for n in parent if owner(n) == o) for o in {owner(n) for n in parent}}
    assert groups(lambda n: found[n]) == groups(root)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(100)] + [("x", "x")], "a string, b string")
    found = identity.components(edges)
    assert found.count() == 101 and {r["component"] for r in found.collect()} == {"000"}
    assert identity.components(edges.limit(0)).count() == 0


def test_rounds_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(identity, "MAX_ROUNDS", 1, raising=False)
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)], "a string, b string")
    assert {r["component"] for r in identity.components(edges).collect()} == {"000"}


def test_changes_and_groups(spark, rows):
    current = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y")], "project_id string, distinct_id string, person_id string")
    changes = spark.createDataFrame([("p", "a", "z", 1), ("p", "a", "w", 2), ("p", "b", "b", 3)], "project_id string, distinct_id string, person_id string, seq long")
    assert rows(identity.apply_changes(current, changes)) == [("p", "a", "w")]
    data = [("$groupidentify", "u", {"$group_type": "org", "$group_key": 5, "$group_set": {"a": 1, "b": 2}}), ("$groupidentify", "u", {"$group_type": "org", "$group_key": "5", "$group_set": {"b": 3}}), ("$groupidentify", "u", {"$group_type": "org", "$group_key": "none"})]
    assert {r["group_key"]: r["properties"] for r in identity.groups(told(spark, data)).collect()} == {"5": {"a": "1", "b": "3"}, "none": {}}


# ---- capture


def bodies(spark, *items, sent=None):
    return spark.createDataFrame([(json.dumps(b) if not isinstance(b, str) else b, NOW, sent, "Mozilla/5.0 (X11; Linux x86_64; rv:9) Gecko Firefox/120.0", "10.0.0.1") for b in items], BODY_SCHEMA)


def test_body_shapes(spark):
    e = {"event": "x", "token": "t", "distinct_id": "d"}
    found = capture.parse(bodies(spark, [e, e], {"batch": [e, {"event": "$performance_event"}, 5], "token": "b"}, e, {"token": "t", "distinct_id": "d", "$set": {"a": 1}}, "junk", "7"))
    assert sorted((r["event"], r["batch_token"] or "") for r in found.collect()) == [("$identify", ""), ("x", ""), ("x", ""), ("x", ""), ("x", "b")]
    assert capture.rejected(bodies(spark, e, "junk")).count() == 1


def pack_lz(text):
    """An encoder for the tests: new characters as they are, known ones by their single entry."""
    bits, table, width, room, last = [], ["", "", ""], 2, 4, None
    put = lambda value, n: bits.extend(value >> k & 1 for k in range(n))
    for c in text:
        if c in table[3:]:
            put(table.index(c, 3), width)
        else:
            put(0 if ord(c) < 256 else 1, width)
            put(ord(c), 8 if ord(c) < 256 else 16)
            table.append(c)
            room -= 1
            if last is None:
                width, room = 3, 4
            elif room == 0:
                room, width = 1 << width, width + 1
        if last is not None:
            table.append(last + c)
            room -= 1
            if room == 0:
                room, width = 1 << width, width + 1
        last = c
    put(2, width)
    bits += [0] * (-len(bits) % 6)
    return "".join(capture.LZ_LETTERS[sum(b << (5 - k) for k, b in enumerate(bits[i : i + 6]))] for i in range(0, len(bits), 6))


def test_packed_bodies(spark):
    body = '[{"event":"x","token":"t","distinct_id":"дé"}]'
    plain = base64.b64encode(body.encode())
    cases = [(body.encode(), None), (gzip.compress(body.encode()), "gzip"), (plain, "base64"), (b"data=" + quote(plain).encode(), None), (pack_lz(body).encode(), "lz64"), (gzip.compress(plain), None)]
    broken = [(b"\x1f\x8bnope", None), (b"%%%", None), (None, None), (b"", None), (b"AAA", "lz64")]
    df = spark.createDataFrame(cases + broken, "body binary, compression string")
    assert [r["body"] for r in capture.unpack_bodies(df).collect()] == [body] * len(cases) + [None] * len(broken)


def test_field_resolution(spark):
    at = lambda **e: capture.resolve(capture.parse(bodies(spark, {"event": "x", "token": "t", "distinct_id": "d"} | e, sent=e.pop("sent", None)))).select(F.unix_micros("timestamp")).first()[0]
    assert at() == NOW
    assert at(offset=5000) == NOW - 5_000_000
    assert at(timestamp="2026-03-15T10:00:00Z") == us("2026-03-15T10:00:00")
    assert at(timestamp="2026-03-15 10:00:00+02") == us("2026-03-15T08:00:00")
    assert at(timestamp="2026-03-16T11:30:00Z") == NOW
    skewed = bodies(spark, {"event": "x", "token": "t", "distinct_id": "d", "timestamp": "2026-03-15T10:00:00Z"}, sent=NOW - 60_000_000)
    assert capture.resolve(capture.parse(skewed)).select(F.unix_micros("timestamp")).first()[0] == us("2026-03-15T10:01:00")
    odd = bodies(spark, {"event": "x", "token": "t", "distinct_id": 12345}, {"event": "x", "token": "t", "distinct_id": "  "}, {"event": "x", "distinct_id": "d"}, {"event": "x", "properties": {"token": "t", "distinct_id": "p" * 300, "$pathname": "/a", "$browser": "Own"}, "$set": {"k": 1}}, {"event": "x", "token": "t", "distinct_id": "d", "uuid": "nope"})
    found = {r["distinct_id"]: r for r in capture.enrich(capture.resolve(capture.parse(odd)), "salt").collect()}
    assert set(found) == {"12345", "p" * 200}
    assert json.loads(found["p" * 200]["properties"])["$set"] == {"k": 1}
    assert (found["p" * 200]["pathname"], found["p" * 200]["browser"], found["12345"]["browser"], found["12345"]["os"], found["12345"]["device_type"]) == ("/a", "Own", "Firefox", "Linux", "Desktop")
    assert len(found["12345"]["device_id"]) == 16


AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36": ("Chrome", "120.0.0.0", "Windows 10", "10.0", "Desktop"),
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.1": ("Edge", "120.1", "Windows 10", "10.0", "Desktop"),
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1": ("Safari", "17.2", "iOS", "17.2", "Mobile"),
    "Mozilla/5.0 (Linux; Android 13; SM-S901B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0 Mobile Safari/537.36": ("Samsung Internet", "23.0", "Android", "13", "Mobile"),
    "Mozilla/5.0 (Linux; Android 12; SM-X906C) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/118.0 Safari/537.36": ("Chrome", "118.0", "Android", "12", "Tablet"),
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15": ("Safari", "17.1", "Mac OSX", "10.15.7", "Desktop"),
    "Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko": ("Internet Explorer", "11.0", "Windows 7", "6.1", "Desktop"),
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)": (None, None, None, None, "Crawler"),
    "curl/8.0": (None, None, None, None, "Desktop"),
    "": (None, None, None, None, None),
}


def test_user_agents(spark):
    columns = ["browser", "os", "device_type", "properties"]
    schema = "user_agent string, browser string, os string, device_type string, properties string"
    df = spark.createDataFrame([(a, None, None, None, '{"a":1}') for a in AGENTS], schema)
    for (agent, expected), r in zip(AGENTS.items(), capture.enrich(df).select("user_agent", *columns).collect()):
        held = json.loads(r["properties"])
        keys = ("$browser", "$browser_version", "$os", "$os_version", "$device_type")
        assert r["user_agent"] == agent and tuple(map(held.get, keys)) == expected and held["a"] == 1, agent
        assert (r["browser"], r["os"], r["device_type"]) == (expected[0], expected[2], expected[4])
    given = spark.createDataFrame([(next(iter(AGENTS)), "Own", None, None, '{"$browser":"Own","$os_version":null}'), (None, None, None, None, "{}"), (next(iter(AGENTS)), None, None, None, "{}")], schema)
    own, none, empty = capture.enrich(given).collect()
    assert (own["browser"], json.loads(own["properties"])["$browser"], json.loads(own["properties"])["$os_version"]) == ("Own", "Own", None)
    assert none["properties"] == "{}" and json.loads(empty["properties"])["$os"] == "Windows 10"


def test_stream_of_bodies_is_published_once(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    projects = spark.createDataFrame([("t", "p")], "token string, project_id string")
    e = lambda i, **m: {"event": "x", "token": "t", "distinct_id": "d", "uuid": f"00000000-0000-4000-8000-{i:012d}", "timestamp": "2026-03-10T00:00:00Z"} | m
    forwarded = []
    for batch in ([e(1), e(1), e(2)], [e(3), e(4, token="unknown"), e(5, timestamp="2020-01-01T00:00:00Z")]):
        bodies(spark, {"batch": batch}).coalesce(1).write.mode("append").json(source)
        ingest(spark.readStream.schema(BODY_SCHEMA).json(source), projects, root, str(tmp_path / "cp"), forward=lambda df, n: forwarded.append(df.count()), availableNow=True).awaitTermination()
    files = lake.catalog(spark, root)
    snapshots = [lake.catalog_snapshot(files, root, "p", *days) for days in (("2000-01-01", "2100-01-01"), ("2026-03-10", "2026-03-11"))]
    found, one_day = (by_day(lake.read(spark, s)) for s in snapshots)
    assert one_day.count() == 3
    assert sorted(r["uuid"][-1] for r in found.collect()) == ["1", "2", "3", "5"]
    assert sum(forwarded) == found.count()
    assert {r["day"] for r in found.select("day").distinct().collect()} == {"2026-03-10", "2020-01-01"}


# ---- ad-hoc SQL


def test_only_a_select_over_the_events(spark):
    source = make(spark, [("x", "a", 0), ("y", "b", 5)], [("a", "A")])
    assert [r[0] for r in sql_tab.query(source, "WITH t AS (SELECT person_id FROM events) SELECT person_id FROM t ORDER BY 1;", NOW).collect()] == ["A", "b"]
    for bad in ("", "select 1; select 2", "drop table events", "set x=1", "explain select 1", "insert into events select 1", "select * from parquet.`/tmp`", "select java_method('java.lang.System', 'exit', 1)", "select reflect('a','b')", "show tables", "select * from other", "select nope from events", "x" * 20_001):
        with pytest.raises(InvalidQuery):
            sql_tab.query(source, bad, NOW)


def test_no_name_but_events_and_those_of_a_with_can_be_read(spark, tmp_path):
    """However a statement dresses it up: in texts, comments, names out of their scope, subqueries."""
    source = make(spark, [("x", "a", 0), ("y", "b", 5)], [("a", "A")])
    path = str(tmp_path / "p.parquet")
    spark.range(3).write.parquet(path)
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).write.format("parquet").option("path", str(tmp_path / "t")).saveAsTable("secret_table")
    try:
        for bad in (
            f"SELECT count(*) FROM parquet.`{path}` WHERE 'parquet, {path} as (' <> ''",
            f"SELECT * FROM parquet.`{path}` /* parquet as ( */",
            "SELECT 'secret as (' x, id FROM secret -- secret as (",
            "SELECT * FROM secret_table",
            "SELECT * FROM default.secret_table",
            "SELECT * FROM secret UNION ALL SELECT * FROM (WITH secret AS (SELECT 1 id) SELECT * FROM secret)",
            "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
            "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 id) SELECT * FROM a",
            "SELECT (SELECT max(id) FROM secret) m FROM events",
            "SELECT event FROM events WHERE 1 IN (WITH q AS (SELECT id FROM secret) SELECT id FROM q)",
            "SELECT event FROM events WHERE EXISTS (SELECT 1 FROM secret)",
            "SELECT * FROM events, LATERAL (SELECT * FROM secret) l",
            "SELECT * FROM events |> JOIN secret",
            "SELECT * FROM IDENTIFIER('secret')",
            "TABLE secret",
            "SELECT transform(array(1), x -> reflect('a', 'b')) FROM events",
            "SELECT system.builtin.java_method('a', 'b')",
            "SELECT CURRENT_USER",
            "SELECT * FROM sql_keywords()",
            "SELECT TRANSFORM(event) USING 'cat' AS (a) FROM events",
        ):
            with pytest.raises(InvalidQuery):
                sql_tab.query(source, bad, NOW)
    finally:
        spark.sql("DROP TABLE secret_table")
        spark.catalog.dropTempView("secret")
    good = "WITH secret AS (SELECT event, 'parquet.`/x`' p FROM events e WHERE EXISTS (SELECT 1 FROM events f WHERE f.event = e.event)), t AS (SELECT * FROM secret) SELECT count(*), 'now_utc()', max(now_utc()) FROM t JOIN range(1)"
    found = sql_tab.query(source, good, NOW).first()
    assert tuple(found)[:2] == (2, "now_utc()") and found[2].timestamp() * 1e6 == NOW


def test_cells(spark):
    df = spark.sql("SELECT 1.5BD d, double('NaN') n, timestamp'2026-01-01 00:00:00' t, X'0aff' b, array(1,2) a, named_struct('x', 1) s, map('k', 2) m, date'2026-01-01' e, repeat('é', 40000) l")
    out = sql_tab.fetch(df)["rows"][0]
    assert out[:8] == ["1.5", None, "2026-01-01T00:00:00.000000Z", "0aff", [1, 2], {"x": 1}, [["k", 2]], "2026-01-01"]
    assert len(out[8].encode()) <= 64 << 10
    assert sql_tab.fetch(spark.range(10_005))["truncated"]


# ---- engine


def test_every_kind_of_request_and_its_actors(spark):
    source = make(spark, [("A", "u", "2026-03-10", {"pathname": "/"}), ("B", "u", "2026-03-11"), ("A", "v", "2026-03-12"), ("$pageview", "u", "2026-03-12", {"pathname": "/a"}), ("$pageview", "u", "2026-03-13", {"pathname": "/b"})])
    s = lambda name, **m: {"event": name} | m
    requests = {
        "TrendsQuery": ({"series": [s("A", math="dau")], "compare": True}, {"kind": "TrendsPoint"}, ["u", "v"]),
        "FunnelsQuery": ({"steps": [s("A"), s("B")], "breakdown": {"property": "k"}}, {"kind": "FunnelStep", "step": 1}, ["u"]),
        "RetentionQuery": ({"target": s("A"), "returning": s("B")}, {"kind": "RetentionCell", "cohort": 2, "offset": 1}, ["u"]),
        "LifecycleQuery": ({"series": s("A")}, {"kind": "LifecycleCell", "bucket": us("2026-03-12"), "status": "new"}, ["v"]),
        "StickinessQuery": ({"series": [s("A")]}, {"kind": "StickinessBar", "n_buckets": 1}, ["u", "v"]),
        "PathsQuery": ({}, {"kind": "PathsLink", "source": "1_/a", "target": "2_/b"}, ["u"]),
    }
    for kind, (body, selection, expected) in requests.items():
        assert engine.run({"kind": kind} | body, source, NOW)["result"], kind
        assert engine.actors({"kind": kind} | body, selection, source, NOW) == expected, kind
    assert engine.run({"kind": "SqlQuery", "query": "SELECT count(*) c FROM events"}, source, NOW)["result"]["rows"] == [[5]]
    with pytest.raises(InvalidQuery):
        engine.run({"kind": "Other"}, source, NOW)
    with pytest.raises(InvalidQuery):
        engine.actors({"kind": "TrendsQuery"}, {"kind": "PathsLink"}, source, NOW)


def test_the_people_of_a_chart_are_those_it_counts(spark):
    """Also those of all other breakdown values, and of links of filtered paths."""
    k = lambda v, **m: {"properties": json.dumps({"k": v})} | m
    data = [("A", f"u{i}", "2026-03-10", k(v)) for i, v in enumerate(["x", "x", "y", "y", "z", "w"])] + [("A", "u6", "2026-03-11"), ("A", "u7", "2026-03-01", k("old"))]
    walks = [("$pageview", p, t, k(v, pathname=n)) for p, v in (("u0", "x"), ("u1", "y")) for n, t in (("/a", "2026-03-12"), ("/b", "2026-03-13"))]
    source = make(spark, data + walks)
    ask = {"kind": "TrendsQuery", "series": [{"event": "A", "math": "dau"}], "breakdown": {"property": "k", "limit": 2}}
    lines = engine.run(ask, source, NOW)["result"]
    assert {r["breakdown"]: r["aggregated_value"] for r in lines} == {"x": 2, "y": 2, "$$_other": 3}
    for r in lines:
        people = engine.actors(ask, {"kind": "TrendsPoint", "breakdown": r["breakdown"]}, source, NOW)
        assert len(people) == r["aggregated_value"], r["breakdown"]
    assert engine.actors(ask, {"kind": "TrendsPoint", "breakdown": "$$_other"}, source, NOW) == ["u4", "u5", "u6"]
    assert engine.actors(ask, {"kind": "TrendsPoint", "breakdown": "z"}, source, NOW) == []
    for value, expected in (("x", ["u0"]), ("nobody", [])):
        paths = {"kind": "PathsQuery", "properties": [{"key": "k", "value": value}]}
        links = engine.run(paths, source, NOW)["result"]
        assert [r["persons"] for r in links] == [1] * len(expected)
        assert engine.actors(paths, {"kind": "PathsLink", "source": "1_/a", "target": "2_/b"}, source, NOW) == expected


def test_the_cache_depends_on_the_period_and_on_now_only_where_it_is_used(spark):
    source, cache = make(spark, [("A", "u", "2026-03-10")]), engine.Cache()
    cached = lambda ask, now: engine.run(ask, source, now, "p", "1", cache=cache)["meta"]["cached"]
    trend, retention = {"kind": "TrendsQuery", "series": [{"event": "A"}]}, {"kind": "RetentionQuery", "target": {"event": "A"}, "returning": {"event": "A"}}
    for ask in (trend, retention):
        assert [cached(ask, NOW), cached(ask, NOW + 60_000_000), cached(ask, NOW + DAY)] == [False, True, False]
    plain, timed = ({"kind": "SqlQuery", "query": q} for q in ("SELECT count(*), 'now_utc()' FROM events", "SELECT max(now_utc()) FROM events"))
    assert [cached(plain, NOW), cached(plain, NOW + DAY), cached(timed, NOW), cached(timed, NOW + 1)] == [False, True, False, False]
    meta = engine.run(trend, source, NOW)["meta"]
    assert (meta["date_from"][:10], meta["date_to"][:10]) == ("2026-03-08", "2026-03-16")


def test_patterns_are_those_that_will_run(spark):
    for good in ("a{1,2}+", r"\p{Alpha}+", "(?<a>C)"):
        check_pattern(good)
    for bad in ("(?P<a>C)", "(", "a**"):
        with pytest.raises(InvalidQuery):
            check_pattern(bad)


def test_results_are_cached_while_files_and_identities_are_the_same(spark):
    source, cache = make(spark, [("A", "u", "2026-03-10")]), engine.Cache(2)
    ask = lambda version: engine.run({"kind": "TrendsQuery", "series": [{"event": "A"}]}, source, NOW, "p", version, cache=cache)["meta"]["cached"]
    assert [ask("1"), ask("1"), ask("2")] == [False, True, False]
    cache.put("k", 1, True, 0.0)
    assert (cache.get("k", 29.0), cache.get("k", 31.0)) == (1, None)
    assert engine.reads_persons({"series": [{"properties": [{"type": "person"}]}]}) and not engine.reads_persons({"series": []})


def test_demo_is_the_same_every_time(spark):
    a, b = (demo.generate(spark, NOW, 50, 10).collect() for _ in range(2))
    assert a == b and len(a) > 100 and len({r["uuid"] for r in a}) == len(a)
    assert all(NOW - 11 * DAY < r["timestamp"].timestamp() * 1e6 < NOW for r in a)
    with pytest.raises(InvalidQuery):
        demo.generate(spark, NOW, 1_000_000)


def test_import_order(spark):
    exported = make(spark, [("A", "u", 5), ("B", "u", 3)]).events
    people = spark.createDataFrame([("u", '{"a":1}', ["x"])], "distinct_id string, properties string, other_ids array<string>")
    feed = capture.import_events(exported, people).orderBy("seq").collect()
    assert [r["event"] for r in feed] == ["$merge_dangerously", "$set", "B", "A"]
