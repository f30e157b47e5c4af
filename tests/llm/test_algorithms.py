import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import bitmaps, subsequences
from strandline.session import scratch
from tests.llm.test_queries import grow

# ---- bitmaps


def counts(spark, data, sets):
    df = spark.createDataFrame(data, "day string, event string, id string, code long, word long, bits long, near string")
    return {tuple(r)[:3]: (r["n_distinct"], r["error_bound"]) for r in bitmaps.distinct_counts(df, "id", sets, "near").collect()}


def test_counts_with_nulls_ties_and_clashing_names(spark):
    row = lambda d, e, i: (d, e, i, 5, 6, 7, None)
    data = [row("1", "a", "x"), row("1", "a", "x"), row("1", None, "y"), row("2", "a", "y"), row("2", "a", None), row(None, "a", "")]
    found = counts(spark, data, {"day": ["day"], "both": ["day", "event"]})
    assert found == {("day", "1", None): (2, 0.0), ("day", "2", None): (1, 0.0), ("day", None, None): (1, 0.0), ("both", "1", "a"): (1, 0.0), ("both", "1", None): (1, 0.0), ("both", "2", "a"): (1, 0.0), ("both", None, "a"): (1, 0.0)}
    assert counts(spark, [], {"day": ["day"]}) == {}


def test_codes_are_dense_and_bitmaps_behave_like_sets(spark, rows):
    random.seed(5)
    data = [(random.choice("ab"), f"id{random.randrange(300)}") for _ in range(900)]
    df = spark.createDataFrame(data, "g string, id string")
    codes = bitmaps.dictionary(df, "id")
    assert sorted(r["code"] for r in codes.collect()) == list(range(len({i for _, i in data})))
    words = bitmaps.union(bitmaps.member_words(df, ["g"], "id", codes), ["g"])
    sets = {g: {i for h, i in data if h == g} for g in "ab"}
    assert {r["g"]: r["n_distinct"] for r in bitmaps.cardinality(words, ["g"]).collect()} == {g: len(s) for g, s in sets.items()}
    packed = bitmaps.pack(words, ["g"])
    assert packed.count() == 2
    assert rows(bitmaps.unpack(packed, ["g"]).select("g", "word", "bits")) == rows(words.select("g", "word", "bits"))
    sides = [words.where(F.col("g") == g).select(F.lit(1).alias("k"), "word", "bits") for g in "ab"]
    assert bitmaps.cardinality(bitmaps.intersect(*sides, ["k"]), ["k"]).first()["n_distinct"] == len(sets["a"] & sets["b"])
    assert bitmaps.cardinality(bitmaps.union(sides[0].unionByName(sides[1]), ["k"]), ["k"]).first()["n_distinct"] == len(sets["a"] | sets["b"])


def test_a_dictionary_that_grows_keeps_its_codes(spark):
    first = spark.createDataFrame([("b", "p"), ("a", "q"), (None, "p")], "id string, near string")
    more = spark.createDataFrame([("a", "p"), ("c", "p"), ("0", None)], "id string, near string")
    old = bitmaps.dictionary(first, "id", "near")
    new = bitmaps.dictionary(more, "id", "near", old)
    before, after = ({r["id"]: r["code"] for r in d.collect()} for d in (old, new))
    assert sorted(after.values()) == [0, 1, 2, 3] and before.items() <= after.items()
    assert bitmaps.dictionary(more.limit(0), "id", known=old).count() == 2
    assert bitmaps.dictionary(more, "id", known=old.limit(0)).count() == 3


def test_bitmaps_of_several_runs_are_combined(spark):
    random.seed(6)
    data = [[(random.choice(["1", "2", None]), random.choice([None, *(f"id{i}" for i in range(90 * (run + 1)))])) for _ in range(200)] for run in range(3)]
    store = bitmaps.BitmapStore(spark, scratch(spark), ["day"])
    with pytest.raises(ValueError):
        store.bitmaps()
    for run, part in enumerate(data):
        df = spark.createDataFrame(part, "day string, id string")
        store.add(df, "id", run)
        store.add(df, "id", run)  # tried again
    found = {r["day"]: r["n_distinct"] for r in bitmaps.cardinality(store.bitmaps(), ["day"]).collect()}
    assert found == {d: len({i for part in data for e, i in part if e == d and i}) for d in ("1", "2", None)}
    codes = [r["code"] for r in store._parts("dictionary").collect()]
    assert sorted(codes) == list(range(len({i for part in data for _, i in part if i})))


# ---- subsequences


def subsequence_set(items, length):
    return {c for k in range(1, length + 1) for c in combinations(items, k)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 3), st.integers(0, 14))
def test_reduction_keeps_every_short_subsequence(items, length, cut):
    old, subsequences.LONG = subsequences.LONG, 0
    try:
        whole = np.array(items, dtype=np.int32)
        short = subsequences.reduced(whole, length) if items else whole
        pieces = np.concatenate([subsequences.reduced(p, length) if len(p) else p for p in (whole[:cut], whole[cut:])])
    finally:
        subsequences.LONG = old
    assert subsequence_set(short.tolist(), length) == subsequence_set(items, length)
    assert subsequence_set(pieces.tolist(), length) == subsequence_set(items, length)


def test_a_long_sequence_becomes_short():
    rng = np.random.default_rng(0)
    assert len(subsequences.reduced(rng.integers(0, 40, 50_000).astype(np.int32), 5)) < 1500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70), min_size=1, max_size=9), min_size=1, max_size=12), st.integers(2, 4))
def test_mining_a_block_equals_plain_growth(sequences, threshold):
    block = subsequences.Block([np.array(s) for s in sequences])
    expected = grow(sequences, threshold, 4)
    assert dict(subsequences.mine(block, threshold, 4)) == expected
    assert dict(subsequences.count_patterns(block, sorted(expected))) == expected


@pytest.mark.parametrize("block", [10_000, 25])
def test_frequent_subsequences_in_one_block_and_in_many(spark, block):
    random.seed(6)
    people = {f"p{i}": [random.choice("aabbcdefgh") for _ in range(random.randrange(1, 10))] for i in range(150)}
    people["hot"] = [random.choice("abcdefgh") for _ in range(3000)]
    data = [(p, i // 2, f"{i:05d}", e, "x") for p, s in people.items() for i, e in enumerate(s)] + [(None, 1, "u", "a", "x"), ("p1", 1, "v", None, "x")]
    events = spark.createDataFrame(data, "entity string, at long, uuid string, name string, items string").repartition(5)
    found = {tuple(r["pattern"]): r["support"] for r in subsequences.frequent_subsequences(events, 12, block=block).collect()}
    expected = {p: n for p, n in grow(list(people.values()), 12, 5).items() if len(p) >= 3}
    assert found == expected and expected


def test_no_sequences(spark):
    events = spark.createDataFrame([], "entity string, at long, uuid string, name string")
    assert subsequences.frequent_subsequences(events, 1).count() == 0
    lonely = spark.createDataFrame([("a", None, None, "x")], "entity string, at long, uuid string, name string")
    assert subsequences.frequent_subsequences(lonely, 1).count() == 0
