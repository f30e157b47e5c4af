import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing, stuffed_pages, tokenizer

# ---- tokenizer


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(tokenizer.VOCABULARY)
    model.encode_special_tokens = True
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    random.seed(7)
    pick = lambda: chr(random.choice([random.randrange(32, 127), random.randrange(0x80, 0x2FF), random.randrange(0x3040, 0x30FF), random.randrange(0x1F300, 0x1F600)]))
    made = ["".join(pick() for _ in range(random.randrange(80))) for _ in range(200)]
    return made + ["", " ", "\n\n  x  \t", "<|endoftext|> is text", "a" * 5001, "ab" * 3000, "é" * 999, "don't we'll I'M", "x" + " " * 3000 + "y", "漢字" * 1500, "\x00​﻿", "1234567890" * 50]


def test_ids_equal_those_of_the_library(library):
    texts = odd_texts()
    assert tokenizer.Encoder(tokenizer.load()).encode(texts) == library(texts)


def test_one_merge_at_a_time_gives_the_same():
    merges = tokenizer.load()
    words = [w.encode() for w in ("aaaaaaa", "hello", "Tokenisierung", "ababababa", "ééééé", "x")]
    whole = [t.tolist() for t in tokenizer.encode_words(merges, words)]
    assert whole == [t.tolist() for t in tokenizer.encode_words(merges._replace(whole=False), words)]


def test_rows_with_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hello world", 9), (3, "Hello world", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    found = sorted((str(r["doc_id"]), r["ids"]) for r in tokenizer.encode(df).collect())
    assert found == [("1", []), ("2", []), ("3", [15496, 995]), ("3", [15496, 995]), ("None", [87])]
    assert {r["doc_id"]: r["n_tokens"] for r in tokenizer.encode(df, count_only=True).collect()} == {1: 0, 2: 0, 3: 2, None: 1}
    assert tokenizer.encode(df.limit(0)).count() == 0


def test_long_texts_are_encoded_in_pieces_of_rows(spark, library):
    texts = ["word " * n for n in (300_000, 5, 450_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["ids"] for r in tokenizer.encode(df).orderBy("doc_id").collect()] == library(texts)


# ---- mixing

TARGET = "mix_name string, source string, target_share double, max_repeats int, size_ratio double"


def sizes(spark, data):
    return spark.createDataFrame(data, "doc_id long, source string, n_tokens long, b int, before string")


def test_shares_repeats_and_short_sources(spark):
    random.seed(8)
    data = [(i, "big" if i % 10 else "small", random.randrange(1, 100), 0, "") for i in range(2000)] + [(9001, "big", 0, 0, ""), (9002, "big", None, 0, ""), (9003, None, 50, 0, "")]
    targets = spark.createDataFrame([("m", "big", 0.6, 1, 0.5), ("m", "small", 0.3, 4, 0.5), ("m", "none", 0.1, 3, 0.5), ("short", "small", 1.0, 2, 1.0)], TARGET)
    docs = sizes(spark, data)
    total = sum(d[2] or 0 for d in data)
    mixed = mixing.mix(docs, targets)
    report = {(r["mix_name"], r["source"]): r for r in mixing.shares(docs, targets, mixed).collect()}
    assert abs(report["m", "big"]["actual_tokens"] - 0.3 * total) <= 50
    assert abs(report["m", "small"]["actual_tokens"] - 0.15 * total) <= 50
    assert report["m", "none"]["actual_tokens"] == 0
    small = sum(d[2] for d in data if d[1] == "small")
    assert report["short", "small"]["actual_tokens"] == 2 * small and report["short", "small"]["most_repeats"] == 2
    assert report["m", "small"]["most_repeats"] <= 4
    assert abs(report["m", "big"]["actual_share"] - 0.6 / 0.9) < 0.01
    rows = mixed.where("mix_name = 'm'").collect()
    assert len({(r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert [tuple(r) for r in mixing.mix(docs, targets).where("mix_name = 'm'").collect()] == [tuple(r) for r in rows]


def test_weights_change_over_training_but_not_in_total(spark):
    data = [(i, "short", 5, 0, "") for i in range(3000)] + [(10_000 + i, "long", 50, 0, "") for i in range(300)]
    targets = spark.createDataFrame([("m", "short", 0.5, 1, 1.0), ("m", "long", 0.5, 1, 1.0)], TARGET)
    early = {}
    for ramp in (0.0, 1.0):
        rows = mixing.mix(sizes(spark, data), targets, ramp).collect()
        half = [r for r in rows if r["position"] < 0.5]
        early[ramp] = sum(r["n_tokens"] for r in half if r["source"] == "long") / sum(r["n_tokens"] for r in half)
        assert sum(r["n_tokens"] for r in rows) == 30_000
    # weight of the long ones rises from 0.25 to 0.75: 0.375 in the first half
    assert abs(early[0.0] - 0.5) < 0.01 and abs(early[1.0] - 0.375) < 0.01


def test_due_inverts_any_piecewise_linear_schedule(spark):
    knots = [(0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0)]
    times = [i / 200 for i in range(201)]

    def weight(t):
        for (a, u), (b, v) in zip(knots, knots[1:]):
            if t <= b:
                return u + (v - u) * (t - a) / (b - a)

    def area(t, n=2000):
        return sum((weight(t * i / n) + weight(t * (i + 1) / n)) / 2 * t / n for i in range(n))

    total = area(1.0)
    df = spark.createDataFrame([(t, area(t) / total) for t in times[1:-1:10]], "t double, share double")
    schedule = mixing.segments([(F.lit(a), F.lit(w)) for a, w in knots])
    for r in df.select("t", mixing.due(schedule, F.col("share")).alias("found")).collect():
        assert abs(r["t"] - r["found"]) < 1e-3


def test_empty_tables(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], TARGET)
    assert mixing.mix(sizes(spark, []), targets).count() == 0
    assert mixing.mix(sizes(spark, [(1, "a", 5, 0, "")]), targets.limit(0)).count() == 0
    assert mixing.shares(sizes(spark, []), targets, mixing.mix(sizes(spark, []), targets)).first()["actual_share"] == 0


# ---- stuffed pages

PROSE = "Before the release we looked at every session and found that most of them ended early, which surprised nobody. "
KEYWORDS = ["cheap batch", "buy funnel", "top session", "free export", "best alert"]
STUFFED = {
    "keyword and site": "\n".join(f"{KEYWORDS[i % 5]} » velmor{i}.example" for i in range(12)),
    "unspaced sentences": " ".join(f"{a} {b} Saint-Orve {i}." for i, (a, b) in enumerate(zip(["最安", "無料", "比較"] * 8, ["ダッシュボード", "検索条件"] * 12))),
    "soup": " ".join(random.Random(1).choices("cheap batch buy funnel top session".split(), k=80)),
    "lines": "\n".join(KEYWORDS * 6),
    "dots": " · ".join(KEYWORDS * 5),
    "sentences of keywords": ". ".join(KEYWORDS * 6) + ".",
    "hidden": " ".join("c­h­e­a­p b​at​ch BUY Funnel".split() * 12),
    "urls": "\n".join(f"https://host{i}.example/page-{i}" for i in range(12)),
    "markdown": "\n".join(f"- [{KEYWORDS[i % 5]}](https://host{i}.example/a)" for i in range(12)),
    "anchors": "".join(f'<li><a href="https://h{i}.test/x">{KEYWORDS[i % 5]}</a></li>\n' for i in range(12)),
    "tags": "Tags: " + " ".join(f"#{k.replace(' ', '_')}{c}" for k in KEYWORDS for c in "abc"),
    "strung": ";".join(f"{k.replace(' ', '-')}{c}" for k in KEYWORDS for c in "abc"),
    "goods": " * ".join(f"Velmor {k} X{i}0 {i + 3}.99 EUR" for i, k in enumerate(KEYWORDS * 2)),
    "unspaced script": " ".join(random.Random(2).choices(["無料", "比較", "通販", "最安", "検索条件"], k=60)),
    "mostly": PROSE + "\n" + "\n".join(KEYWORDS * 8),
}
HONEST = {
    "prose": PROSE * 5,
    "quoted": ("> " + PROSE + "\n") * 4,
    "partly": PROSE * 6 + "\n" + "\n".join(KEYWORDS * 4),
    "sources": "\n".join(f"* {PROSE.strip()} (https://host{i}.example/x)" for i in range(5)),
    "table": "| event | people | share |\n|---|---|---|\n" + "\n".join(f"| sign_up | {i * 37} | {i}.5 % |" for i in range(20)),
    "log": "\n".join(f"2018-01-14T23:3{i}:00Z INFO publisher gen={i} rows={i * 7} lag_ms=80197" for i in range(9)),
    "code": "SELECT a, count(*) AS n\nFROM events\nWHERE name = 'x'\nGROUP BY a\n" * 6,
    "json": '{"kind":"funnel","steps":[{"event":"a"},{"event":"b"}]}\n' * 9,
    "glossary": "\n".join(f"{k}: {PROSE.strip()}" for k in KEYWORDS),
    "notes": "2.4.1\n" + "\n".join(f"- {PROSE.strip()}" for _ in range(6)),
    "one word": "ok",
    "blank": " \n\t ",
    "none": None,
}


@pytest.mark.parametrize("name", STUFFED)
def test_stuffed(name):
    e = stuffed_pages.examine(STUFFED[name])
    assert e.listed > 0.5 * e.words


@pytest.mark.parametrize("name", HONEST)
def test_honest(name):
    e = stuffed_pages.examine(HONEST[name])
    assert e.listed <= 0.5 * e.words


DOCUMENT = "doc_id long, text string, site string"


def flagged(spark, data, **how):
    df = spark.createDataFrame(data, DOCUMENT).withColumns({"words": F.lit("x"), "phrase": F.lit(1), "page": F.lit(2)})
    return stuffed_pages.stuffed_pages(df, **how)


def test_a_list_counts_if_other_hosts_have_its_phrases(spark):
    words = [f"w{a}{b}".translate(str.maketrans("0123456789", "ghijklmnop")) for a in "abcdefgh" for b in "abcdefghijkl"]
    lonely, shared = "\n".join(" ".join(words[i : i + 5]) for i in range(0, 60, 5)), "\n".join(" ".join(words[i : i + 5]) for i in range(30, 95, 5))
    data = [(1, lonely.replace("w", "q"), "h1"), (2, shared, "h1"), (3, shared, "h2"), (4, shared, None), (5, None, None), (6, "", "h"), (7, PROSE * 3, None), (7, shared, ""), (None, shared, "h1"), (None, lonely.replace("w", "z"), "h4")]
    rows = flagged(spark, data).collect()
    assert sorted((r["doc_id"] for r in rows if r["stuffed"]), key=str) == [2, 3, 4, 7, None] and len(rows) == 10
    found = {r["doc_id"]: r["replicated_share"] for r in rows}
    assert found[1] == 0.0 and found[2] == 1.0
    assert flagged(spark, data, min_hosts=10**9).where("stuffed").count() == 0
    assert flagged(spark, data[:2]).where("stuffed").count() == 0  # no other host
    assert flagged(spark, data).limit(0).count() == 0 and stuffed_pages.stuffed_pages(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_phrases_of_prose_are_no_evidence(spark):
    """Lists whose phrases more pages have in prose are not stuffed, however many hosts share them."""
    titles = ["the cohort is empty", "a funnel needs steps", "we export it daily", "people return each week", "charts load more slowly", "ask your admin first", "tables keep their order"]
    menu, prose = "\n".join(titles), " ".join(f"As a rule, {t}, which we wrote down for our colleagues." for t in titles)
    menus = [(i, menu, f"h{i}") for i in range(3)]
    assert stuffed_pages.examine(menu).listed == stuffed_pages.examine(menu).words
    assert flagged(spark, menus).where("stuffed").count() == 3
    assert flagged(spark, menus + [(10 + i, prose, f"h{i}") for i in range(4)]).where("stuffed").count() == 0


def test_planted_pages_are_found(spark):
    """Of pages written in seven ways over shared keywords, on 40 hosts, all are found; nothing else."""
    pick = random.Random(7)
    nouns = ["alert", "data export", "cohort", "path report", "survey", "trend line"]

    def pair():
        return f"{pick.choice(MODIFIERS)} {pick.choice(nouns)}"

    ways = [
        lambda: " ".join(pair() for _ in range(30)),
        lambda: " ".join(keyword_sentence(pick, pick.choice(nouns).capitalize()) for _ in range(12)),
        lambda: PROSE + "\n" + "; ".join(pair() for _ in range(25)),
        lambda: "\n".join(f"{pair()} » site{i}.test" for i in range(10)),
        lambda: "\n".join(f"https://a{pick.randrange(99)}.test/{pick.randrange(999)}" for _ in range(12)),
        lambda: " ".join("#" + pair().replace(" ", pick.choice(["", "_", "-"])) for _ in range(25)),
        lambda: "\n".join(f"Vel{pick.choice('abcdefgh')}mor {pair()} X{pick.randrange(999)} {pick.randrange(99)}.99 EUR" for _ in range(12)),
    ]
    planted = [(i, ways[i % 7](), f"h{i % 40}") for i in range(210)]
    honest = [(1000 + i, text, f"h{i % 40}") for i, text in enumerate([*HONEST.values(), *PUNCTUATED_PROSE.values()] * 8)]
    found = {r["doc_id"] for r in flagged(spark, planted + honest).where("stuffed").collect()}
    assert found == set(range(210))
    by_page_alone = flagged(spark, planted + honest, min_hosts=10**9).where("stuffed").count()
    assert by_page_alone < 160  # the hosts decide the others


def keyword_sentence(pick, word):
    return f"{word} {pick.choice(MODIFIERS)} {word.lower()}, {pick.choice(MODIFIERS)} {word.lower()} {pick.choice(MODIFIERS)} {word.lower()}{pick.choice('.!?')}"


MODIFIERS = "top cheap review buy best online free price".split()
PICK = random.Random(3)
PUNCTUATED = {
    "paragraph": " ".join(keyword_sentence(PICK, "Alert") for _ in range(30)),
    "a line each": "\n".join(keyword_sentence(PICK, "Alert") for _ in range(12)),
    "beside prose": PROSE + "\n" + " ".join(keyword_sentence(PICK, "Data export") for _ in range(12)),
    "lines around prose": "\n".join([keyword_sentence(PICK, "Alert") for _ in range(6)] + [PROSE] + [keyword_sentence(PICK, "Alert") for _ in range(6)]),
    "without repeats in a sentence": " ".join(" ".join(PICK.sample(MODIFIERS, 7)) + "." for _ in range(20)),
    "spelled with dots": " ".join(PICK.choices(["b.u.y", "d.e.v.i.c.e. .i.d", "device id", "CHEAP", "f.r.e.e", "review"], k=80)) + " top.",
}
PLACES = ["painel", "perfil", "funil", "filtro", "evento"]
PUNCTUATED_PROSE = {
    "one pattern": " ".join(f"De novo: quando o {PICK.choice(PLACES)} fica pendente, o sistema apaga o {PICK.choice(PLACES)} depois de {i} minutos, como na outra vez." for i in range(20)),
    "numbers alone differ": " ".join(f"The nightly job took {i} minutes and wrote {i * 7} rows again." for i in range(20)),
    "copies": "\n".join([PROSE.strip()] * 12),
    "partly keywords": PROSE * 6 + "\n" + " ".join(keyword_sentence(PICK, "Alert") for _ in range(5)),
}


@pytest.mark.parametrize("name", PUNCTUATED)
def test_keywords_with_end_marks_are_stuffed(name):
    e = stuffed_pages.examine(PUNCTUATED[name])
    assert e.listed > 0.5 * e.words


@pytest.mark.parametrize("name", PUNCTUATED_PROSE)
def test_sentences_of_one_pattern_are_prose(name):
    e = stuffed_pages.examine(PUNCTUATED_PROSE[name])
    assert e.listed <= 0.5 * e.words
