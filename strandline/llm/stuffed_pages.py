"""Pages made of keywords, links or tags instead of sentences.

Two kinds of evidence, and a page needs both. List density: the share of its words that stand in
lists of links, tags, goods or strung-together words, or in words that keep repeating themselves,
punctuated or not. Replication: the share of its lists' phrases that lists of other hosts carry too,
or that the page itself says over and over.

A phrase is two words. Keywords are combined anew on every page, so that of the pages to be found
hardly one has longer phrases in common with another; what hosts share in long phrases is prose.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize, spread

#: Texts whose phrases are hashed and sorted together.
BATCH = 500
PHRASE_WORDS = 2
#: A phrase is replicated if lists of so many hosts carry it, and as many pages in lists as in prose,
MIN_HOSTS = 2
#: or if it comes so often in the lists of one page.
MIN_TIMES = 3
#: Share of the words that must stand in lists, and of the lists' phrases that must be replicated.
MIN_SHARE = 0.5
#: Words looked at together in a sentence, and the share of different ones that prose exceeds there.
PIECE_WORDS = 20
PROSE_VARIETY = 0.75

INVISIBLE = regex.compile(r"\p{Cf}|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
ANCHOR = re.compile(r"(?is)<a\s[^>]*>(.*?)</a>")
BREAK = re.compile(r"(?i)</?(?:li|ul|ol|br|p|div|tr|h\d)\b[^>]*>")
MARKDOWN_LINK = re.compile(r"\[([^\]\n]*)\]\((\S+?)\)")
URL = regex.compile(r"(?im)(?:https?://|www\.)\S+|(?<![\w@./-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/[^\s|,;)]*|(?<=[»→>=:|-]\s)[a-z0-9-]+\.[a-z]{2,}(?=\s*$)")
DIGITS = re.compile(r"\d+")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
DOMAIN = re.compile(r"\.[A-Za-z]{2}")
TAGS = re.compile(r"<[^<>\n]{1,200}>")
LINK = "\ue000"
#: Letters of a word with the same mark between them.
SPACED_OUT = re.compile(r"(?<!\S)[^\w\s]?[^\W\d_]([.*·_~-])[^\W\d_](?:\1[^\W\d_])+[^\w\s]?(?!\S)")
MARKS = re.compile(r"[^\w\ue000]+|_+")
#: Stripped first because it is quicker than the pattern, which strips all the rest.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»…–—。、！？"
AROUND = re.compile(r"^(?:\W|_)+|(?:\W|_)+$")
TECHNICAL = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:|[{}]|\w\(|\w=\w|^\s*\|.*\|\s*$|;\s*$|^\s*(?:SELECT|FROM|WHERE|GROUP BY|WITH)\b")
PRICE = regex.compile(r"\d[\d.,]*\s?(?:\p{Sc}|\p{Lu}{3})(?!\w)|\p{Sc}\s?\d")
ENDS = re.compile(r"[.!?…。！？](?=\s|$|[^\s\d])|[.!?…。！？]$")
SENTENCE_END = re.compile(r"[.!?…。！？:][\"')\]]*\s*$")
LAST_WORD = re.compile(r"^[^.!?…。！？]*[.!?…。！？]+[\"')\]]*$")
#: What may separate a line's items, and whether many short items so separated are a list for certain.
SEPARATORS = [(re.compile(p), strong) for p, strong in ((r"\s*[·•|;]\s*", True), (r"\s+[/*»–-]\s+", True), (r"\s*[,、]\s*", True), (r"[.。]\s+", False))]
LIST_MARKS = re.compile(r"[\s,;|·•/]+")
MANY_ITEMS = 12
TAG = regex.compile(r"^[#@]\p{L}[\p{L}\p{N}_-]*$")
LETTERS = regex.compile(r"^[\p{L}\p{M}][\p{L}\p{M}'’-]*$")
STRUNG = regex.compile(r"^[#@]?[\p{L}\p{M}]+(?:[-_][\p{L}\p{M}]+)*$")
LABEL = regex.compile(r"^\s*\p{L}[\p{L} ]{0,20}(?::\s+|=)")
#: What separates tokens besides space, and what does only within a word.
BETWEEN, JOINED = ";|·•", re.compile(r"[,、#@](?=\S)")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")


class Stretch(NamedTuple):
    """Words of neighbouring lines, all in lists or all in prose; whether each is a phrase alone."""

    listed: bool
    single: bool
    words: list[str]


class Evidence(NamedTuple):
    """Words of a text, those in its lists, and its stretches of lists and prose."""

    words: int
    listed: int
    stretches: list[Stretch]


class Line(NamedTuple):
    tokens: list[str]
    weight: int
    kind: str  # list, tags, link, items, goods, plain, technical, sentence, blank


def weight(token: str) -> int:
    """Words in a token: one, or about one for each two letters of a script without spaces."""
    if token.isascii():
        return 1
    n = len(UNSPACED.findall(token))
    return max(1, (n + 1) // 2)


def _is_goods(part: str) -> bool:
    return bool(PRICE.search(part)) and len(part.split()) <= 12


def _is_item(part: str) -> bool:
    tokens = part.split()
    limit = 6 if len(tokens) < 2 or len(tokens) > 6 or part.isascii() else 12
    return _is_goods(part) or (0 < sum(map(weight, tokens)) <= limit and not regex.search(r"[=(){}]", part))


def classify(line: str) -> Line:
    """A line's tokens and what it looks like on its own."""
    spaced = line
    for mark in BETWEEN:
        spaced = spaced.replace(mark, " ")
    tokens = JOINED.sub(" ", spaced).split()
    if not tokens:
        return Line(tokens, 0, "blank")
    size = sum(map(weight, tokens)) if not line.isascii() and UNSPACED.search(line) else len(tokens)
    links, ends = tokens.count(LINK), len(ENDS.findall(line))
    if links and size - 2 * links <= 5 * links and not (ends and ENDS.search(line.replace(LINK, ""))):
        return Line(tokens, size, "list" if links >= 3 else "link")
    unlabelled = LABEL.sub("", line)
    if "#" in line or "@" in line:
        bare = [t for t in LIST_MARKS.split(unlabelled) if t]
        if len(bare) >= 5 and sum(bool(TAG.match(t)) for t in bare) >= 0.6 * len(bare):
            return Line(tokens, size, "tags")
    if ends and size >= 7 * ends and SENTENCE_END.search(line):
        return Line(tokens, size, "sentence")
    if TECHNICAL.search(unlabelled) and line.count(";") < 5:
        return Line(tokens, size, "technical")
    joined = [p for p in LIST_MARKS.split(unlabelled) if p]
    if len(joined) >= 8 and ends <= 1 and ("_" in line or "-" in line):
        if sum(bool(STRUNG.match(t)) and ("-" in t or "_" in t or len(t) >= 9 or weight(t) >= 3) for t in joined) >= 0.8 * len(joined):
            return Line(tokens, size, "tags")
    for separator, strong in SEPARATORS:
        parts = [p for p in separator.split(unlabelled) if p.strip()]
        if len(parts) >= 6:
            if sum(map(_is_goods, parts)) >= 0.6 * len(parts):
                return Line(tokens, size, "list")
            items = [p.split() for p in parts if _is_item(p)]
            letters = sum(bool(LETTERS.match(t)) for p in items for t in p)
            if len(items) >= 0.85 * len(parts) and letters >= 0.5 * sum(map(len, items)):
                return Line(tokens, size, "list" if strong and ends <= 1 and len(parts) >= MANY_ITEMS else "items")
    if _is_goods(line):
        return Line(tokens, size, "goods")
    if ends > size / 30 or SENTENCE_END.search(line):
        return Line(tokens, size, "sentence")
    return Line(tokens, size, "plain")


def repeats_itself(tokens: list[str]) -> bool:
    """Far fewer different words than prose of that length has, and most of them more than once."""
    n = len(tokens)
    if n < 20 or len(set(tokens)) > 5 * n**0.5:
        return False
    return sum(c for c in Counter(tokens).values() if c > 1) >= 0.75 * n


def keyword_sentences(lines: list[Line], words: list[str]) -> bool:
    """Whether lines with end marks, of these words, are keywords with marks put between them.

    Copies of a sentence and sentences of one pattern also repeat themselves over a page; prose
    doesn't within a sentence. Sentences without that are keywords only if different ones are made
    of very few words in ever new order, numbers apart: in a pattern a word has few successors.
    """
    if not repeats_itself(words):
        return False
    pieces: list[list[str]] = [[]]
    for line in lines:
        for token in line.tokens:
            pieces[-1].append(token)
            if len(pieces[-1]) == PIECE_WORDS or LAST_WORD.search(token):
                pieces.append([])
        pieces.append([])
    found = [normal_words(piece) for piece in pieces]
    if sum(len(set(piece)) for piece in found) <= PROSE_VARIETY * len(words):
        return True
    different = {tuple(DIGITS.sub("0", w) for w in piece) for piece in found}
    n, vocabulary = sum(map(len, different)), len({w for piece in different for w in piece})
    pairs = {pair for piece in different for pair in pairwise(piece)}
    return n >= PIECE_WORDS and vocabulary <= 2 * n**0.5 and len(pairs) >= 3 * vocabulary


def keyword_lines(lines: list[Line], each: list[list[str]]) -> list[int]:
    """Which sentence lines, of the given words, are keywords: alone, or with others beside them."""
    found: list[int] = []
    for sentences, group in groupby(range(len(lines)), lambda i: lines[i].kind == "sentence"):
        if sentences:
            run = list(group)
            alone = [i for i in run if keyword_sentences([lines[i]], each[i])]
            rest = sorted(set(run).difference(alone))
            narrow = [i for i in rest if len(set(each[i])) <= PROSE_VARIETY * len(each[i]) and len(each[i]) <= PIECE_WORDS]
            pooled = next((p for p in (rest, narrow) if len(p) > 1 and keyword_sentences([lines[i] for i in p], [w for i in p for w in each[i]])), [])
            found += alone + pooled
    return found


def _bare(word: str) -> str:
    word = word.strip(PUNCTUATION)
    return word if not word or word[0].isalnum() and word[-1].isalnum() else AROUND.sub("", word)


def normal_words(tokens: Iterable[str]) -> list[str]:
    """The words in small letters, without marks around them."""
    return [w for w in (t if t.isalpha() else _bare(t) for t in " ".join(tokens).casefold().split()) if w]


def prepare(text: str) -> str:
    """Visible characters in their plain form; a link is its text and one LINK mark."""
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii() or CONTROL.search(text):
        text = INVISIBLE.sub("", text)
    if "<" in text:
        text = ANCHOR.sub(lambda m: f" {m[1]} {LINK} ", text)
        text = TAGS.sub(" ", BREAK.sub("\n", text))
    if "](" in text:
        text = MARKDOWN_LINK.sub(lambda m: f" {m[1]} {LINK} ", text)
    if "://" in text or DOMAIN.search(text):
        text = URL.sub(f" {LINK} ", text)
    return SPACED_OUT.sub(lambda m: m[0].replace(m[1], ""), text)


def is_list(run: list[Line]) -> tuple[bool, bool]:
    """Whether neighbouring lines without sentences may be a list, and whether they are for certain."""
    links = sum(line.tokens.count(LINK) for line in run)
    goods = sum(line.kind == "goods" for line in run)
    if links >= 3 and 3 * links >= len(run) or goods >= 3 and goods >= 0.6 * len(run):
        return True, True
    if repeats_itself(normal_words(t for line in run for t in line.tokens if t != LINK)):
        return True, True
    short = sum(line.weight <= 7 for line in run)
    return short >= 6 or any(line.kind == "items" for line in run), False


def list_lines(lines: list[Line], each: list[list[str]]) -> list[bool]:
    """Which lines, of the given words, stand in lists."""
    listed = [line.kind in ("list", "tags") for line in lines]
    runs: list[list[int]] = []
    for i, line in enumerate(lines):
        if line.kind in ("link", "items", "goods", "plain"):
            if runs and all(listed[k] for k in range(runs[-1][-1] + 1, i)):
                runs[-1].append(i)
            else:
                runs.append([i])
    # a list that a sentence interrupts is judged as a whole, if its pieces are long enough
    pooled = [i for run in runs if len(run) >= 4 for i in run]
    whole = bool(pooled) and is_list([lines[i] for i in pooled])[1]
    for run in runs:
        found = is_list([lines[i] for i in run])[0] or (len(run) >= 4 and whole)
        for i in run:
            listed[i] = found
    for i in keyword_lines(lines, each):
        listed[i] = True
    return listed


def phrase_words(tokens: Iterable[str]) -> list[str]:
    """The words as they count in phrases: without marks in them, all numbers alike."""
    return [w for w in (t if t.isalpha() else DIGITS.sub("0", MARKS.sub("", t)) for t in " ".join(tokens).casefold().split()) if w]


def examine(text: str | None) -> Evidence:
    """The evidence within one text, however long. A null or blank text has no words."""
    lines = [line for line in map(classify, prepare(text or "").splitlines()) if line.kind != "blank"]
    listed = list_lines(lines, [normal_words(line.tokens) for line in lines])
    stretches: list[Stretch] = []
    for line, found in zip(lines, listed):
        words, single = phrase_words(line.tokens), found and line.kind == "tags"
        if stretches and stretches[-1][:2] == (found, single) and found:
            stretches[-1].words.extend(words)
        else:
            stretches.append(Stretch(found, single, words))
    return Evidence(sum(line.weight for line in lines), sum(line.weight for line, found in zip(lines, listed) if found), stretches)


def phrase_arrays(found: list[Evidence]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text (of at most BATCH) the 64-bit hashes of the different phrases of its lists, how often each comes,
    and those of its prose. A phrase is PHRASE_WORDS consecutive words of a stretch, or one tag."""
    stretches = [(i, s) for i, e in enumerate(found) for s in e.stretches if s.words]
    each = np.array([xxhash.xxh64_intdigest(w) for _, s in stretches for w in s.words], dtype=np.uint64)
    lengths = np.array([len(s.words) for _, s in stretches], dtype=np.int64)

    def by_word(values: list, kind: type) -> np.ndarray:
        return np.repeat(np.array(values, dtype=kind), lengths)

    at = by_word(range(len(stretches)), np.int64)
    n = max(0, len(each) - PHRASE_WORDS + 1)
    hashed = np.zeros(n, np.uint64)
    for k in range(PHRASE_WORDS):
        hashed = hashed * np.uint64(0x100000001B3) + each[k : k + n]
    owner, listed, single = (by_word(v, t) for v, t in (([i for i, _ in stretches], np.int64), ([s.listed for _, s in stretches], bool), ([s.single for _, s in stretches], bool)))
    joined = np.flatnonzero((at[:n] == at[len(each) - n :]) & ~single[:n])
    alone = np.flatnonzero(single)
    hashed = np.concatenate((hashed[joined], each[alone])).view(np.int64)
    place = np.concatenate((joined, alone))

    def lists(of: np.ndarray) -> tuple[pa.Array, pa.Array]:
        of = of[np.argsort(hashed[of], kind="stable")]
        of = of[np.argsort(owner[place[of]].astype(np.int16), kind="stable")]
        who, what = owner[place[of]], hashed[of]
        first = np.flatnonzero(np.concatenate(([len(of) > 0], (who[1:] != who[:-1]) | (what[1:] != what[:-1]))))
        ends = np.searchsorted(who[first], np.arange(len(found) + 1)).astype(np.int32)
        times = np.diff(np.concatenate((first, [len(of)]))).astype(np.int32)
        return tuple(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values in (what[first], times))

    in_lists = listed[place]
    phrases, times = lists(np.flatnonzero(in_lists))
    return phrases, times, lists(np.flatnonzero(~in_lists))[0]


def evidence(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "site") -> DataFrame:
    """One row per document: page (a number of its own), doc_id, host, words, listed, and its
    different phrases in lists (phrase, times) and in prose."""
    names = ["page", "doc_id", "host", "words", "listed", "phrase", "times", "prose"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                found = [examine(t) for t in piece.column(2).to_pylist()]
                numbers = pa.array(np.arange(page, page + piece.num_rows))
                page += piece.num_rows
                counts = (pa.array([e[i] for e in found], pa.int64()) for i in range(2))
                yield pa.RecordBatch.from_arrays([numbers, piece.column(0), piece.column(1), *counts, *phrase_arrays(found)], names=names)

    chosen = spread(documents.select(documents[key].alias("doc_id"), documents[host].alias("host"), documents[text].alias("text")), "doc_id")
    kind = documents.schema[key].dataType.simpleString()
    return chosen.mapInArrow(run, f"page long, doc_id {kind}, host string, words long, listed long, phrase array<long>, times array<int>, prose array<long>")


def list_phrases(pages: DataFrame, min_hosts: int) -> DataFrame:
    """Column shared: the phrases that lists of `min_hosts` hosts carry, and at least as many pages
    in lists as in prose.

    A page sends each of its phrases once. They are counted per phrase and host, prose without a
    host, before and after the shuffle; so a phrase that a third of all pages carry stays small.
    The second condition keeps its meaning in a corpus so large that any phrase is on many hosts.
    """
    host = F.when(F.col("host").isNotNull(), F.xxhash64("host"))
    listed = pages.select(host.alias("h"), F.lit(1).alias("sign"), F.explode("phrase").alias("shared"))
    prose = pages.select(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("sign"), F.explode("prose").alias("shared"))
    counted = listed.unionByName(prose).groupBy("shared", "h").agg(F.sum("sign").alias("surplus"))
    found = counted.groupBy("shared").agg(F.count("h").alias("hosts"), F.sum("surplus").alias("surplus"))
    return found.where((F.col("hosts") >= min_hosts) & (F.col("surplus") >= 0)).select("shared")


def stuffed_pages(documents: DataFrame, min_hosts: int = MIN_HOSTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Columns doc_id, words, list_share, replicated_share, stuffed: one row per document.

    list_share: words of the page that stand in lists. replicated_share: phrases of these lists, each
    as often as it comes, that are replicated: lists of `min_hosts` hosts carry it, or it comes
    MIN_TIMES times in the page's own. stuffed: both are above `min_share`. Whole texts are
    read and every phrase of every document is counted. Phrases and hosts are compared by 64-bit
    hashes. A null host is no host; rows with the same or a null doc_id are documents of
    their own. Texts without words, or without lists, are not stuffed.
    """
    pages = materialize(evidence(documents))
    own = pages.select("page", F.explode(F.arrays_zip("phrase", "times")).alias("p")).select("page", "p.phrase", "p.times")
    joined = own.join(list_phrases(pages, min_hosts), F.col("phrase") == F.col("shared"), "left")
    replicated = F.when(F.col("shared").isNotNull() | (F.col("times") >= MIN_TIMES), F.col("times")).otherwise(0)
    shares = joined.groupBy(F.col("page").alias("of_page")).agg((F.sum(replicated) / F.sum("times")).alias("share"))
    found = pages.select("page", "doc_id", "words", "listed").join(shares, F.col("page") == F.col("of_page"), "left")
    listed = F.when(F.col("words") > 0, F.col("listed") / F.col("words")).otherwise(0.0)
    share = F.coalesce("share", F.lit(0.0))
    return found.select("doc_id", "words", listed.alias("list_share"), share.alias("replicated_share"), ((listed > min_share) & (share > min_share)).alias("stuffed"))
