"""Byte-level BPE over whole corpora, as rounds of merges on padded matrices.

The different words of a batch are sorted into matrices by length, one row of byte tokens per
word. Each round looks up the rank of every neighbouring pair in a hash table, merges each row's
pair of least rank, leftmost first, and compacts the rows; rows with no pair left are done.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the published pattern that splits text into words for this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_RANK = np.iinfo(np.int32).max
#: Cells of one matrix; words kept between batches.
CELLS, CACHED_WORDS = 2_000_000, 200_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Merges(NamedTuple):
    """byte_ids: token of each byte. keys, ranks: the hash table of pairs. merged: token made by
    each rank. probes: longest search in the table. whole: equal pairs of a row may merge at once."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    probes: int
    whole: bool


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    bits = size.bit_length() - 1
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def load(path: str = VOCABULARY) -> Merges:
    """Read a byte-level BPE vocabulary (JSON with vocab and merges)."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
    merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
    size = 1 << (4 * len(pairs) - 1).bit_length()
    keys, ranks = np.full(size, -1, dtype=np.int64), np.full(size, NO_RANK, dtype=np.int32)
    wanted = left << 32 | right
    rest, at, probes = np.arange(len(pairs)), _slots(wanted, size), 0
    while len(rest):
        probes += 1
        free = keys[at] < 0
        _, firsts = np.unique(at, return_index=True)
        first = np.zeros(len(rest), dtype=bool)
        first[firsts] = True
        takes = free & first
        keys[at[takes]], ranks[at[takes]] = wanted[rest[takes]], rest[takes]
        rest, at = rest[~takes], (at[~takes] + 1) & (size - 1)
    # A pair merged all along a row at once gives what one merge after the other gives, if no
    # pair with the new token comes before the pair that makes it.
    made = np.full(max(vocabulary.values()) + 1, -1, dtype=np.int64)
    made[merged] = np.arange(len(pairs))
    order = np.arange(len(pairs))
    whole = bool((made[left] < order).all() and (made[right] < order).all() and len(np.unique(merged)) == len(merged))
    byte_ids = np.array([vocabulary[c] for c in _byte_letters()], dtype=np.int32)
    return Merges(byte_ids, keys, ranks, merged, probes, whole)


def pair_ranks(merges: Merges, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair of tokens; NO_RANK where there is none."""
    wanted = left.astype(np.int64) << 32 | right
    at = _slots(wanted, len(merges.keys))
    found = np.where(merges.keys[at] == wanted, merges.ranks[at], NO_RANK)
    open_ = np.flatnonzero((merges.keys[at] != wanted) & (merges.keys[at] >= 0))
    for _ in range(merges.probes - 1):
        if not len(open_):
            break
        at_open = (at[open_] + 1) & (len(merges.keys) - 1)
        at[open_] = at_open
        held = merges.keys[at_open]
        hit = held == wanted[open_]
        found[open_[hit]] = merges.ranks[at_open[hit]]
        open_ = open_[~hit & (held >= 0)]
    return found


def merge_matrix(merges: Merges, tokens: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The tokens of each row after all merges; rows are padded with -1."""
    done: list[np.ndarray | None] = [None] * len(tokens)
    rows = np.arange(len(tokens))
    while len(rows):
        width = tokens.shape[1]
        ranks = np.full((len(rows), max(1, width - 1)), NO_RANK, dtype=np.int32)
        if width > 1:
            r, c = np.nonzero(tokens[:, 1:] >= 0)
            ranks[r, c] = pair_ranks(merges, tokens[r, c], tokens[r, c + 1])
        least = ranks.min(axis=1)
        finished = least == NO_RANK
        for i in np.flatnonzero(finished):
            done[rows[i]] = tokens[i, : lengths[i]]
        if finished.all():
            break
        on = ~finished
        rows, tokens, lengths, ranks, least = rows[on], tokens[on], lengths[on], ranks[on], least[on]
        columns = np.arange(ranks.shape[1])
        if merges.whole:
            equal = ranks == least[:, None]
            starts = equal.copy()
            starts[:, 1:] &= ~equal[:, :-1]
            run_start = np.maximum.accumulate(np.where(starts, columns, 0), axis=1)
            chosen = equal & ((columns - run_start) % 2 == 0)
        else:
            chosen = columns == ranks.argmin(axis=1)[:, None]
        r, c = np.nonzero(chosen)
        tokens[r, c] = merges.merged[least[r]]
        tokens[r, c + 1] = -1
        kept = tokens >= 0
        lengths = kept.sum(axis=1)
        compact = np.full((len(rows), int(lengths.max())), -1, dtype=np.int32)
        compact[np.arange(compact.shape[1]) < lengths[:, None]] = tokens[kept]
        tokens = compact
    return done  # type: ignore[return-value]


def encode_words(merges: Merges, words: list[bytes]) -> list[np.ndarray]:
    """Token ids of each word, by matrices of words of similar length."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
    at = int(np.searchsorted(lengths[order], 1))
    while at < len(order):
        shortest = int(lengths[order[at]])
        end = int(np.searchsorted(lengths[order], shortest + shortest // 4 + 1))
        end = min(end, at + max(1, CELLS // (shortest + shortest // 4)))
        chosen = order[at:end]
        own = lengths[chosen]
        tokens = np.full((len(chosen), int(own.max())), -1, dtype=np.int32)
        tokens[np.arange(tokens.shape[1]) < own[:, None]] = merges.byte_ids[np.frombuffer(b"".join(words[i] for i in chosen), dtype=np.uint8)]
        for i, ids in zip(chosen.tolist(), merge_matrix(merges, tokens, own)):
            out[i] = ids
        at = end
    return out


class Encoder:
    """Encodes texts of one worker; words met before are looked up."""

    def __init__(self, merges: Merges, pattern: str = WORDS) -> None:
        self.merges, self.find, self.known = merges, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for an empty or null text. No special tokens."""
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        for word, ids in zip(new, encode_words(self.merges, [w.encode() for w in new])):
            known[word] = ids.tolist()
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]


def _pieces(batches: Iterable[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many characters, so that long texts don't pile up."""
    for batch in batches:
        sizes = batch.column(batch.num_columns - 1)
        start, held = 0, 0
        lengths = [len(x) if x is not None else 0 for x in sizes.to_pylist()]
        for i, n in enumerate(lengths):
            held += n
            if held >= chars:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """Columns key, ids (array<int>) of each row; with `count_only` key, n_tokens (long).

    Every row is encoded whole. Text that looks like a special token is ordinary text; an empty or
    null text has no ids. Rows are independent: a scan with enough parts isn't shuffled. The
    vocabulary (50,257 tokens, about 2 MB of tables) is read once and sent to the executors.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(load(path)))
    kind = "long" if count_only else "array<int>"
    column = "n_tokens" if count_only else "ids"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(*shared.value))
        for piece in _pieces(batches):
            encoded = encoder.encode(piece.column(1).to_pylist())
            sizes = np.array([len(ids) for ids in encoded], dtype=np.int64)
            if count_only:
                values = pa.array(sizes)
            else:
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(encoded), dtype=np.int32, count=int(sizes.sum()))
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([piece.column(0), values], names=["key", column])

    chosen = spread(df.select(df[key].alias("key"), df[text].cast("string").alias("text")), "key")
    schema = f"key {df.schema[key].dataType.simpleString()}, {column} {kind}"
    return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)
