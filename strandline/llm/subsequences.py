"""Frequent subsequences with gaps, by direct sequence comparison.

Blocks of whole sequences are mined in memory. Within a block the sequences that hold a prefix are
ordered by their minimum extension of it (their k-minimum subsequence with that prefix). Where the
first entry of that order equals the threshold-th, the pattern is frequent and its support is the
number of equal entries; where it doesn't, every pattern below the threshold-th entry is infrequent
and all sequences move on to at least that entry, without counting anything.

A pattern that is frequent in all sequences is frequent, at the same share, in some block. So the
blocks' patterns hold all results; those not found in every block are counted in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize

#: Sequences a block. Much smaller blocks find patterns that are frequent there only by chance.
BLOCK = 10_000
#: Shorter sequences are not worth reducing.
LONG = 48
#: Candidates counted in one pass, which every executor holds once; more are counted in several passes.
CANDIDATES_A_PASS = 500_000


def reduced(items: np.ndarray, length: int) -> np.ndarray:
    """The shortest form reached by dropping items that no subsequence of up to `length` needs.

    An item is dispensable if the fewest jumps (each to the next item of some kind) that reach it
    from the left and those from the right add up to more than length + 1. Dropping it keeps the
    set of subsequences of up to `length` items, and so does joining reduced pieces. The result's
    size depends on the number of different items, not on how long the sequence was.
    """
    if len(items) <= LONG:
        return items
    kinds, codes = np.unique(items, return_inverse=True)
    near = np.zeros(len(kinds), dtype=np.int32)
    left = np.empty(len(codes), dtype=np.int32)
    for i, a in enumerate(codes.tolist()):
        x = near[a] + 1
        left[i] = x
        np.minimum(near, x, out=near)
        near[a] = x
    near[:] = 0
    keep = np.ones(len(codes), dtype=bool)
    order, lefts = codes.tolist(), left.tolist()
    for i in range(len(order) - 1, -1, -1):
        a = order[i]
        y = int(near[a]) + 1
        if lefts[i] + y > length + 1:
            keep[i] = False
            continue
        np.minimum(near, y, out=near)
        near[a] = y
    return items[keep]


def sequence_parts(length: int):
    """For mapInPandas over rows (entity, item) in order: each entity's reduced items, as arrays."""

    def parts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, held = TaskContext.get().partitionId(), None, np.empty(0, np.int32)
        for frame in frames:
            if not len(frame):
                continue
            names, items = frame["entity"].to_numpy(), frame["item"].to_numpy(np.int32)
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            out: list[tuple] = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(names)]):
                if last is not None and names[start] != last:
                    out.append((last, part, reduced(held, length)))
                    held = np.empty(0, np.int32)
                last = names[start]
                held = np.concatenate((held, items[start:end])) if len(held) else items[start:end]
                if len(held) > 50 * LONG:
                    held = reduced(held, length)
            if out:
                yield pd.DataFrame(out, columns=["entity", "part", "items"])
        if last is not None:
            yield pd.DataFrame([(last, part, reduced(held, length))], columns=["entity", "part", "items"])

    return parts


class Block:
    """Sequences of one block, laid out flat: every position's following items as bits."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        self.size = len(sequences)
        flat = np.concatenate(sequences) if len(sequences) else np.empty(0, np.int64)
        self.kinds, codes = np.unique(flat, return_inverse=True)
        # one position before each sequence stands for the empty prefix
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        self.roots = begins
        owner = np.repeat(np.arange(self.size), lengths)
        where = np.arange(len(flat)) + owner + 1
        total = len(flat) + self.size
        self.sequence_of = np.repeat(np.arange(self.size), lengths + 1)
        words = max(1, (len(self.kinds) + 63) // 64)
        self.after = np.zeros((total, words), dtype=np.uint64)
        by_kind = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[by_kind], np.arange(len(self.kinds) + 1))
        self.places = []
        positions = np.arange(total)
        for kind in range(len(self.kinds)):
            at = by_kind[bounds[kind] : bounds[kind + 1]]
            self.places.append(where[at])
            last = np.full(self.size, -1, dtype=np.int64)
            last[owner[at]] = where[at]
            self.after[:, kind // 64] |= (positions < last[self.sequence_of]).astype(np.uint64) << np.uint64(kind % 64)

    def step(self, positions: np.ndarray, kind: int) -> np.ndarray:
        """The next place of `kind` after each position; it must exist."""
        places = self.places[kind]
        return places[np.searchsorted(places, positions, side="right")]


def _lowest(bits: np.ndarray) -> np.ndarray:
    """Lowest set bit of each row of words; rows must not be all zero."""
    one = np.uint64(1)
    found = np.zeros(len(bits), dtype=np.int64)
    open_ = np.ones(len(bits), dtype=bool)
    for w in range(bits.shape[1]):
        word = bits[:, w]
        hit = open_ & (word != 0)
        low = word & (~word + one)
        found = np.where(hit, 64 * w + np.bitwise_count(low - one), found)
        open_ &= ~hit
    return found


def _at_least(bits: np.ndarray, kind: int) -> np.ndarray:
    """`bits` without those below `kind`."""
    bits = bits.copy()
    w, b = divmod(kind, 64)
    bits[:, :w] = 0
    if w < bits.shape[1]:
        bits[:, w] &= ~np.uint64((1 << b) - 1)
    return bits


def mine(block: Block, threshold: int, longest: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Every pattern of up to `longest` items that at least `threshold` sequences hold, with their number."""

    def extend(prefix: tuple[int, ...], positions: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
        bits = block.after[positions]
        alive = bits.any(axis=1)
        bits, positions = bits[alive], positions[alive]
        minimum = _lowest(bits)
        while len(minimum) >= threshold:
            first, at_threshold = int(minimum.min()), int(np.partition(minimum, threshold - 1)[threshold - 1])
            if first == at_threshold:
                holders = minimum == first
                pattern = (*prefix, first)
                yield pattern, int(np.count_nonzero(holders))
                if len(pattern) < longest:
                    yield from extend(pattern, block.step(positions[holders], first))
                moving, bound = holders, first + 1
            else:
                moving, bound = minimum < at_threshold, at_threshold
            bits[moving] = _at_least(bits[moving], bound)
            left = bits[moving].any(axis=1)
            minimum[moving] = np.where(left, _lowest(bits[moving]), -1)
            stays = minimum >= 0
            if not left.all():
                bits, positions, minimum = bits[stays], positions[stays], minimum[stays]

    for pattern, support in extend((), block.roots):
        yield tuple(int(block.kinds[k]) for k in pattern), support


def count_patterns(block: Block, patterns: Iterable[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], int]]:
    """The number of the block's sequences that hold each of `patterns`, given in order."""
    code = {int(k): i for i, k in enumerate(block.kinds)}
    stack: list[tuple[int, np.ndarray]] = []
    for pattern in patterns:
        common = 0
        while common < min(len(stack), len(pattern)) and stack[common][0] == pattern[common]:
            common += 1
        del stack[common:]
        for item in pattern[common:]:
            positions = stack[-1][1] if stack else block.roots
            kind = code.get(item)
            if kind is None:
                stack.append((item, np.empty(0, np.int64)))
                continue
            has = (block.after[positions, kind // 64] >> np.uint64(kind % 64)) & np.uint64(1) == 1
            stack.append((item, block.step(positions[has], kind)))
        if len(stack[len(pattern) - 1][1]):
            yield pattern, len(stack[len(pattern) - 1][1])


def block_packer(longest: int):
    """For mapInPandas over the sequences of one block: the block as one row, its reduced sequences
    one after the other and where each ends."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [reduced(np.asarray(items, dtype=np.int32), longest) for frame in frames for items in frame["items"]]
        if rows:
            yield pd.DataFrame({"items": [np.concatenate(rows)], "ends": [np.cumsum([len(r) for r in rows]).astype(np.int32)]})

    return run


def _blocks(frames: Iterable[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    for frame in frames:
        for items, ends in zip(frame["items"], frame["ends"]):
            yield np.split(np.asarray(items, dtype=np.int64), ends[:-1])


def block_miner(threshold: int, total: int, shortest: int, longest: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(frames):
            local = max(1, -(-threshold * len(rows) // total))
            found = [([], len(rows))] + [(list(p), n) for p, n in mine(Block(rows), local, longest) if len(p) >= shortest]
            yield pd.DataFrame({"codes": [p for p, _ in found], "support": np.array([n for _, n in found], dtype=np.int64), "missed": np.int64(local - 1)})

    return run


def block_counter(patterns: Broadcast):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(frames):
            found = [(list(p), n) for p, n in count_patterns(Block(rows), patterns.value)]
            yield pd.DataFrame({"codes": [p for p, _ in found], "support": np.array([n for _, n in found], dtype=np.int64)})

    return run


def frequent_subsequences(events: DataFrame, threshold: int, shortest: int = 3, longest: int = 5, block: int = BLOCK) -> DataFrame:
    """Columns pattern (array of names), support: every list of `shortest` to `longest` names that
    at least `threshold` entities hold in order, gaps allowed, repeats allowed.

    `events`: entity, at, uuid, name. An entity's events are ordered by at, then uuid; rows with a
    null entity or name are no event, a null time comes first. Support is exact. The rows are
    sorted by range of (entity, at, uuid), so an entity with a third of all rows is spread over
    many tasks; each reduces its stretch to a bounded size (see `reduced`) and the stretches are
    joined afterwards. An empty table, or a threshold no name reaches, gives no rows.
    """
    known = materialize(events.where(F.col("entity").isNotNull() & F.col("name").isNotNull()).select("entity", "at", "uuid", "name"))
    holders = known.select("entity", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("holders"))
    # at most 100 / (threshold's per cent of entities) times the names an entity has on average
    names = sorted(r["name"] for r in holders.where(F.col("holders") >= threshold).select("name").collect())
    spark = events.sparkSession
    if not names:
        return spark.createDataFrame([], "pattern array<string>, support long")
    codes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, item int")
    coded = known.join(F.broadcast(codes) if len(names) <= 10_000 else codes, "name")
    in_order = coded.repartitionByRange("entity", "at", "uuid").sortWithinPartitions("entity", "at", "uuid")
    parts = materialize(in_order.select("entity", "item").mapInPandas(sequence_parts(longest), "entity string, part int, items array<int>"))
    total = parts.select("entity").distinct().count()
    n_blocks = -(-total // block)
    stretches = F.sort_array(F.collect_list(F.struct("part", "items")))
    sequences = parts.repartition(n_blocks, "entity").groupBy("entity").agg(F.flatten(stretches["items"]).alias("items")).select("items")
    blocks = sequences.mapInPandas(block_packer(longest), "items array<int>, ends array<int>")
    if n_blocks > 1:
        blocks = materialize(blocks)  # read once more by every pass
    mined = blocks.mapInPandas(block_miner(threshold, total, shortest, longest), "codes array<int>, support long, missed long")
    found = mined.groupBy("codes").agg(F.sum("support").alias("support"), F.count(F.lit(1)).alias("blocks"), F.sum("missed").alias("missed"))
    labels = F.array(*(F.lit(n) for n in names))
    named = lambda df: df.select(F.transform("codes", lambda c: F.get(labels, c)).alias("pattern"), "support")
    is_pattern, enough = F.size("codes") > 0, F.col("support") >= threshold
    if n_blocks == 1:
        return named(found.where(is_pattern & enough))
    found = materialize(found)
    # The row without codes tells the number of blocks, and how many sequences all of them together
    # could have left unreported of a pattern. One that can't reach the threshold is not counted.
    every = found.where(~is_pattern).first()
    complete = found.where(is_pattern & enough & (F.col("blocks") == every["blocks"])).select("codes", "support")
    reachable = F.col("support") + F.lit(every["missed"]) - F.col("missed") >= threshold
    open_ = found.where(is_pattern & (F.col("blocks") < every["blocks"]) & reachable).select("codes")
    candidates = iter(open_.orderBy("codes").toLocalIterator())
    results = [complete]
    while chunk := [tuple(r["codes"]) for _, r in zip(range(CANDIDATES_A_PASS), candidates)]:
        counted = blocks.mapInPandas(block_counter(spark.sparkContext.broadcast(chunk)), "codes array<int>, support long")
        results.append(counted.groupBy("codes").agg(F.sum("support").alias("support")).where(F.col("support") >= threshold))
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return named(whole)
