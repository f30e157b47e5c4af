"""Exact distinct counts by compressed bitmaps of dictionary-encoded identifiers.

A bitmap is a set of rows (group columns, word, bits): 64 consecutive codes per word, words
without members left out. That is the bucketed, compressed form a shuffle can combine: OR of any
bitmaps is bit_or per word, AND is a join of words with bitwise and, the count is the sum of
bit_count, and rows of different days or tables can be added up later. `pack` stores the words of
a bucket (1,024 words, 65,536 codes) as one row. All counts are exact: the error bound is zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.files import exists, names, remove, rename
from strandline.session import materialize

WORDS_A_BUCKET = 1024


def dictionary(ids: DataFrame, column: str, near: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Columns id, code: each different non-null value of `column` as a dense integer from 0.

    Ids are sorted by range, so no task sees them all, and numbered within their part; the parts'
    sizes (one row per partition) give where each part's codes begin. Ids of one `near` (their
    smallest) get neighbouring codes, so that a group of few ids has few words. The numbering is
    written down before it is used, because a code must not change when a lost task runs again.
    `known`: a dictionary made before. Its ids keep their codes and new ones follow after the
    highest, so bitmaps made with it can be combined with those made now.
    """
    wanted = ids.where(F.col(column).isNotNull()).select(F.col(column).alias("id"), (F.col(near) if near else F.lit(0)).alias("near"))
    distinct = wanted.groupBy("id").agg(F.min("near").alias("near"))
    base = 0
    if known is not None:
        base = known.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("n")).first()["n"]
        distinct = distinct.join(known.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti")
    placed = distinct.repartitionByRange("near", "id").sortWithinPartitions("near", "id")
    stored = materialize(placed.select("id", F.monotonically_increasing_id().alias("place")))
    part, rank = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size") + F.lit(base)).alias("start"))
    fresh = stored.withColumn("in_part", part).join(F.broadcast(starts), F.col("in_part") == F.col("part")).select("id", (F.col("start") + rank).alias("code"))
    return fresh if known is None else known.select("id", "code").unionByName(fresh)


def bits_of(codes: Column) -> tuple[Column, Column]:
    """The word of a code and its bit in it."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), codes.bitwiseAND(63).cast("int"))
    return F.shiftright(codes, 6), bit


def member_words(rows: DataFrame, groups: list[str], column: str, codes: DataFrame) -> DataFrame:
    """`groups`, word, bits: each different member of a group as a word with one bit.

    Repeated members are combined before the first shuffle, so an id with a third of all rows is
    joined to its code as one row per group. Null ids are members of nothing.
    """
    cells = rows.where(F.col(column).isNotNull()).select(*groups, F.col(column).alias("_id")).distinct()
    word, bit = bits_of(F.col("code"))
    return cells.join(codes, F.col("_id") == F.col("id")).select(*groups, word.alias("word"), bit.alias("bits"))


def union(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    """OR of all bitmaps of a group."""
    return bitmaps.groupBy(*groups, "word").agg(F.bit_or("bits").alias("bits"))


def intersect(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """AND of the two sides' bitmaps of the same group; nulls are equal."""
    other = right.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups), F.col("word") == F.col("_word"))
    both = left.join(other, same).withColumn("bits", F.col("bits").bitwiseAND(F.col("_bits")))
    return both.where("bits <> 0").select(*groups, "word", "bits")


def cardinality(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    """`groups`, n_distinct, error_bound (0): bits of each group's bitmap, one row per word."""
    return bitmaps.groupBy(*groups).agg(F.sum(F.bit_count("bits")).alias("n_distinct"), F.lit(0.0).alias("error_bound"))


def pack(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group and bucket of codes: the bucket's words that are not zero, in order."""
    entry = F.struct(F.col("word").bitwiseAND(WORDS_A_BUCKET - 1).cast("int").alias("word"), "bits")
    return bitmaps.groupBy(*groups, F.shiftright("word", 10).alias("bucket")).agg(F.sort_array(F.collect_list(entry)).alias("words"))


def unpack(packed: DataFrame, groups: list[str]) -> DataFrame:
    """The rows that `pack` packed."""
    rows = packed.select(*groups, "bucket", F.explode("words").alias("w"))
    return rows.select(*groups, (F.col("bucket") * WORDS_A_BUCKET + F.col("w.word")).alias("word"), "w.bits")


def distinct_counts(rows: DataFrame, column: str, sets: dict[str, list[str]], near: str | None = None) -> DataFrame:
    """Distinct ids per group for several sets of group columns, all from one pass.

    Columns: grouping (the set's name), every group column (null where it isn't in the set),
    n_distinct, error_bound. A null in a group column is a group of its own. Extra columns are
    ignored. An empty table gives no rows.
    """
    groups = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    words = member_words(rows, groups, column, dictionary(rows, column, near))
    numbered = words.groupingSets([[F.col(c) for c in [*columns, "word"]] for columns in sets.values()], *(F.col(c) for c in [*groups, "word"]))
    united = numbered.agg(F.bit_or("bits").alias("bits"), F.grouping_id().alias("gid"))
    gids = {name: sum(1 << (len(groups) - i) for i, g in enumerate(groups) if g not in columns) for name, columns in sets.items()}
    label = F.coalesce(*(F.when(F.col("gid") == gid, F.lit(name)) for name, gid in gids.items()))
    return cardinality(united.withColumn("grouping", label), ["grouping", *groups])


class BitmapStore:
    """Bitmaps of several runs over one dictionary that only grows, below one folder.

    Each run adds codes for ids that no earlier one had (dictionary/run=N) and the packed bitmaps
    of its own rows (bitmaps/run=N): the mergeable partial results, a few bits per member and
    group. Reading a day back ORs what the runs stored for it; the rows themselves aren't needed.
    """

    def __init__(self, spark: SparkSession, root: str, groups: list[str]) -> None:
        self.spark, self.root, self.groups = spark, root.rstrip("/"), groups

    def _parts(self, kind: str, before: int | None = None) -> DataFrame | None:
        runs = [n for n in names(self.spark, f"{self.root}/{kind}") if n.startswith("run=") and (before is None or int(n[4:]) < before)]
        return self.spark.read.parquet(*(f"{self.root}/{kind}/{n}" for n in runs)) if runs else None

    def _once(self, kind: str, run: int, df: DataFrame) -> None:
        target, draft = f"{self.root}/{kind}/run={run}", f"{self.root}/{kind}/_draft-{run}"
        if not exists(self.spark, target):
            remove(self.spark, draft)
            df.write.option("compression", "zstd").parquet(draft)
            rename(self.spark, draft, target)

    def add(self, rows: DataFrame, column: str, run: int, near: str | None = None) -> None:
        """Take in the rows (groups, `column`) of a run, numbered in order. A run that is tried again
        after a failure keeps the codes it gave. One run at a time."""
        known = self._parts("dictionary", run)
        if not exists(self.spark, f"{self.root}/dictionary/run={run}"):
            codes = dictionary(rows, column, near, known)
            self._once("dictionary", run, codes if known is None else codes.join(known.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti"))
        members = member_words(rows, self.groups, column, self._parts("dictionary", run + 1))
        self._once("bitmaps", run, pack(union(members, self.groups), self.groups))

    def bitmaps(self) -> DataFrame:
        """groups, word, bits: OR of all runs."""
        packed = self._parts("bitmaps")
        if packed is None:
            raise ValueError("no run was taken in yet")
        return union(unpack(packed, self.groups), self.groups)
