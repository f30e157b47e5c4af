"""Consolidation of small files: plan bins, rewrite them, verify, commit at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.files import exists, names, read_text, remove, rename, write_text

SMALL_BYTES = 32_768
TARGET_BYTES = 128 << 20
#: Files packed by one task; a day with more is packed in several chunks of about this many.
FILES_A_CHUNK = 20_000


def canonical_path(path: Column, project: Column, day: Column) -> Column:
    """One spelling per file: forward slashes, no empty, '.' or '..' segments, and nothing before
    the file's own project and day where they are part of the path."""
    p = F.regexp_replace(path, r"\\", "/")
    for pattern, by in ((r"/{2,}", "/"), (r"(?:^|(?<=/))(?:\./)+", ""), (r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", ""), (r"^/", "")):
        p = F.regexp_replace(p, pattern, by)
    home = F.concat(project, F.lit("/"), day, F.lit("/"))
    at = F.instr(p, home)
    return F.when(at > 1, F.substr(p, at)).otherwise(p)


def live_files(files: DataFrame) -> DataFrame:
    """One row per live file, however often it is registered and however its path is spelled.

    Columns: id (the smallest), project_id, day, path, bytes, rows, ids (all its live ids). Its
    size is the largest registered one; unknown only if no registration has it.
    """
    live = files.where(F.col("retired_generation").isNull())
    path = F.coalesce(canonical_path(F.col("relative_path"), F.col("project_id"), F.col("day")), F.concat(F.lit("?"), F.col("id")))
    return live.groupBy("project_id", "day", path.alias("path")).agg(F.min("id").alias("id"), F.max("bytes").alias("bytes"), F.max("rows").alias("rows"), F.collect_set("id").alias("ids"))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size: largest first, each into the first bin with room for it.

    A size above the capacity gets a bin of its own. Ties keep their order, so the result is
    defined. The first bin with room is found in a tree of the bins' free space.
    """
    n = len(sizes)
    width = 1 << max(0, n - 1).bit_length()
    free = np.zeros(2 * width, dtype=np.int64)
    free[width : width + n] = capacity
    for level in range(width - 1, 0, -1):
        free[level] = max(free[2 * level], free[2 * level + 1])
    bins, opened, alone = np.zeros(n, dtype=np.int64), 0, []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        if size > capacity:
            alone.append(i)
            continue
        node = 1
        while node < width:
            node = 2 * node if free[2 * node] >= size else 2 * node + 1
        bins[i] = node - width
        opened = max(opened, node - width + 1)
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    bins[alone] = opened + np.arange(len(alone))
    return bins


def packer(capacity: int):
    """Packs the files of one chunk; passed to applyInPandas."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        return frame.assign(bin=first_fit_decreasing(frame["packed_bytes"].to_numpy(np.int64), capacity))

    return pack


def plan(files: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, files_a_chunk: int = FILES_A_CHUNK) -> DataFrame:
    """The frozen manifest: the files to replace, each with the bin it is packed into.

    Columns: project_id, day, chunk, bin, id, path, bytes, rows, ids. To replace are live files
    smaller than `small_bytes` or of unknown size whose project and day have at least two such.
    They are packed first-fit decreasing into bins of `target_bytes`; a file of unknown size is
    packed as one of `small_bytes`. A day with very many files is split by hash into chunks, so
    that no task gets an unbounded group. Empty files are replaced by nothing. No files, no bins.
    """
    small = live_files(files).where(F.col("bytes").isNull() | (F.col("bytes") < small_bytes))
    small = small.withColumn("packed_bytes", F.coalesce("bytes", F.lit(small_bytes)))
    groups = small.groupBy(F.col("project_id").alias("g_project"), F.col("day").alias("g_day")).agg(F.count(F.lit(1)).alias("n_small")).where("n_small > 1")
    same = F.col("project_id").eqNullSafe(F.col("g_project")) & F.col("day").eqNullSafe(F.col("g_day"))
    chunks = F.ceil(F.col("n_small") / F.lit(files_a_chunk))
    chosen = small.join(groups, same).withColumn("chunk", F.pmod(F.xxhash64("path"), chunks).cast("int")).drop("g_project", "g_day", "n_small")
    schema = "project_id string, day string, path string, id long, bytes long, rows long, ids array<long>, packed_bytes long, chunk int, bin long"
    packed = chosen.select("project_id", "day", "path", "id", "bytes", "rows", "ids", "packed_bytes", "chunk").groupBy("project_id", "day", "chunk").applyInPandas(packer(target_bytes), schema)
    return packed.select("project_id", "day", "chunk", "bin", "id", "path", "bytes", "rows", "ids")


def bin_summary(manifest: DataFrame) -> DataFrame:
    """Per bin: files in, bytes and rows as registered."""
    return manifest.groupBy("project_id", "day", "chunk", "bin").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes_before"), F.sum("rows").alias("rows_registered"))


def _fingerprint(columns: list[str]) -> list[Column]:
    row = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("n_rows"), F.bit_xor(row).alias("xor_of_rows"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("sum_of_rows")]


def compact(rows: DataFrame, manifest: DataFrame, target: str, generation: int, file_id: str = "file_id", order: tuple[str, ...] = ("event", "timestamp")) -> DataFrame:
    """Rewrite the manifest's files as one file per bin below `target` and commit them at once.

    `rows` holds each row with the id of its file. The rows of a bin go to one file, sorted for
    pruning, exactly once, repeated rows included. Before the commit every bin's row count and
    two checksums over all columns are compared between what was read and what the new files
    hold; a difference raises and commits nothing. The commit is the renaming of one file, the
    generation's manifest: until then readers see the old files, and a job that dies leaves only
    a staging folder. Columns: project_id, day, chunk, bin, n_rows, xor_of_rows, sum_of_rows,
    n_files.
    """
    spark = rows.sparkSession
    bins = ["project_id", "day", "chunk", "bin"]
    values = [c for c in rows.columns if c != file_id]
    place = manifest.select(*(F.col(c).alias(f"_{c}") for c in bins), F.explode("ids").alias("_id"))
    moved = rows.join(place, F.col(file_id) == F.col("_id")).drop("_id", file_id)
    keys = [f"_{c}" for c in bins]
    staged = f"{target.rstrip('/')}/_staging-{generation}"
    try:
        placed = moved.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *(c for c in order if c in values))
        placed.write.option("compression", "zstd").partitionBy(*keys).parquet(staged)
        written = spark.read.schema(moved.schema).parquet(staged)
        before = moved.groupBy(*keys).agg(*_fingerprint(values))
        after = written.groupBy(*keys).agg(*_fingerprint(values))
        differences = before.exceptAll(after).unionByName(after.exceptAll(before)).limit(5).collect()
        if differences:
            raise ValueError(f"the rewritten bins differ from what was read: {differences}")
        _commit(spark, staged, target, generation)
    except BaseException:
        remove(spark, staged)
        raise
    final = f"{target.rstrip('/')}/generation-{generation}"
    report = spark.read.schema(moved.schema).parquet(final).groupBy(*keys).agg(*_fingerprint(values)).select(*(F.col(f"_{c}").alias(c) for c in bins), "n_rows", "xor_of_rows", "sum_of_rows")
    return report.join(bin_summary(manifest).select(*bins, "n_files"), bins)


def _commit(spark, staged: str, target: str, generation: int) -> None:
    """Move the staged folder to its place, then publish it by renaming one small file."""
    root = target.rstrip("/")
    final, manifest = f"{root}/generation-{generation}", f"{root}/manifest-{generation:012d}.json"
    if exists(spark, manifest):
        raise ValueError(f"generation {generation} is already published")
    rename(spark, staged, final)
    write_text(spark, manifest, json.dumps({"generation": generation, "files": final}))


def published(spark, target: str) -> Iterator[dict]:
    """The published generations below `target`, in order."""
    root = target.rstrip("/")
    for name in names(spark, root):
        if name.startswith("manifest-") and name.endswith(".json"):
            yield json.loads(read_text(spark, f"{root}/{name}"))
