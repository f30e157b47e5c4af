"""The event lake: Parquet files by project and UTC day, read as pinned snapshots."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.files import exists, names, read_text, remove, rename, write_text
from strandline.functions.properties import PROMOTED, promoted
from strandline.functions.times import day_text, micros
from strandline.operators.compaction import canonical_path, plan
from strandline.session import materialize

EVENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("uuid", "event", "distinct_id")]
    + [T.StructField("timestamp", T.TimestampType(), False), T.StructField("properties", T.StringType(), False)]
    + [T.StructField(n, T.StringType()) for n in PROMOTED.values()]
)
#: Rows a row group is sorted in; readers prune by event and time.
ORDER = ("event", "timestamp")


@dataclass(frozen=True)
class Snapshot:
    """A fixed list of files and what identifies it: readers see these files and no others."""

    paths: tuple[str, ...]
    version: str


def directory_snapshot(spark: SparkSession, root: str, project: str, from_day: str, to_day: str) -> Snapshot:
    """The files below root/project/day for days in [from_day, to_day); its version changes when
    a file's size or time does."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{root.rstrip('/')}/{project}/*/*.parquet")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    files = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found if from_day <= s.getPath().getParent().getName() < to_day)
    return Snapshot(tuple(f[0] for f in files), hashlib.sha256(repr(files).encode()).hexdigest()[:16])


def catalog_snapshot(lake_files: DataFrame, root: str, project: str, from_day: str, to_day: str) -> Snapshot:
    """The live files of a project's days from the catalog, each once; the version is the newest
    generation that touched the project. The list of files is what the driver needs to plan a scan;
    it is as long as the project has files in these days. `hold` keeps them from removal."""
    own = lake_files.where(F.col("project_id") == project)
    version = own.agg(F.max(F.greatest("created_generation", "retired_generation"))).first()[0]
    live = own.where(F.col("retired_generation").isNull() & (F.col("day") >= from_day) & (F.col("day") < to_day))
    rows = live.select(canonical_path(F.col("relative_path"), F.col("project_id"), F.col("day")).alias("path")).distinct().orderBy("path").collect()
    return Snapshot(tuple(f"{root.rstrip('/')}/{r['path']}" for r in rows), str(version or 0))


def read(spark: SparkSession, snapshot: Snapshot) -> DataFrame:
    """The snapshot's events in the event schema; no files, no rows. Files from before a column
    was promoted get it from their properties."""
    if not snapshot.paths:
        return spark.createDataFrame([], EVENT_SCHEMA)
    return with_promoted(spark.read.option("mergeSchema", True).parquet(*snapshot.paths))


def with_promoted(events: DataFrame) -> DataFrame:
    """Every promoted column: as it is, and derived from the properties where it is missing."""
    missing = {c: promoted(F.col("properties"), key) for key, c in PROMOTED.items() if c not in events.columns}
    return events.withColumns(missing) if missing else events


def by_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", day_text(micros(events, "timestamp")))


def once(events: DataFrame, *within: str) -> DataFrame:
    """One row per uuid (within the given columns): the earliest. Ties by all other columns."""
    rest = sorted(set(events.columns) - {"uuid", "timestamp", *within})
    order = Window.partitionBy(*within, "uuid").orderBy("timestamp", *rest)
    return events.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def publish(events: DataFrame, path: str, rows_a_file: int = 5_000_000, unique: bool = True) -> None:
    """Write a batch: each uuid once (unless told that `day` and that are given), a directory per project and day, sorted for pruning.

    The rows are spread by range of project, day and what a file is sorted by: a day with a third of
    all rows becomes several tasks and files, each with a stretch of its own of event names and times.
    """
    placed = by_day(once(events, "project_id")) if unique else events
    writer = placed.repartitionByRange("project_id", "day", *ORDER).sortWithinPartitions("project_id", "day", *ORDER).write
    writer.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).partitionBy("project_id", "day").mode("append").parquet(path)


def compacted(events: DataFrame) -> DataFrame:
    """What a compacted partition holds: each uuid once per project and day. Retries on another
    day stay."""
    return once(by_day(events), "project_id", "day")


def without_persons(events: DataFrame, erased: DataFrame) -> DataFrame:
    """Events of everyone but the erased distinct ids (project_id, distinct_id)."""
    return events.join(erased.select("project_id", "distinct_id").distinct(), ["project_id", "distinct_id"], "left_anti")


def retained(events: DataFrame, today: str, keep_days: int) -> DataFrame:
    """Events whose day is not older than `keep_days` before today."""
    oldest = F.date_sub(F.lit(today).cast("date"), keep_days).cast("string")
    return by_day(events).where(F.col("day") >= oldest)


# ---- the catalog of a lake: what belongs to it, changed one whole commit at a time

CATALOG_SCHEMA = "id long, project_id string, day string, relative_path string, rows long, bytes long, level int, created_generation long, retired_generation long, created_at long"
#: So many of the newest commits stay as they are when older ones are merged into one.
KEPT_COMMITS = 10


def _commits(spark: SparkSession, root: str) -> list[str]:
    """The commits that count, in order: the last merged one and those after it."""
    found = [n for n in names(spark, f"{root}/catalog") if n.startswith("g")]
    merged = [i for i, n in enumerate(found) if n.endswith(".merged")]
    return found[merged[-1] :] if merged else found


def generation(spark: SparkSession, root: str) -> int:
    """The newest generation, 0 for a new lake."""
    found = _commits(spark, root.rstrip("/"))
    return int(found[-1][1:13]) if found else 0


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every file the lake has or had, as `lake_files`: live are those without retired_generation.

    A commit adds rows for new files, and repeats those of files it retires with its generation. A
    reader sees all of a commit or nothing of it, since a commit is the renaming of one folder.
    """
    root = root.rstrip("/")
    paths = [f"{root}/catalog/{n}" for n in _commits(spark, root)]
    if not paths:
        return spark.createDataFrame([], CATALOG_SCHEMA)
    rows = spark.read.schema(CATALOG_SCHEMA).parquet(*paths)
    same = [c for c in rows.columns if c not in ("relative_path", "retired_generation")]
    known = rows.groupBy("relative_path").agg(*(F.max(c).alias(c) for c in same), F.max("retired_generation").alias("retired_generation"))
    return known.select(*rows.columns)


def _decoded(text: Column | str) -> Column:
    """A file's address, or a folder's name, with its escaped characters as they are."""
    return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))


def _folder(column: str) -> Column:
    """The value that a file's path has for a column of its folders."""
    return _decoded(F.regexp_extract("relative_path", f"{column}=([^/]*)/", 1))


def commit(spark: SparkSession, root: str, events: DataFrame | None, retired: DataFrame | None, now_us: int, level: int = 0, tag: str = "") -> int:
    """Add the `events` (with project_id) as files and retire catalog rows, both at once.

    Returns the new generation, or 0 if there is a commit with this `tag` among the newest: a batch
    that is tried again counts once. Two writers at the same time: the second one's rename fails and
    it has to begin again. What a failed commit wrote belongs to no generation.
    """
    root = root.rstrip("/")
    tags = (f"{root}/catalog/{n}/_tag" for n in _commits(spark, root)[-KEPT_COMMITS:])
    if tag and any(exists(spark, t) and read_text(spark, t) == tag for t in tags):
        return 0
    number = generation(spark, root) + 1
    data, parts = f"data/g{number:012d}-{uuid.uuid4().hex[:8]}", []
    if events is not None:
        publish(events, f"{root}/{data}", unique=level == 0)
    if events is not None and exists(spark, f"{root}/{data}") and any(n.startswith("project_id=") for n in names(spark, f"{root}/{data}")):
        files = spark.read.schema(EVENT_SCHEMA).parquet(f"{root}/{data}").groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count(F.lit(1)).alias("rows"))
        path = F.concat(F.lit(f"{data}/"), F.regexp_extract(_decoded("file_path"), r"(project_id=[^/]*/day=[^/]*/[^/]+)$", 1))
        parts.append(files.select(path.alias("relative_path"), "rows", F.col("file_size").alias("bytes")).select(
            F.abs(F.xxhash64("relative_path")).alias("id"), _folder("project_id").alias("project_id"), _folder("day").alias("day"), "relative_path", "rows", "bytes",
            F.lit(level).alias("level"), F.lit(number).cast("long").alias("created_generation"), F.lit(None).cast("long").alias("retired_generation"), F.lit(now_us // 1_000_000).cast("long").alias("created_at")))
    if retired is not None:
        parts.append(retired.withColumn("retired_generation", F.lit(number).cast("long")).select(*(f.split(" ")[0] for f in CATALOG_SCHEMA.split(", "))))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.createDataFrame([], CATALOG_SCHEMA)
    draft = f"{root}/catalog/_draft-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(draft)
    write_text(spark, f"{draft}/_tag", tag)
    rename(spark, draft, f"{root}/catalog/g{number:012d}")
    return number


def merge_commits(spark: SparkSession, root: str) -> None:
    """Merge all but the newest commits into one, so that the catalog stays a few files."""
    root = root.rstrip("/")
    found = _commits(spark, root)
    old, number = found[:-KEPT_COMMITS], found[-KEPT_COMMITS - 1][1:13] if len(found) > KEPT_COMMITS else ""
    if len(old) < 2:
        return
    rows = spark.read.schema(CATALOG_SCHEMA).parquet(*(f"{root}/catalog/{n}" for n in old))
    draft = f"{root}/catalog/_draft-{uuid.uuid4().hex}"
    rows.dropDuplicates().coalesce(1 + len(old) // 1000).write.parquet(draft)
    rename(spark, draft, f"{root}/catalog/g{number}.merged")
    for n in old:
        remove(spark, f"{root}/catalog/{n}")


def _live(spark: SparkSession, root: str) -> DataFrame:
    return catalog(spark, root).where(F.col("retired_generation").isNull())


def read_lake(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The events of catalog rows, with project_id, day and the relative_path of each one's file."""
    base = root.rstrip("/")
    paths = [f"{base}/{r[0]}" for r in files.select("relative_path").collect()]
    schema = T.StructType([*EVENT_SCHEMA.fields])
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    own = F.regexp_extract(_decoded("_metadata.file_path"), r"(data/[^/]+/project_id=[^/]*/day=[^/]*/[^/]+)$", 1) if paths else F.lit("")
    return rows.select("*", own.alias("relative_path")).withColumns({c: _folder(c) for c in ("project_id", "day")})


def erase(spark: SparkSession, root: str, erased: DataFrame, now_us: int) -> int:
    """Rewrite the files that hold events of the given ids (project_id, distinct_id), without them;
    all other files stay. Returns how many were rewritten."""
    live = _live(spark, root)
    gone = erased.select("project_id", "distinct_id").distinct()
    holding = read_lake(spark, root, live).join(gone, ["project_id", "distinct_id"], "left_semi").select("relative_path").distinct()
    touched = materialize(live.join(holding, "relative_path"))
    n = touched.count()
    if n:
        commit(spark, root, without_persons(read_lake(spark, root, touched), gone).select("project_id", "day", *EVENT_SCHEMA.names), touched, now_us, level=1)
    return n


def retire(spark: SparkSession, root: str, today: str, keep_days: int, now_us: int) -> int:
    """Retire the files of days older than `keep_days` before today. Nothing is read or rewritten."""
    oldest = F.date_sub(F.lit(today).cast("date"), keep_days).cast("string")
    old = materialize(_live(spark, root).where(F.col("day") < oldest))
    n = old.count()
    if n:
        commit(spark, root, None, old, now_us)
    return n


def compact(spark: SparkSession, root: str, now_us: int) -> int:
    """Replace the small files of each project and day by few sorted ones, each uuid once. The new
    files must hold as many different uuids per day as the old ones. Returns the files replaced."""
    live = materialize(_live(spark, root))
    chosen = materialize(live.join(plan(live).select(F.explode("ids").alias("id")), "id", "left_semi"))
    n = chosen.count()
    if n:
        rows = read_lake(spark, root, chosen)
        merged = materialize(once(rows, "project_id", "day").select("project_id", "day", *EVENT_SCHEMA.names))
        count = lambda df: df.groupBy("project_id", "day").agg(F.countDistinct("uuid").alias("n"))
        if not count(rows).exceptAll(merged.groupBy("project_id", "day").agg(F.count(F.lit(1)).alias("n"))).isEmpty():
            raise ValueError("the merged files differ from what was read")
        commit(spark, root, merged, chosen, now_us, level=1)
    return n


@contextmanager
def hold(spark: SparkSession, root: str) -> Iterator[int]:
    """Keep the files of the present generation until the end of the block."""
    number = generation(spark, root.rstrip("/"))
    path = f"{root.rstrip('/')}/holds/{uuid.uuid4().hex}.json"
    write_text(spark, path, json.dumps({"generation": number}))
    try:
        yield number
    finally:
        remove(spark, path)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete retired files that no holder may still read. Returns how many."""
    root = root.rstrip("/")
    held = [json.loads(read_text(spark, f"{root}/holds/{n}"))["generation"] for n in names(spark, f"{root}/holds") if n.endswith(".json") and not n.startswith("_")]
    upto = min([generation(spark, root), *held])
    gone = catalog(spark, root).where(F.col("retired_generation") <= upto).select("relative_path")
    n = 0
    for row in gone.toLocalIterator():
        if exists(spark, f"{root}/{row[0]}"):
            remove(spark, f"{root}/{row[0]}")
            n += 1
    return n


def rewrite_days(spark: SparkSession, path: str, replacement: DataFrame) -> None:
    """Replace the days that `replacement` holds, and no others, at once per day."""
    replacement.sortWithinPartitions("project_id", "day", *ORDER).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("project_id", "day").parquet(path)
