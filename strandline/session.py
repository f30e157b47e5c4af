"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.files import remove

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


#: Tables over scratch data that `bucketed` made in the session's catalog.
TABLES: list[str] = []


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is written for. `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName("strandline")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new path of this application in the folder that all executors share.

    The cluster names that folder in `spark.checkpoint.dir`. Only where it is unset and all
    executors are on this machine, as in tests, a folder of this machine is made and removed at
    exit. `clean` removes all paths of the application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{_own(spark, root)}/{uuid.uuid4().hex}"


def _own(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/strandline/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove this application's scratch data and the tables over it. No result that is still to be
    read may need it."""
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    TABLES.clear()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        remove(spark, _own(spark, root))


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage like checkpoint() does, but compressed, columnar and readable in part. A
    lost executor costs only its running tasks: what is written stays readable.
    """
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of the size; of what was just written, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucketed(df: DataFrame, buckets: int, keys: list[str], *partition_by: str) -> DataFrame:
    """`df` written to the shared folder in buckets of `keys`, and read back as such."""
    spark = df.sparkSession
    name = f"strandline_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").option("path", scratch(spark)).option("compression", "zstd").partitionBy(*partition_by).bucketBy(buckets, *keys).saveAsTable(name)
    TABLES.append(name)
    return spark.table(name)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """`df` written down for as long as several results are taken from it, then removed."""
    spark = df.sparkSession
    path = scratch(spark)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over all cores, by hash of the keys, if its scan has fewer parts than there are cores.

    For stages that spend much more time on a row than reading it takes. Larger inputs have parts
    enough and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that the driver already has, as part of the plan: its size is known to the
    optimizer, and no Python task is started to make it."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))
