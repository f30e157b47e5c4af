"""Files of the shared folder, through the session's own file system client."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, target = _at(spark, path)
    fs.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    fs, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder to a place where nothing is. Of two that try at once one gets an error,
    where the file system's own rename is atomic."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, source = _at(spark, path)
    target = _at(spark, to)[1]
    fs.mkdirs(target.getParent())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), options)
    except (Py4JJavaError, PySparkException) as e:
        raise OSError(f"could not move {path} to {to}: {e}".split("\n", 1)[0]) from e


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_draft-{name}"
    fs, target = _at(spark, draft)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, draft, path)
