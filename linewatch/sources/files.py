"""Small file operations through Spark's own file systems, so that any store that Spark reads works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str, encoded: bool = False):
    """A Hadoop path and its file system; ``encoded``: a URI, as file metadata has it."""
    jvm = spark._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if encoded else path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _path(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str, encoded: bool = False) -> None:
    """Deletes a file or folder; nothing happens if it is not there."""
    jpath, fs = _path(spark, path, encoded)
    fs.delete(jpath, True)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    jpath, fs = _path(spark, source)
    if not fs.rename(jpath, _path(spark, target)[0]):
        raise OSError(f"{source} could not be renamed to {target}")


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file."""
    jpath, fs = _path(spark, path)
    fs.create(jpath).close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    jpath, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``, from the sizes of its files; reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
