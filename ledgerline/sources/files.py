"""Files on whatever file system a path names, by way of Hadoop: local, shared or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with what is in it."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a file or folder another name."""
    fs, p = _at(spark, path)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be moved to {to}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """The paths of what is in a folder, sorted; none where there is no folder."""
    fs, p = _at(spark, folder)
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)) if fs.exists(p) else []
