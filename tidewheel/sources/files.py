"""Small text files on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """Raises ValueError if there is no such file."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        raise ValueError(f"there is no {path}")
    data = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
    finally:
        data.close()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted."""
    fs, where = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, where = _at(spark, path)
        fs.delete(where, True)
    except Exception:  # the session may have ended before the interpreter
        pass
