"""Folder operations through the Hadoop file system of the session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return _path(spark, path).getFileSystem(conf)


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).delete(_path(spark, path), True)


def children(spark: SparkSession, path: str) -> Iterator[tuple[str, bool]]:
    """(path, is folder) of each entry, or nothing if ``path`` does not exist."""
    if not exists(spark, path):
        return
    listing = _fs(spark, path).listStatusIterator(_path(spark, path))
    while listing.hasNext():
        status = listing.next()
        yield status.getPath().toString(), status.isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def rename(spark: SparkSession, old: str, new: str) -> bool:
    return _fs(spark, old).rename(_path(spark, old), _path(spark, new))


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Put a small file; one of that name is replaced."""
    out = _fs(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """Content of a small file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
