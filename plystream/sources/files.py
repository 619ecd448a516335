"""Files of any Hadoop file system: what a commit needs of them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    at, fs = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    at, fs = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def beside(spark: SparkSession, path: str) -> str:
    """A name next to ``path`` that nobody has, which Spark's readers of the folder overlook."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name}-{uuid.uuid4().hex}"


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Renames ``new`` to ``path``, whose old files go once they are moved out of the way."""
    at, fs = _at(spark, path)
    old, _ = _at(spark, beside(spark, path))
    fs.mkdirs(at.getParent())
    had = fs.exists(at)
    if had:
        fs.rename(at, old)
    if not fs.rename(_at(spark, new)[0], at):
        raise OSError(f"{new} could not be renamed to {path}")
    if had:
        fs.delete(old, True)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside and renames it, so that no reader sees a half of it."""
    new = beside(spark, path)
    at, fs = _at(spark, new)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace(spark, new, path)
