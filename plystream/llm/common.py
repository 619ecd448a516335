"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the text contracts name.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of ids up to which they are broadcast.
BROADCAST = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _temporary(master: str) -> str:
    if not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors on other machines need a shared folder")
    return "file://" + tempfile.mkdtemp(prefix="plystream-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only where that is unset and everything runs on
    one machine, as in tests, a temporary folder is used; a cluster has to name its own."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _temporary(spark.sparkContext.master)).rstrip("/")


#: Folders that this process has staged and not deleted, in the order of their making.
_STAGED: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back. It cuts lineage, so that a lost executor costs
    one stage, and keeps Python stages from running once for each reader. A staged table that it replaces is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plystream-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if instead_of is not None and instead_of in _PATHS:
        _delete(spark, [_PATHS[instead_of]])
    return out


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Stages what ``make`` returns, and then deletes all that it has staged on its way."""
    begin = len(_STAGED)
    out = staged(make(), name, instead_of)
    _delete(spark, [p for p in _STAGED[begin:] if p != _PATHS[out]])
    return out


def release(spark: SparkSession) -> None:
    """Deletes all that was staged. What was made from it can't be read any more."""
    _delete(spark, list(_STAGED))


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        delete(spark, p)
        _STAGED.remove(p)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of fewer rows, so that a worker holds Python objects of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def without(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have an id which is not among those of ``gone``, a table of one column of ids: one
    sort-merge anti-join, alike at every size."""
    gone = gone.toDF("__gone").where("__gone is not null").distinct().hint("merge")
    own = docs[doc_id].cast("bigint")
    return docs.where(own.isNotNull()).join(gone, own == F.col("__gone"), "left_anti")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 1000) -> DataFrame:
    """Inner join of rows with their groups (one row for each key; ``size`` is its number of rows), safe for hot keys.

    Keys with more than a ``hot``-th of all rows are fewer than ``hot``, as sizes add up to the number of rows, so they
    are broadcast and their rows stay where they are; all other keys are joined by shuffle. Null keys don't match.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * hot > F.lit(total)
    large = groups.where(is_hot)
    common = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(~is_hot), key)
    return common.unionByName(rest)
