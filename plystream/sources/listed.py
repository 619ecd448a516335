"""Lists of sources: checked, resumed, read by kind and put together."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plystream.sources import frames, games

#: What a list calls its kinds: compressed and plain text of games, and tables with a game in a column.
KINDS = ("lichess", "fics", "csv")


@dataclass(frozen=True)
class Source:
    path: str
    tag: str
    kind: str
    column: str = "pgn"
    skip: int = 0
    most: int | None = None

    @property
    def key(self) -> str:
        """What resume points are kept by."""
        return f"{self.kind}:{self.path}"


#: The names that an entry of a list uses, and what each is where it is not given.
FIELDS = {"path": None, "tag": None, "kind": None, "pgn_col": "pgn", "skip_games": 0, "max_games": None}


def kind_of(path: str) -> str:
    return {"zst": "lichess", "csv": "csv", "zip": "csv"}.get(path.lower().rpartition(".")[2], "fics")


def listed(entries: list[dict], done: dict[str, int] | None = None) -> list[Source]:
    """Sources of a list of {path, tag, kind?, pgn_col?, skip_games?, max_games?}. Paths and tags are required and tags unique,
    as ids of games begin with them; all that is wrong with a list is said at once. What ``done`` says of a source's key is
    skipped too."""
    full = [FIELDS | {k: v for k, v in e.items() if v not in (None, "")} for e in entries]
    kinds = [e["kind"] or kind_of(e["path"] or "") for e in full]
    tags = Counter(e["tag"] for e in full if e["tag"])
    faults = [] if entries else ["the list of sources is empty"]
    faults += [f"source {i}: {name} is missing" for i, e in enumerate(full) for name in ("path", "tag") if not e[name]]
    faults += [f"tag {tag} is there {'twice' if n == 2 else f'{n} times'}" for tag, n in tags.items() if n > 1]
    faults += [f"source {i}: unknown kind {kind}" for i, kind in enumerate(kinds) if kind not in KINDS]
    if faults:
        raise ValueError("; ".join(faults))
    out = [Source(e["path"], e["tag"], kind, e["pgn_col"], e["skip_games"], e["max_games"]) for e, kind in zip(full, kinds, strict=True)]
    return [replace(s, skip=s.skip + (done or {}).get(s.key, 0)) for s in out]


def unused(entries: list[Source], done: dict[str, int]) -> list[str]:
    """Keys of resume points that no source has."""
    return sorted(set(done) - {s.key for s in entries})


def zst_games(spark: SparkSession, path: str, split: int = frames.SPLIT, across: bool = False) -> DataFrame:
    """(path, local_id, pgn) of zstd files, with bad bytes replaced: a game begins at a line that starts with ``[Event ``. Files are
    split by frames, and games numbered in each, or ``across`` all of a folder."""
    return frames.numbered(frames.zstd(spark, path, "[Event ", split), across).withColumnRenamed("value", "pgn")


def zip_games(spark: SparkSession, path: str, column: str = "pgn") -> DataFrame:
    """(path, local_id, pgn) of the first ``.csv`` member of zip files, a task for each; rows without a game go before they are
    numbered. Without such a member or column the job fails."""
    return frames.numbered(frames.zipped(spark, path, column)).withColumnRenamed("value", "pgn")


def read(spark: SparkSession, source: Source) -> DataFrame:
    """(source_tag, local_id, pgn) of one source; ``most`` counts after what is skipped. Plain text and bz2 are read in blocks."""
    path = source.path.lower()
    if path.endswith(".zst"):
        found = zst_games(spark, source.path)
    elif path.endswith(".zip"):
        found = zip_games(spark, source.path, source.column)
    elif source.kind == "csv":
        rows = games.csv_games(spark, source.path, source.column).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.col(source.column).alias("pgn"))
        found = games.numbered(rows, "path", "at")
    else:
        return games.pgn_games(spark, source.path, source.tag, source.skip, source.most)
    found = found.select(F.lit(source.tag).alias("source_tag"), "local_id", "pgn").where(F.col("local_id") > source.skip)
    return found if source.most is None else found.where(F.col("local_id") <= source.skip + source.most)


def read_all(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All sources, with their place in the list as ``source_order`` and ids of games, ``tag_number``."""
    each = [read(spark, s).withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, each).withColumn("game_id", F.concat_ws("_", "source_tag", "local_id"))


def manifest(spark: SparkSession, path: str) -> dict:
    """The record of a folder of shards, in ``manifest.json``: num_shards, shard_size, total. Without it, or one of these,
    an error."""
    rows = spark.read.json(f"{path}/manifest.json", multiLine=True).limit(1).collect()
    found = rows[0].asDict() if rows else {}
    missing = [k for k in ("num_shards", "shard_size", "total") if found.get(k) is None]
    if missing:
        raise ValueError(f"{path}/manifest.json lacks {', '.join(missing)}")
    return found


def shards(spark: SparkSession, path: str, schema: str, label: str | None = None) -> DataFrame:
    """The rows of a folder of Parquet shards; unreadable ones are skipped. A row whose ``label`` is null fails the job."""
    found = spark.read.options(ignoreCorruptFiles=True, pathGlobFilter="*.parquet").schema(schema).parquet(path)
    if label is None:
        return found
    kind = found.schema[label].dataType
    if kind.typeName() in ("array", "map", "struct"):
        raise ValueError(f"label {label} is no scalar")
    return found.withColumn(label, F.coalesce(label, F.raise_error(F.lit(f"{label} is null")).cast(kind)))
