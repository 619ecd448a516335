"""A store of windows that grows batch by batch, with its splits, resume points and pending rows.

A folder has ``windows/batch=<id>``, the batches; ``splits/<version>/split=<name>``, what the last checkpoint dealt; and
``commits/<n>.json``, one marker for each commit: which batches count, the resume point of each source, and which version of the
splits is the valid one. A marker is written beside and renamed, and nothing that it names is changed later, so whatever
breaks off leaves the state of the last marker. There is one writer; readers need none of its locks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plystream.operators import split
from plystream.sources import files

EMPTY = {"batches": [], "offsets": {}, "splits": None}


class WindowStore:
    """``key`` names a window, of which there is one only; ``group`` is what splits are stratified by; ``items`` is the array that a
    window holds. Shares of training and validation are those of the windows of each group, rounded down."""

    def __init__(self, spark: SparkSession, folder: str, key: str, group: str, items: str, train: float = 0.8, val: float = 0.1, seed: str = "0"):
        self.spark, self.folder, self.key, self.group, self.items = spark, folder.rstrip("/"), key, group, items
        self.train, self.val, self.seed = train, val, seed

    def state(self) -> dict:
        """What the last readable marker says; the empty state without one."""
        for name in sorted(files.names(self.spark, f"{self.folder}/commits"), reverse=True):
            if name.endswith(".json") and name[0] not in "_.":
                try:
                    return EMPTY | json.loads(files.read(self.spark, f"{self.folder}/commits/{name}")) | {"commit": int(name.split(".")[0])}
                except ValueError:  # a marker that is no JSON was never finished
                    continue
        return EMPTY | {"commit": -1}

    def _commit(self, state: dict) -> None:
        n = state.pop("commit") + 1
        files.publish(self.spark, f"{self.folder}/commits/{n:012}.json", json.dumps(state, sort_keys=True))
        for name in files.names(self.spark, f"{self.folder}/commits"):
            if name.endswith(".json") and int(name.split(".")[0]) < n - 10:
                files.delete(self.spark, f"{self.folder}/commits/{name}")

    def windows(self, state: dict | None = None) -> DataFrame | None:
        """The windows of all committed batches; None if there is none. Empty windows are left out."""
        batches = (state or self.state())["batches"]
        if not batches:
            return None
        found = self.spark.read.option("basePath", f"{self.folder}/windows").parquet(*[f"{self.folder}/windows/batch={b}" for b in batches])
        return found.where(F.size(self.items) > 0).drop("batch")

    def add(self, batch: DataFrame, batch_id: int, offsets: dict[str, int] | None = None) -> bool:
        """Commits a batch together with the resume points of its sources. Returns False, and changes nothing, if a batch of this id is
        committed already, so a stream may repeat its last one. A window whose key is null, twice in the batch or in an
        earlier one fails it. Empty windows are not stored."""
        state = self.state()
        if batch_id in state["batches"]:
            return False
        at = f"{self.folder}/windows/batch={batch_id}"
        batch.where(F.size(self.items) > 0).write.mode("overwrite").parquet(at)  # over what an attempt without a marker left
        written = self.spark.read.parquet(at)
        known = self.windows(state)
        keys = written.groupBy(self.key).agg(F.count("*").alias("n"))
        bad = keys.where(F.col(self.key).isNull() | (F.col("n") > 1)).select(self.key)
        if known is not None:
            bad = bad.unionByName(keys.join(known.select(self.key), self.key, "left_semi").select(self.key))
        example = bad.first()
        if example is not None:
            files.delete(self.spark, at)
            raise ValueError(f"{self.key} {example[0]} is null or there already")
        offsets = {k: max(v, state["offsets"].get(k, 0)) for k, v in (offsets or {}).items()}
        self._commit({**state, "batches": [*state["batches"], batch_id], "offsets": {**state["offsets"], **offsets}})
        return True

    def checkpoint(self) -> dict[str, int]:
        """Deals all windows to splits anew, by group, and makes that the valid version. Returns how many windows each has."""
        state = self.state()
        known = self.windows(state)
        if known is None:
            return {}
        version = state["commit"] + 1
        at = f"{self.folder}/splits/{version}"
        dealt = split.stratified(known, self.key, [self.group], self.train, self.val, self.seed)
        dealt.write.mode("overwrite").partitionBy("split").parquet(at)
        self._commit({**state, "splits": version})
        for old in files.names(self.spark, f"{self.folder}/splits"):
            if old.isdigit() and int(old) < (state["splits"] if state["splits"] is not None else version):  # the one before stays for who reads it
                files.delete(self.spark, f"{self.folder}/splits/{old}")
        return {r["split"]: r["n"] for r in self.splits().groupBy("split").agg(F.count("*").alias("n")).collect()}

    def splits(self) -> DataFrame:
        version = self.state()["splits"]
        if version is None:
            raise ValueError("there is no checkpoint")
        return self.spark.read.parquet(f"{self.folder}/splits/{version}")


def sink(store: WindowStore, offsets: Callable[[DataFrame], dict[str, int]] | None = None, every: int = 0) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` takes: adds each batch with the resume points that ``offsets`` reads from it, and deals splits after each
    ``every``-th."""

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store.add(batch, batch_id, offsets(batch) if offsets else None)
        finally:
            batch.unpersist()
        if every and (batch_id + 1) % every == 0:
            store.checkpoint()

    return take


def furthest(source: str, number: str) -> Callable[[DataFrame], dict[str, int]]:
    """The largest number of each source in a batch; sources are as few as the list of them."""
    return lambda batch: {r["s"]: r["n"] for r in batch.groupBy(F.col(source).alias("s")).agg(F.max(number).alias("n")).collect()}


def merge_pending(spark: SparkSession, pending: str, rows: DataFrame, batch_id: int, splits: DataFrame | None = None, key: str = "game_id") -> tuple[DataFrame, DataFrame] | None:
    """Appends rows that wait for their split to ``pending``, as a part of their own that a repeated batch writes over. With
    ``splits``, (key, split), returns the rows that have one by now, and those that still wait; the caller writes both and then
    starts anew with what waits."""
    rows.write.mode("overwrite").parquet(f"{pending}/batch={batch_id}")
    if splits is None:
        return None
    waiting = spark.read.parquet(pending).drop("batch")
    return waiting.join(splits.select(key, "split"), key), waiting.join(splits.select(key), key, "left_anti")
