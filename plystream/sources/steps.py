"""Steps of a run, as a table of attempts: what was tried, when, and how it ended. Nothing in it is ever changed; what is done is a
question to the table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plystream.sources import files

SCHEMA = "step string, attempt int, outcome string, output string, error string, ended timestamp"


def pauses(first: float, times: int, factor: float = 2.0, longest: float = 600.0) -> list[float]:
    """Seconds between attempts, each ``factor`` times the one before."""
    return [min(first * factor**k, longest) for k in range(times)]


def ready(spark: SparkSession, path: str, least: int = 1) -> bool:
    """Whether a table is there: its writer has finished, it has ``least`` bytes or more, and a schema can be read from it."""
    if not files.exists(spark, f"{path}/_SUCCESS") or files.size(spark, path) < least:
        return False
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception:  # whatever keeps it from being read, it is not ready
        return False


class Attempts:
    """The attempts of a run, a small file of JSON for each, in a folder of any file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.folder) if files.names(self.spark, self.folder) else self.spark.createDataFrame([], SCHEMA)

    def last(self, step: str) -> Row | None:
        return self.table().where(F.col("step") == step).orderBy(F.desc("attempt")).first()

    def add(self, step: str, outcome: str, output: str | None = None, error: str | None = None) -> None:
        before = self.last(step)
        row = {"step": step, "attempt": before["attempt"] + 1 if before else 1, "outcome": outcome, "output": output, "error": error,
               "ended": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        files.publish(self.spark, f"{self.folder}/{step}-{row['attempt']:06}.json", json.dumps({k: v for k, v in row.items() if v is not None}))

    def unfinished(self, outputs: dict[str, str]) -> list[str]:
        """Which of these steps, by name and output, have to run: the last attempt did not end well, or its output is not there."""
        last = {r["step"]: r["outcome"] for r in self.table().groupBy("step").agg(F.max_by("outcome", "attempt").alias("outcome")).collect()}
        return [step for step, path in outputs.items() if last.get(step) != "written" or not ready(self.spark, path)]

    def output(self, step: str, make: Callable[[], DataFrame], path: str, again: bool = False, wait: Iterable[float] = ()) -> DataFrame:
        """The table at ``path``, written by ``make`` if the step has to run or is asked for ``again``. Tasks that fail are Spark's to
        repeat; a job that fails is tried once more after each pause of ``wait``. Every attempt is a row, and the error
        of the last one is raised."""
        rest = iter(wait)
        while again or self.unfinished({step: path}):
            try:
                make().write.mode("overwrite").parquet(path)
            except Exception as e:
                self.add(step, "failed", error=f"{type(e).__name__}: {e}"[:500])
                pause = next(rest, None)
                if pause is None:
                    raise
                time.sleep(pause)
            else:
                self.add(step, "written", output=path)
                break
        return self.spark.read.parquet(path)
