"""State of cases over micro-batches: what was seen, the last clock of each side, and how many rows were let through."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 24 * 3600 * 1000


class Cases(StatefulProcessor):
    """The state of one case: a list of its positions, to which a batch only appends its new ones and whose entries expire by
    themselves; and one value with the last clock of each side, the number of rows let through and when it was last seen. A
    case without rows for ``forget`` milliseconds is cleared by its timer, and if its next rows come before that, by them."""

    def __init__(self, base: float, increment: float, most: int, forget: int):
        self.base, self.increment, self.most, self.forget = base, increment, most, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "position string", ttlDurationMs=self.forget)
        self.last = handle.getValueState("last", "clock0 double, clock1 double, accepted bigint, at bigint")

    def _clear(self) -> None:
        self.seen.clear()
        self.last.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, known = timerValues.getCurrentProcessingTimeInMs(), self.last.get()
        if known is not None and now - known[3] > self.forget:
            self._clear()
            known = None
        *clocks, n = known[:3] if known is not None else (None, None, 0)
        firsts: dict[str, tuple] = {}
        for _, o, p, s, c in rows:
            at = (o is None, o or 0)
            if p not in firsts or at < firsts[p][0]:
                firsts[p] = (at, o, s, None if c is None or math.isnan(c) else c)
        if known is not None:
            for p, *_ in self.seen.get():
                firsts.pop(p, None)
        batch = sorted(firsts.items(), key=lambda x: x[1][0])
        if batch:
            self.seen.appendList([(p,) for p, _ in batch])
        out, room = [], max(self.most - n, 0)
        for _, (_, o, s, c) in batch:
            spent = None
            if s in (0, 1) and c is not None:
                before = self.base if clocks[s] is None else clocks[s]
                spent, clocks[s] = max(0.0, before - c + self.increment), c
            if len(out) < room:
                out.append(Row(k=key[0], order=o, spent=spent))
        if known is None:
            self.handle.registerTimer(now + self.forget)
        self.last.update((*clocks, n + len(out), now))
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A case that had rows since its timer was set waits for its new time."""
        known = self.last.get()
        due = known[3] + self.forget if known is not None else 0
        if due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
        else:
            self._clear()
        return iter(())

    def close(self) -> None:
        pass


def durable(spark: SparkSession) -> None:
    """Keeps the state of streams in RocksDB, which holds more than memory does, with changelogs as checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def accepted(stream: DataFrame, case: str, order: str, position: str, side: str, clock: str, base: float, increment: float, most: int, forget: int = 30 * DAY) -> DataFrame:
    """(case, order, spent) of the rows of a stream that are let through: of equal positions of a case the first, and ``most``
    rows of each case at most. ``spent`` is the side's last clock, at first ``base``, less the new one, plus the increment, at
    least 0; null where the clock is null.

    Repeated positions are dropped before clocks are looked at, so that the next duration spans them. Within a batch rows are
    taken by ``order``; later batches have to hold later rows of a case. Memory holds a case's
    distinct positions; what stays between batches is in the state store, and a batch writes no more than is new. A case is forgotten ``forget`` milliseconds after its last row. Null
    cases are one case; null positions are one position.
    """
    durable(stream.sparkSession)
    kind = stream.schema[case].dataType.simpleString()
    rows = stream.selectExpr(f"{case} as k", f"cast({order} as bigint) as o", f"coalesce(cast({position} as string), '') as p", f"cast({side} as int) as s", f"cast({clock} as double) as c")
    out = rows.groupBy("k").transformWithState(Cases(base, increment, most, forget), f"k {kind}, order bigint, spent double", "Append", "ProcessingTime")
    return out.withColumnRenamed("k", case)
