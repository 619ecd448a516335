"""Exact quantiles in bounded memory, by selection in several passes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values that are looked at one by one, and the inverse of the sketch's error in rank.
FEW, SHARP = 50_000, 10_000


def _at(counted: list, rank: int) -> float:
    """The value of a rank in rows of values and their counts, in order."""
    for x, n in counted:
        if rank < n:
            return x
        rank -= n
    raise AssertionError("the rank lies beyond the values")


def _ranked(values: DataFrame, ranks: list[int], n: int, few: int, sharp: int) -> dict[int, float]:
    """The values of these ranks, from 0, of ``n`` rows, all in the same passes. A sketch gives two values for each rank that hold it
    between them, then what lies below, at and between them is counted exactly. A rank ends at one of its two values or goes on
    with what lies strictly between, about a few ``sharp``-ths of the rows: these are looked at one by one if they are
    ``few``, and go through the same again otherwise."""
    x = F.col("x")
    counts = lambda rows: [(r["x"], r["count"]) for r in rows.groupBy("x").count().orderBy("x").collect()]
    if n <= few:
        counted = counts(values)
        return {rank: _at(counted, rank) for rank in ranks}
    e = 2 / sharp
    asked = [min(max((rank + 0.5) / n + d, 0.0), 1.0) for rank in ranks for d in (-e, e)]
    given = values.agg(F.percentile_approx("x", asked, sharp)).first()[0]
    pairs = list(zip(given[::2], given[1::2], strict=True))
    found = values.agg(*[c for lo, hi in pairs for c in (F.count_if(x < lo), F.count_if(x == lo), F.count_if((x > lo) & (x < hi)), F.count_if((x == hi) & (x > lo)))]).first()
    out, small = {}, []
    for k, (rank, (lo, hi)) in enumerate(zip(ranks, pairs, strict=True)):
        below, at_lo, between, at_hi = found[4 * k : 4 * k + 4]
        inside = rank - below - at_lo
        if 0 <= rank - below < at_lo:
            out[rank] = lo
        elif 0 <= inside < between and between <= few:
            small.append((rank, lo, hi, inside))
        elif 0 <= inside < between:
            out[rank] = _ranked(values.where((x > lo) & (x < hi)), [inside], between, few, sharp)[inside]
        elif between <= inside < between + at_hi:
            out[rank] = hi
        elif rank < below:  # only if the sketch errs by more than it promises
            out[rank] = _ranked(values.where(x < lo), [rank], below, few, sharp)[rank]
        else:
            over = below + at_lo + between + at_hi
            out[rank] = _ranked(values.where(x > hi), [rank - over], n - over, few, sharp)[rank - over]
    if small:
        counted = counts(values.where(reduce(or_, ((x > lo) & (x < hi) for _, lo, hi, _ in small))))
        out |= {rank: _at([(v, c) for v, c in counted if lo < v < hi], inside) for rank, lo, hi, inside in small}
    return out


def exact(df: DataFrame, value: str, probabilities: list[float], few: int = FEW, sharp: int = SHARP) -> list[float | None]:
    """Exact quantiles of a column with linear interpolation between ranks, p (n - 1); nulls and NaN are left out.
    Without values they are null. Never more than ``few`` rows of a rank come together, where a plain median holds all
    distinct values in one task; the column is read four times for any number of quantiles, more only beyond 10^8 rows."""
    values = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = values.count()
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    found = _ranked(values, sorted({r for at in places for r in (int(at), min(int(at) + 1, n - 1))}), n, few, sharp)
    ends = [(found[int(at)], found[min(int(at) + 1, n - 1)], at - int(at)) for at in places]
    return [lo if lo == hi else lo + part * (hi - lo) for lo, hi, part in ends]


def median(df: DataFrame, value: str) -> float | None:
    return exact(df, value, [0.5])[0]
