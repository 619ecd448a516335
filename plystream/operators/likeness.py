"""Likeness of predicted and true sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _grams(c: Column, n: int) -> Column:
    size = F.size(c)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws("\x1f", F.slice(c, i, n)))


def bleu(df: DataFrame, key: str, pred: str, true: str, most: int = 4) -> DataFrame:
    """BLEU of each pair of arrays of strings with n-grams up to the shorter length, ``most`` at most: (key, bleu).

    Counts are clipped by grouping n-grams, so long sequences are not one task's work. Without a common word the score is
    0; other counts of 0 become 0.1. Pairs with an empty or null side are left out; keys must be unique."""
    d = df.where((F.size(pred) > 0) & (F.size(true) > 0)).select(F.col(key).alias("k"), F.col(pred).alias("p"), F.col(true).alias("t"))
    sides = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s"), _grams(F.col(s), n).alias("g")) for n in range(1, most + 1) for s in "pt"])
    long = d.select("k", F.explode(sides).alias("x")).select("k", "x.n", "x.s", F.explode("x.g").alias("g"))
    each = long.groupBy("k", "n", "g").agg(F.count_if(F.col("s") == "p").alias("p"), F.count_if(F.col("s") == "t").alias("t"))
    both = each.groupBy("k", "n").agg(F.sum(F.least("p", "t")).alias("common"))
    wide = both.groupBy("k").agg(*[F.coalesce(F.max(F.when(F.col("n") == n, F.col("common"))), F.lit(0)).alias(f"c{n}") for n in range(1, most + 1)])
    d = d.select("k", F.size("p").alias("np"), F.size("t").alias("nt")).join(wide, "k")
    top = F.least(F.lit(most), F.col("np"), F.col("nt"))
    logs = sum((F.when(top >= n, F.ln(F.when(F.col(f"c{n}") == 0, 0.1).otherwise(F.col(f"c{n}")) / (F.col("np") - n + 1))).otherwise(0.0) for n in range(1, most + 1)), F.lit(0.0))
    brevity = F.when(F.col("np") > F.col("nt"), 1.0).otherwise(F.exp(1 - F.col("nt") / F.col("np")))
    return d.select(F.col("k").alias(key), F.when(F.col("c1") == 0, 0.0).otherwise(brevity * F.exp(logs / top)).alias("bleu"))


#: Cells of the tables of one lot of pairs.
CELLS = 1 << 22


def _banded(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, band: int) -> np.ndarray:
    """Distances of pairs, a row of symbols each, counted from 0 in each pair and padded by -1 and -2, that are ``band`` or less; what is
    larger comes out larger than ``band``. Cells further than that from the diagonal are never filled. All pairs are filled
    row by row at once; within a row, insertions are a running minimum."""
    n, rows = a.shape
    width, far = 2 * band + 1, np.int32(1 << 29)
    table = np.full((n, rows + 1, width + 1), far, np.int32)  # the last column stands for what lies beyond the band
    offset, each = np.arange(width) - band, np.arange(n)[:, None]
    table[:, 0, :width] = np.where(offset >= 0, offset, far)
    last = np.zeros((n, a.shape[1] + b.shape[1] + 1), np.int32)
    out = np.where(la == 0, lb, far).astype(np.int32)
    for i in range(1, rows + 1):
        j = i + offset
        inside = (j >= 1) & (j <= b.shape[1])
        y = np.where(inside, b[:, np.clip(j - 1, 0, max(b.shape[1] - 1, 0))], -2)
        x = a[:, i - 1][:, None]
        before = table[:, i - 1]
        cost = np.minimum(before[:, :width] + (x != y), before[:, 1:] + 1)
        # swaps: the last row before with the symbol of this column, and the last column before with the symbol of this row
        k = last[each, np.maximum(y, 0)]
        match = np.where(x == y, j, 0)
        swap = np.maximum.accumulate(np.concatenate([np.zeros((n, 1), match.dtype), match[:, :-1]], axis=1), axis=1)
        # matches left of the band need more edits than it has
        able = inside & (y >= 0) & (k > 0) & (swap > 0)
        at = np.where(able, (swap - 1) - (k - 1) + band, width)
        at = np.where((at >= 0) & (at < width), at, width)
        cost = np.minimum(cost, np.where(able, table[each, np.maximum(k - 1, 0), at] + (i - k) + (j - swap) - 1, far))
        cost = np.where(inside, cost, far)
        if i <= band:
            cost[:, band - i] = i  # the first column
        table[:, i, :width] = np.minimum(np.minimum.accumulate(cost - offset, axis=1) + offset, far)
        table[:, i, :width] = np.where(inside | (j == 0), table[:, i, :width], far)
        last[each[:, 0], np.maximum(a[:, i - 1], 0)] = np.where(a[:, i - 1] >= 0, i, last[each[:, 0], np.maximum(a[:, i - 1], 0)])
        done = np.flatnonzero(la == i)
        end = lb[done] - i + band
        out[done] = np.where((end >= 0) & (end < width), table[done, i, np.clip(end, 0, width)], far)
    return out


def distances(pairs: list[tuple]) -> np.ndarray:
    """Damerau-Levenshtein distances of pairs of strings or arrays: insertions, deletions, changes and swaps of neighbours; text may be
    edited between the swapped ones. Each pair is filled in a band around the diagonal that is doubled until the distance fits
    in, so a pair of length n and distance d takes n d steps, and pairs of like lengths are filled together."""
    out = np.zeros(len(pairs), np.int64)
    open_ = [k for k, (x, y) in enumerate(pairs) if not (len(x) == len(y) and list(x) == list(y))]
    band = dict.fromkeys(open_, 4)
    while open_:
        open_.sort(key=lambda k: (band[k], len(pairs[k][0]), len(pairs[k][1])))
        again, lo = [], 0
        while lo < len(open_):
            hi, wide = lo, 2 * band[open_[lo]] + 1
            while hi < len(open_) and band[open_[hi]] == band[open_[lo]] and (hi == lo or (hi - lo + 1) * (len(pairs[open_[hi]][0]) + 1) * wide <= CELLS):
                hi += 1
            lot = open_[lo:hi]
            la, lb = (np.array([len(pairs[k][s]) for k in lot]) for s in (0, 1))
            a, b = np.full((len(lot), la.max()), -1, np.int32), np.full((len(lot), lb.max()), -2, np.int32)
            for r, k in enumerate(lot):
                code: dict = {}
                x, y = ([code.setdefault(c, len(code)) for c in side] for side in pairs[k])
                a[r, : len(x)], b[r, : len(y)] = x, y
            found = _banded(a, b, la, lb, band[lot[0]])
            for k, d in zip(lot, found.tolist(), strict=True):
                if d <= band[k]:
                    out[k] = d
                else:
                    band[k] *= 2
                    again.append(k)
            lo = hi
        open_ = again
    return out


@F.pandas_udf(LongType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    """Damerau-Levenshtein distance of two strings or arrays; null if either is."""
    whole = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    out = pd.Series([None] * len(a), dtype="Int64")
    out.iloc[whole] = distances([(a.iloc[k], b.iloc[k]) for k in whole])
    return out


def similarity(df: DataFrame, pred: str, true: str, size=F.char_length) -> DataFrame:
    """One row: the mean of 1 - distance / longer length, and the share of equal pairs. Pairs with both sides empty or null
    are left out; one empty side gives 0. Only distinct pairs that differ are sent to Python."""
    p, t = (F.coalesce(size(F.col(c)), F.lit(0)) for c in (pred, true))
    pairs = df.where((p > 0) | (t > 0)).groupBy(F.col(pred).alias("p"), F.col(true).alias("t")).agg(F.count("*").alias("n"))
    equal = F.coalesce(F.col("p") == F.col("t"), F.lit(False)).cast("int")
    p, t = (F.coalesce(size(F.col(c)), F.lit(0)) for c in "pt")
    uneven = pairs.where((equal == 0) & (p > 0) & (t > 0)).select("n", (1 - damerau(F.col("p"), F.col("t")) / F.greatest(p, t)).alias("s"), F.lit(0).alias("e"))
    easy = pairs.where((equal == 1) | (p == 0) | (t == 0)).select("n", equal.cast("double").alias("s"), equal.alias("e"))
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("n")) / F.sum("n"), F.lit(0.0))
    return uneven.unionByName(easy).agg(mean("s").alias("similarity"), mean("e").alias("exact"))
