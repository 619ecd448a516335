"""Joins of numbers with ranges that may overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType


def _matches(values: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Pairs of values and ranges lo <= value < hi, which are finite. A range of width w is laid on cells of the next power of two, of which it
    touches two at most; a value looks for its cell on each level that has ranges, which are some dozens in all of
    double precision. So this is one join by equality, with an exact check, whatever the widths."""
    known = ranges.where(F.col(lo) < F.col(hi)).withColumn("__level", (F.floor(F.log2(F.col(hi).cast("double") - F.col(lo).cast("double"))) + 1).cast("int"))
    width = F.pow(F.lit(2.0), "__level")
    cell = lambda x: F.floor(x.cast("double") / width)
    known = known.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col(lo)), cell(F.col(hi))))))
    levels = [r[0] for r in known.select("__level").distinct().collect()]
    at = values.where(F.col(value).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("__cell", cell(F.col(value)))
    return at.join(known, ["__level", "__cell"]).where((F.col(lo) <= F.col(value)) & (F.col(value) < F.col(hi))).drop("__level", "__cell")


def all_ranges(df: DataFrame, value: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each row with each range [lo, hi) that holds its value; rows without one are left out. Empty ranges hold nothing. The result
    has a row for each pair; ``range_counts`` has what is counted over them without making them."""
    return _matches(df, value, ranges, lo, hi)


#: Which values of its cell a piece of a range holds: those from x on, those below x, or all.
SUFFIX, PREFIX, WHOLE = 0, 1, 2


def _cell(x: Column, kind: DataType) -> Column:
    """The cell of 2^__level that x is in; it never falls as x grows."""
    return F.call_function("shiftright", x.cast("bigint"), F.col("__level")) if isinstance(kind, IntegralType) else F.floor(x.cast("double") / F.pow(F.lit(2.0), "__level"))


def _swept(values: DataFrame, ranges: DataFrame, up: dict[str, Column], down: dict[str, Column]) -> DataFrame:
    """Rows of values (__x) and of ranges [__lo, __hi), both without repeats, with aggregates over the rows of their cell from the lowest up to them (``up``)
    and from the highest down to them (``down``). At equal x ranges come before values on the way up.

    A range of width w is laid on cells of a power of two between w / 4 and w / 2. Its ends are in different cells, so it is all
    values from its lower end on in one cell, all below its upper end in another, and all of up to four between. A value has a row on each level
    that has ranges. So a few rows for each range and some dozens for each value are sorted within their cells, and no pair is made."""
    kind = values.select("__x").union(ranges.select("__lo")).union(ranges.select("__hi")).schema[0].dataType
    x, lo, hi = (F.col(c).cast(kind) for c in ("__x", "__lo", "__hi"))
    exact = "decimal(20,0)" if isinstance(kind, IntegralType) else "double"
    width = (hi.cast(exact) - lo.cast(exact)).cast("double")
    level = F.when((width > 0) & (width < float("inf")), F.greatest(F.floor(F.log2(width)).cast("int") - 1, F.lit(0 if isinstance(kind, IntegralType) else -1074)))
    known = ranges.where(lo < hi).withColumn("__level", F.coalesce(level, F.raise_error(F.lit("a range is wider or narrower than doubles can tell")).cast("int")))
    levels = [r[0] for r in known.select("__level").distinct().collect()]
    first, last = _cell(lo, kind), _cell(hi, kind)
    piece = lambda cell, end, part: F.struct(cell.alias("__cell"), end.alias("__x"), F.lit(part).alias("__part"))
    between = F.when(last - first > 1, F.transform(F.sequence(first + 1, last - 1), lambda c: piece(c, F.lit(None).cast(kind), WHOLE)))
    pieces = F.concat(F.array(piece(first, lo, SUFFIX), piece(last, hi, PREFIX)), F.coalesce(between, F.array().cast(f"array<struct<__cell:bigint,__x:{kind.simpleString()},__part:int>>")))
    known = known.withColumn("__piece", F.explode(pieces)).select("*", "__piece.*").drop("__piece")
    at = values.where(F.col("__x").isNotNull()).withColumn("__x", x)
    at = at.where(~F.isnan("__x")) if isinstance(kind, DoubleType | FloatType) else at
    at = at.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("__cell", _cell(F.col("__x"), kind))
    w, is_value = Window.partitionBy("__level", "__cell"), F.col("__part").isNull()
    frame = lambda *order: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = at.unionByName(known, allowMissingColumns=True)
    rising, falling = frame(F.col("__x").asc_nulls_first(), is_value.asc()), frame(F.col("__x").desc_nulls_last(), is_value.desc())
    return both.select("*", *[c.over(rising).alias(name) for name, c in up.items()], *[c.over(falling).alias(name) for name, c in down.items()])


def range_counts(df: DataFrame, value: str, ranges: DataFrame, least: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each range [lo, hi) that holds a value of ``df``, with ``n``, how many rows it holds, and ``least``, the least of a column over
    them. Ranges are finite. Work grows with the different values and ranges, not with the pairs; those of a cell are sorted in one task."""
    values = df.groupBy(F.col(value).alias("__x")).agg(F.count("*").alias("__n"), F.min(least).alias("__least"))
    each = ranges.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi")).distinct()
    swept = _swept(values, each, {"__below": F.sum("__n"), "__least_below": F.min("__least")}, {"__above": F.sum("__n"), "__least_above": F.min("__least")}).where("__part is not null")
    below = F.col("__part") == PREFIX
    of = lambda name: F.when(below, F.col(f"{name}below")).otherwise(F.col(f"{name}above"))
    found = swept.groupBy("__lo", "__hi").agg(F.sum(of("__")).alias("n"), F.min(of("__least_")).alias("least")).where("n > 0")
    return ranges.join(found, (F.col(lo) == F.col("__lo")) & (F.col(hi) == F.col("__hi"))).drop("__lo", "__hi")


def first_range(df: DataFrame, value: str, ranges: DataFrame, order: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Every row with the columns of the first range by ``order`` that holds its value, or nulls. Distinct values are matched, and
    rows joined with what they found, so a value that very many rows have is matched once. Of equal ranges only the first goes on, and
    the first of all that hold a value comes from running minima over the ranges of its cells, so no pair is made. Ranges are finite."""
    columns = ranges.columns
    first = (F.struct(*columns), F.struct(order, lo, hi))
    each = ranges.groupBy(F.col(lo).alias("__lo"), F.col(hi).alias("__hi")).agg(F.min_by(*first).alias("__range"), F.min(first[1]).alias("__order"))
    below = F.when(F.col("__part").isin(SUFFIX, WHOLE), F.col("__order"))
    above = F.when(F.col("__part") == PREFIX, F.col("__order"))
    values = df.select(F.col(value).alias("__value"), F.col(value).alias("__x")).distinct()
    swept = _swept(values, each, {"__by_up": F.min(below), "__up": F.min_by("__range", below)}, {"__by_down": F.min(above), "__down": F.min_by("__range", above)}).where("__part is null")
    either = F.array(F.struct(F.col("__by_up").alias("by"), F.col("__up").alias("range")), F.struct(F.col("__by_down").alias("by"), F.col("__down").alias("range")))
    found = swept.select("__value", F.explode(either).alias("__best")).where("__best.by is not null")
    found = found.groupBy("__value").agg(F.min_by("__best.range", "__best.by").alias("__range"))
    return df.join(found, F.col(value) == F.col("__value"), "left").select(*df.columns, *[F.col(f"__range.{c}").alias(c) for c in columns])
