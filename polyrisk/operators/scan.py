"""Global places and running values without a window over the whole table.

Rows are sorted by ranges (sampled bounds, one task a range) and written with
their range and place in it.  What has to be carried from range to range is one
row each, so the driver adds up as many numbers as there are ranges.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyrisk.session import materialise

#: ``monotonically_increasing_id`` keeps the place in its lower 33 bits.
PLACE_BITS = 33


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in sorted ranges, as a table with columns _part and _place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", PLACE_BITS), F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)
    return materialise(ranged.withColumn("_part", part).withColumn("_place", place).drop("_id"), "ranges")


def _carried(placed: DataFrame, per_part: Column, kind: str, add) -> DataFrame:
    """``placed`` with _carry: ``add`` over the values ``per_part`` of all earlier ranges."""
    rows = placed.groupBy("_part").agg(per_part.cast(kind).alias("v")).orderBy("_part").collect()
    so_far = [None, *accumulate((r.v for r in rows), add)]
    table = placed.sparkSession.createDataFrame([(r._part, c) for r, c in zip(rows, so_far, strict=False)], f"_part bigint, _carry {kind}")
    return placed.join(F.broadcast(table), "_part")  # one row a range


def ranked(df: DataFrame, order: list[Column], name: str = "rank", start: int = 0) -> DataFrame:
    """``df`` with each row's place (from ``start``) under ``order``; ties as they fall."""
    placed = _carried(_placed(df, order), F.count(F.lit(1)), "bigint", lambda a, b: a + b)
    place = F.coalesce("_carry", F.lit(0)) + F.col("_place") + start
    return placed.withColumn(name, place.cast("int")).select(*[c for c in df.columns if c != name], name)


def running_min(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the smallest ``value`` of all rows up to each one under ``order``; nulls are no value."""
    kind = df.schema[value].dataType.simpleString()
    least = lambda a, b: b if a is None else a if b is None else min(a, b)
    placed = _carried(_placed(df, order), F.min(value), kind, least)
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn(name, F.least("_carry", F.min(value).over(within))).select(*[c for c in df.columns if c != name], name)
