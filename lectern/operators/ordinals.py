"""Numbering rows, adding them up and carrying values along within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that are numbered together.
SPAN = 4096


def numbered(df: DataFrame, key: str, order: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds each row's place, from 0, in its group, by an integer column without repeats in a group.

    A group is cut in spans of the order column; spans are counted first, and only the rows of a
    span meet in a window, so a group with a third of all rows is spread like any other.
    """
    cut = df.withColumn("_span", F.floor(F.col(order) / span))
    counts = cut.groupBy(F.col(key).alias("_key"), F.col("_span").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_span").orderBy(order)) - 1
    joined = cut.withColumn("_inside", inside).join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_of")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))


def summed_before(df: DataFrame, key: str, order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds the sum of a column over the rows before each in its group, spread over spans in the same way."""
    cut = df.withColumn("_span", F.floor(F.col(order) / span))
    sums = cut.groupBy(F.col(key).alias("_key"), F.col("_span").alias("_of")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_key", "_of", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = cut.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_of")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))


def carried(df: DataFrame, key: str, order: str, value: Column, name: str, span: int = SPAN, own: bool = True, ties: tuple[str, ...] = (), backward: bool = False) -> DataFrame:
    """Adds the last value that is not null at or before each row of its group (own=False: before it), spread over spans in the same way.

    backward: the first one at or after it instead. ties: columns that order rows of equal `order`;
    these rows are always in one span.
    """
    sign = -1 if backward else 1
    turn = lambda c: F.col(c).desc() if backward else F.col(c).asc()
    cut = df.withColumn("_value", value).withColumn("_span", F.floor(F.col(order) / span))
    lasts = cut.filter("_value is not null").groupBy(F.col(key).alias("_key"), F.col("_span").alias("_of")).agg((F.min_by if backward else F.max_by)("_value", F.struct(order, *ties)).alias("_last"))
    # a span without a value has none to hand on, so each span is there
    every = cut.groupBy(F.col(key).alias("_k"), F.col("_span").alias("_s")).agg(F.lit(0).alias("_there"))
    spans = every.join(lasts, F.col("_k").eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_of")), "left")
    earlier = Window.partitionBy("_k").orderBy((F.col("_s") * sign).asc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("_k", "_s", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy(key, "_span").orderBy(*map(turn, (order, *ties))).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    joined = cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(starts, F.col(key).eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")))
    return joined.select(*df.columns, F.coalesce("_inside", "_before").alias(name))
