"""Rates, bands and ordered numbering shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectlab.session import materialise


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def pct(part: Column, whole: Column) -> Column:
    """Percentage to an exact half-up tenth, from the whole numbers; 0.0 for an empty whole."""
    return F.when(
        whole > 0, F.floor((part.cast("bigint") * 2000 + whole) / (whole.cast("bigint") * 2)) / F.lit(10.0)
    ).otherwise(0.0)


def banded(value: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """The first band whose lower bound the value reaches."""
    out = F.lit(rest)
    for low, name in reversed(bands):
        out = F.when(value >= low, name).otherwise(out)
    return out


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys that may be null. The keys are those of the left side."""
    named = right.select(*[F.col(k).alias(f"__right_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"__right_{k}" for k in keys])


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """The rows with ``__slice``, which grows with keys and order; each slice is one range partition.

    Ranges hold about equally many rows, so a hot key is cut into as many slices as its share asks for. The table is
    written, since the numbers of slices must not change between the two reads of it.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*keys, *order]])
    return materialise(ranged.withColumn("__slice", F.spark_partition_id()), "slices")


def number_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", buckets: int | None = None
) -> DataFrame:
    """1-based number within each key group in ``order``, without bringing a group into one task. No keys: one group.

    Slices are numbered separately and moved up by the row counts of the slices before them, which come from a table of
    (group, slice) counts. Null keys are a group of their own.
    """
    sliced = ordered_slices(df, keys, order, buckets)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "__slice").agg(F.count("*").alias("__rows"))
        .select(*keys, "__slice", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = null_safe_join(sliced.withColumn("__at", F.row_number().over(inside)), offsets, [*keys, "__slice"])
    return numbered.withColumn(name, F.col("__at") + F.col("__before")).drop("__slice", "__at", "__before")


def previous_in_group(
    df: DataFrame, key: str, order: str, value: str, name: str = "previous", buckets: int | None = None
) -> DataFrame:
    """``value`` of the row before, per key in ``order``, without bringing a key into one task.

    Within an ordered slice this is ``lag``; a slice's first row takes the last value of the nearest slice before it.
    """
    sliced = ordered_slices(df, [key], [order], buckets)
    inside = Window.partitionBy(key, "__slice").orderBy(F.col(order).asc_nulls_first())
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        sliced.groupBy(key, "__slice").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(order)).alias("__last"))
        .select(key, "__slice", F.last("__last", ignorenulls=True).over(earlier).alias("__handed"))
    )
    first = F.row_number().over(inside) == 1
    lagged = sliced.withColumn("__lag", F.lag(value).over(inside)).withColumn("__first", first)
    return (
        null_safe_join(lagged, handed, [key, "__slice"])
        .withColumn(name, F.when(F.col("__first"), F.col("__handed")["v"]).otherwise(F.col("__lag")))
        .drop("__slice", "__lag", "__first", "__handed")
    )
