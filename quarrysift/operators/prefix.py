"""Distributed prefix sums in the order of a hash key, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RANGE, _COARSE, _SUM = "__range", "__coarse", "__sum"


def hash_key(*parts: Column) -> Column:
    """A random but repeatable sort key in hex; its first digits deal rows into ranges of equal size."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(_COARSE, F.substring(key, 1, 2)).withColumn(_RANGE, F.substring(key, 3, 2))


def range_sums(df: DataFrame, group: str, key: str, weight: str) -> DataFrame:
    """The sum of weight in each range of each group; what sums_before starts from."""
    return _dealt(df, key).groupBy(group, _COARSE, _RANGE).agg(F.sum(weight).alias(_SUM))


def group_sums(fine: DataFrame, group: str, out: str) -> DataFrame:
    return fine.groupBy(group).agg(F.sum(_SUM).alias(out))


def sums_before(df: DataFrame, fine: DataFrame, group: str, key: str, weight: str, ties: list[str], out: str) -> DataFrame:
    """df with out: the sum of weight over the rows of the same group that come before in the order of key, then ties.

    group must not be null; key is hex; fine is range_sums of the same rows. Range partitioning by key digits: a group,
    however large, is cut into 65,536 ranges by its first four digits. Sums run over the ranges of 256 coarse ranges, the
    coarse ranges of the group, and the rows of one range, so no task meets a whole group.
    """
    up_to = lambda part, order: F.sum(_SUM).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(_SUM)
    high = fine.groupBy(group, _COARSE).agg(F.sum(_SUM).alias(_SUM)).select(group, _COARSE, up_to([group], _COARSE).alias("__high"))
    low = fine.select(group, _COARSE, _RANGE, up_to([group, _COARSE], _RANGE).alias("__low"))
    starts = low.join(high, [group, _COARSE]).select(group, _COARSE, _RANGE, (F.col("__low") + F.col("__high")).alias("__start"))
    rows = Window.partitionBy(group, _COARSE, _RANGE).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = _dealt(df, key).join(starts, [group, _COARSE, _RANGE])
    return joined.withColumn(out, F.col("__start") + F.sum(weight).over(rows) - F.col(weight)).drop(_COARSE, _RANGE, "__start")
