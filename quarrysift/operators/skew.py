"""Joins of rows with their groups when one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot from this share of all rows on; so there are at most as many hot groups as the share's inverse.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, salts: int = 64) -> DataFrame:
    """rows with the columns of their group, by an inner join on key; groups is a written table with a row for each key.

    size is a column of groups: how many rows a key has. Keys with a thousandth of all rows or more, which are a thousand at
    most, are marked on the rows by a broadcast join; their rows are dealt to salts, their groups repeated for each salt.
    No task meets all rows of such a key.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]
    is_hot = F.col(size) * HOT >= F.lit(total)
    hot = groups.where(is_hot).select(F.col(key).alias("__hot"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left")
    salted = marked.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[rows[c] for c in rows.columns if c != key]), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    dealt = groups.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return salted.join(dealt, [key, "__salt"]).drop("__salt")
