"""Operator 6, exact dedup: skew-safe combining of digest groups. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrysift.llm._common import Scratch, text_of, without_spaces
from quarrysift.operators.skew import join_groups
from quarrysift.session import spread

#: For ranking rows by (longest text, smallest id) in one number, which a hash aggregate can update in place.
_ID_BASE = Decimal(2**63)


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], digest: Callable[[Column], Column], *payload: Column) -> DataFrame:
    rows = spread(docs).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *payload)
    more = ["row"] if payload else []
    rows = rows.select("id", F.length("text").alias("chars"), normalise(F.col("text")).alias("norm"), *more)
    return rows.select("id", "chars", digest(F.col("norm")).alias("digest"), "norm", *more)


def _groups(rows: DataFrame, scratch: Scratch, salts: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One row (digest, keep_id, group_size) for each text; the digests of several texts; for these, the groups with their text."""
    base, wide = F.lit(_ID_BASE), F.lit(2 * _ID_BASE)
    rank = (F.col("chars").cast("decimal(18,0)") * wide).cast("decimal(38,0)") + (base - F.col("id").cast("decimal(20,0)"))
    salted = rows.select("digest", "norm", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), rank.cast("decimal(38,0)").alias("rank"))
    local = salted.groupBy("digest", "salt", "norm").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    merged = local.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    merged = merged.withColumn("keep_id", (base - F.pmod(F.col("rank"), wide)).cast("long"))
    texts = scratch.keep(merged.select("digest", "keep_id", "group_size"), "texts")
    clashing = texts.groupBy("digest").count().where("count > 1").select("digest")
    if clashing.isEmpty():
        return texts, None, None
    clashing = scratch.keep(clashing, "clashing")
    return texts, clashing, merged.join(clashing, "digest", "left_semi").select("digest", "norm", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = without_spaces, digest: Callable[[Column], Column] = _sha256, salts: int = 64, owner: Scratch | None = None) -> DataFrame:
    """Which row of each group of equal normalised texts stays.

    Equal texts combine in three stages, each grouped by digest and the full text: rows of one task (the map-side half of the
    first aggregate), rows of one (digest, salt), and the salts' winners of one digest. So a group with a third of all rows
    reaches each later stage as a few rows, and equal digests of different texts are never merged. Texts are not sent back:
    the documents find their group by digest, and only where one digest has several texts by text too.

    The row with the longest original text (code points), then the smallest id, stays. Ids are integers. Returns id_col,
    keep_id, group_size, kept, digest. Null text counts as empty; an empty table gives no rows; a repeated id with an equal
    text counts as that many members, all marked kept if the id is. A row without id stays only where no row of its group
    has one; keep_id is null then. Extra columns are ignored, whatever their names. The way back from groups to rows is salted
    for the groups that hold a thousandth of all rows or more.
    """
    rows = _rows(docs, id_col, text_col, normalise, digest)
    texts, clashing, full = _groups(rows, Scratch(docs.sparkSession, owner), salts)
    out = [F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"]
    light = rows.select("id", "digest")
    if clashing is None:
        return join_groups(light, texts, "digest", "group_size", salts).select(*out)
    clear = join_groups(light.join(clashing, "digest", "left_anti"), texts.join(clashing, "digest", "left_anti"), "digest", "group_size", salts).select(*out)
    return clear.unionByName(rows.join(clashing, "digest", "left_semi").join(full, ["digest", "norm"]).select(*out))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = without_spaces, digest: Callable[[Column], Column] = _sha256, salts: int = 64, owner: Scratch | None = None) -> DataFrame:
    """docs without the copies that exact_dedup drops, columns as they were; of rows that repeat an id and its text one stays.

    Rows meet their group by (digest, id), so the copies of one text spread over all tasks.
    """
    rows = _rows(docs, id_col, text_col, normalise, digest, F.struct("*").alias("row"))
    texts, clashing, full = _groups(rows, Scratch(docs.sparkSession, owner), salts)

    def winners(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
        by_id = lambda df, c: df.withColumns({"__id": F.coalesce(c, F.lit(0)), "__null": F.isnull(c)})  # noqa: E731  null ids meet too
        keys = [*keys, "__id", "__null"]
        met = by_id(rows, F.col("id")).join(by_id(groups, F.col("keep_id")).select(*keys), keys)
        once = Window.partitionBy(*keys).orderBy(F.desc("chars"))
        return met.withColumn("__n", F.row_number().over(once)).where("__n = 1").select("row.*")

    if clashing is None:
        return winners(rows.drop("norm"), texts, ["digest"])
    clear = winners(rows.join(clashing, "digest", "left_anti"), texts, ["digest"])
    return clear.unionByName(winners(rows.join(clashing, "digest", "left_semi"), full, ["digest", "norm"]))
