"""The specification cache: a table keyed by (code_hash, spec_type), with the time of each entry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(entries: DataFrame, spec_type: str | None = None) -> DataFrame:
    """The last entry of each key; an aggregate, so a key written often costs one row for each task."""
    rows = entries.where(F.col("spec_type") == spec_type) if spec_type else entries
    best = rows.groupBy("code_hash", "spec_type").agg(F.max_by(F.struct("created_at", "spec"), "created_at").alias("e"))
    return best.select("code_hash", "spec_type", "e.created_at", "e.spec")


def lookup(rows: DataFrame, entries: DataFrame, legacy: DataFrame, spec_type: str) -> DataFrame:
    """rows with spec and origin: cache, else legacy, else miss. legacy has one row (code_hash, spec) a hash."""
    new = latest(entries, spec_type).select("code_hash", F.col("spec").alias("__new"))
    old = legacy.select("code_hash", F.col("spec").alias("__old"))
    joined = rows.join(new, "code_hash", "left").join(old, "code_hash", "left")
    origin = F.when(F.col("__new").isNotNull(), "cache").when(F.col("__old").isNotNull(), "legacy").otherwise("miss")
    return joined.withColumns({"spec": F.coalesce("__new", "__old"), "origin": origin}).drop("__new", "__old")


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new entries in place of older ones of the same key."""
    return latest(entries.unionByName(new))


def migrate(entries: DataFrame, legacy: DataFrame) -> DataFrame:
    """The table, or the legacy rows where it is empty."""
    some = entries.agg((F.count(F.lit(1)) > 0).alias("__some"))
    return entries.unionByName(legacy.crossJoin(F.broadcast(some)).where("NOT __some").drop("__some").select(*entries.columns))


def totals(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("specifications"), F.round(F.sum("cost"), 6).alias("total_cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("total_tokens"))


def export(rows: DataFrame, session: str, fields: list[str], order: str) -> DataFrame:
    """A row for each session with its specifications in order; a session is one exported document."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("s"))))
    return rows.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.transform(listed, lambda x: x["s"]).alias("specifications"))


def generate(rows: DataFrame, entries: DataFrame, provider, code: str, spec_type: str) -> DataFrame:
    """rows with spec and origin: from the cache, and for the others from the provider, in batches on the executors."""
    found = rows.join(latest(entries, spec_type).select("code_hash", "spec"), "code_hash", "left")
    hits = found.where("spec IS NOT NULL").withColumn("origin", F.lit("cache"))
    missing = found.where("spec IS NULL").drop("spec")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(spec=provider.specify(list(b[code])), origin="generated")

    schema = T.StructType([*missing.schema.fields, T.StructField("spec", T.StringType()), T.StructField("origin", T.StringType())])
    return hits.unionByName(missing.mapInPandas(run, schema))
