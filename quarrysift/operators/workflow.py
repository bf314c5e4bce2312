"""The whole way of a program: collected, cleaned, rewritten, specified, extracted, verified, reported.

Each step is a written table that the next one reads, so a lost executor or a later failure costs one step at most, and a
run can stop after any step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrysift.functions import text as X
from quarrysift.operators import cache, curate, metrics
from quarrysift.operators.code import transform_dataset
from quarrysift.scratch import Scratch
from quarrysift.sources.providers import SpecProvider, Verifier

STEPS = ["collect", "cleanup", "transform", "specify", "extract", "verify", "report"]


def verified(rows: DataFrame, verifier: Verifier, code: str) -> DataFrame:
    """rows with what the verifier says of their code: exit_code, output, messages, and flags from the output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = verifier.verify(list(b[code]))
            yield b.assign(exit_code=[c for c, _ in found], output=[o for _, o in found])

    schema = T.StructType([*rows.schema.fields, T.StructField("exit_code", T.IntegerType()), T.StructField("output", T.StringType())])
    out = rows.mapInPandas(run, schema).withColumn("log", X.parse_log(F.col("output")))
    of = lambda *kinds: F.size(F.filter("log", lambda e: e["d"]["type"].isin(*kinds))).cast("int")
    out = out.withColumns({"n_parse_errors": of("parse_error", "generic_error"), "n_verification_errors": of("verification_error"), "messages": F.transform("log", lambda e: e["d"]["message"])}).drop("log")
    flags = {"verified": X.verified_flag(F.col("exit_code"), F.col("output")) & X.verified_strict(F.col("output")), "compilation_success": X.compilation_flag(F.col("exit_code"), F.col("output"), F.col("n_parse_errors"))}
    return out.withColumns(flags)


def run(programs: DataFrame, provider: SpecProvider, verifier: Verifier, rewrites: list[str], stored: DataFrame | None = None, until: str = "report", owner: Scratch | None = None) -> dict[str, DataFrame]:
    """The table of every step up to `until`, by name.

    programs: (id, path, code, seq). collect keeps the first program of each content, cleanup those with code, transform adds
    the rewritten code (failed rewrites are a table of their own, `failed`), specify a specification from the cache `stored`
    or the provider, extract the specification's code with its fixes and header, verify what the verifier says; report is one
    row of totals, `categories` the messages by category.
    """
    spark = programs.sparkSession
    scratch, steps = Scratch(spark, owner), {}

    def step(name: str, df: DataFrame) -> DataFrame:
        steps[name] = scratch.keep(df, name)
        return steps[name]

    wanted = STEPS[: STEPS.index(until) + 1]
    rows = step("collect", curate.dedup_exact(programs, X.content_hash(F.col("code")), "seq"))
    if "cleanup" in wanted:
        rows = step("cleanup", rows.withColumn("code", X.strip(F.col("code"))).where("code <> ''"))
    if "transform" in wanted:
        both = step("transform", transform_dataset(rows, rewrites, path="path"))
        steps["failed"], rows = both.where("transformation_error IS NOT NULL"), both.where("transformation_error IS NULL")
    if "specify" in wanted:
        hashed = rows.withColumn("code_hash", X.content_hash(F.col("code")))
        known = stored if stored is not None else spark.createDataFrame([], "code_hash string, spec_type string, created_at long, spec string")
        rows = step("specify", cache.generate(hashed, known, provider, "code", "full"))
    if "extract" in wanted:
        name = F.concat(X.sanitize_filename(F.col("path")), F.lit(".dfy"))
        rows = step("extract", rows.withColumns({"program": X.fix_common_errors(X.extract_blocks(F.col("spec"))), "program_file": name}).where("program <> ''"))
        rows = rows.withColumn("program_text", X.add_header(F.col("path"), F.col("program")))
    if "verify" in wanted:
        rows = step("verify", verified(rows, verifier, "program"))
    if "report" in wanted:
        step("report", metrics.verify_summary(rows.withColumn("verification_time", F.lit(0.0))))
        step("categories", metrics.category_counts(metrics.categorized(rows.select(F.explode("messages").alias("message")), "message")))
    return steps
