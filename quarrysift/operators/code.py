"""Syntax-tree work on code columns, in Arrow batches: one parse of a row for all features, one for all rewrites.

Native filters on the code column (length, contains) run and are pushed below these functions by the optimizer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrysift.functions import codeast
from quarrysift.scratch import Scratch

FEATURES = "valid boolean, has_if boolean, has_loop boolean, has_switch boolean, complexity int, complexity_v1 int, defs int, primary_name string"


def code_features(code: Column) -> Column:
    """A struct of all that one parse tells; a null code is an empty one."""

    @F.pandas_udf(FEATURES)
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codeast.features(c or "") for c in codes], columns=list(codeast.features("")))

    return run(code)


def rewrite(code: Column, names: list[str], options: dict[str, dict] | None = None) -> Column:
    """struct(code, error): all rewrites of a request in one function, so that a row is parsed once."""

    @F.pandas_udf("code string, error string")
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codeast.transform_code(c or "", names, options) for c in codes], columns=["code", "error"])

    return run(code)


def pipeline_rewrite(code: Column, names: list[str] | None = None, include_core: bool = True, options: dict[str, dict] | None = None, keep: bool = False) -> Column:
    """struct(code, error) of the variant with the core rewrites, as codeast.pipeline_code."""

    @F.pandas_udf("code string, error string")
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codeast.pipeline_code(c or "", names, include_core, options, keep) for c in codes], columns=["code", "error"])

    return run(code)


def transform_dataset(df: DataFrame, names: list[str], code: str = "code", path: str | None = None, changed_only: bool = False, options: dict[str, dict] | None = None) -> DataFrame:
    """df with rewritten code, transformation_type, applied_transformers, transformation_error, and output_filename for a path.

    Rows without code go; changed_only keeps those whose text changed.
    """
    from quarrysift.functions.text import label_output_name, strip

    rows = df.where(strip(F.col(code)) != "").withColumn("__new", rewrite(F.col(code), names, options))
    if changed_only:
        rows = rows.where(strip(F.col("__new.code")) != strip(F.col(code)))
    out = rows.withColumns({code: F.col("__new.code"), "transformation_type": F.lit(names[0]), "applied_transformers": F.array(*[F.lit(n) for n in names]), "transformation_error": F.col("__new.error")}).drop("__new")
    return out.withColumn("output_filename", label_output_name(F.col(path), F.lit(names[0]))) if path else out


def process_dataset(df: DataFrame, names: list[str], owner: Scratch | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """transform_dataset, written once, as rows that were rewritten and rows that failed."""
    return split_errors(Scratch(df.sparkSession, owner).keep(transform_dataset(df, names, **params), "rewritten"))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were rewritten, and rows that failed."""
    return df.where("transformation_error IS NULL"), df.where("transformation_error IS NOT NULL")


def suitable(code: Column, features: Column, min_lines: int = 15, least: int = 5) -> Column:
    from quarrysift.functions.text import code_lines

    return (code_lines(code) >= min_lines) & (features["complexity"] >= least)


def complex_enough(code: Column, features: Column) -> Column:
    from quarrysift.functions.text import code_lines

    return (code_lines(code) >= 10) & features["valid"] & (features["defs"] >= 1) & (features["complexity_v1"] >= 5)


def _exploded(df: DataFrame, code: str, schema: str, run) -> DataFrame:
    """df's other columns with the structs that run(code) lists, one row each."""

    @F.pandas_udf(f"array<struct<{schema}>>")
    def listed(codes: pd.Series) -> pd.Series:
        return pd.Series([run(c or "") for c in codes])

    others = [c for c in df.columns if c != code]
    return df.withColumn("__s", F.explode(listed(F.col(code)))).select(*others, "__s.*")


def split_top_level(df: DataFrame, code: str = "code") -> DataFrame:
    """One row (function, code) for each top-level function; the whole text, without a name, if there is none."""
    return _exploded(df, code, "function: string, code: string", lambda c: [{"function": n, "code": t} for n, t in codeast.split_top_level(c)])


def extract_functions(df: DataFrame, code: str = "code") -> DataFrame:
    return _exploded(df, code, "function_name: string, code: string, line_range: string, docstring: string", codeast.extract_functions)


def slice_functions(df: DataFrame, code: str = "code") -> DataFrame:
    return _exploded(df, code, "function: string, code: string, needed_consts: array<string>, dropped_consts: array<string>, stubbed_helpers: array<string>, imports_included: int, lines_out: int", codeast.slice_functions)


@F.udtf(returnType="function string, code string, needed_consts array<string>, dropped_consts array<string>, stubbed_helpers array<string>, imports_included int, lines_out int", useArrow=True)
class SliceFunctions:
    """slice_functions as a table function, for SQL with LATERAL."""

    def eval(self, code: str):
        for s in codeast.slice_functions(code or ""):
            yield tuple(s.values())


@F.pandas_udf(T.StringType())
def rewrite_code(codes: pd.Series, names: pd.Series) -> pd.Series:
    """One rewrite for each row, by name."""
    return pd.Series([codeast.transform_code(c or "", [n])[0] for c, n in zip(codes, names)])


def register(spark) -> None:
    """Table functions and the plain rewriter for SQL, both in Arrow batches."""
    spark.udtf.register("slice_functions", SliceFunctions)
    spark.udf.register("rewrite_code", rewrite_code)
