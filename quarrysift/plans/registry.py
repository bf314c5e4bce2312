"""How queries and their SQL are registered, and what both sides build code and names from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def template(text: str) -> str:
    """An expression, in both SQL dialects, of a text with {column} placeholders and line breaks."""
    parts = [p for p in re.split(r"(\{\w+\}|\n)", text) if p]
    quoted = lambda p: "chr(10)" if p == "\n" else f"CAST({p[1:-1]} AS STRING)" if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'"
    return " || ".join(map(quoted, parts)) or "''"


#: A repository name for each source, in both dialects, so that every kind of repository occurs.
REPO = (
    "CASE CAST(substr(source, 4) AS INT) % 8 WHEN 0 THEN 'django/django' WHEN 1 THEN 'pandas-dev/pandas' WHEN 2 THEN 'TheAlgorithms/Python' "
    "WHEN 3 THEN 'ansible/ansible' WHEN 4 THEN 'pytest-dev/pytest' WHEN 5 THEN 'pallets/click' WHEN 6 THEN 'Garvit244/Leetcode' ELSE 'someone/' || source END"
)
