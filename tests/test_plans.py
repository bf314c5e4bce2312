"""What the plans look like: columns and filters reach the scan, native operators stay native, nothing multiplies rows."""

import pytest

import __spark_entry__ as entry
from quarrysift.plans import code_queries, record_queries, relational_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES = entry.catalog.QUERIES
#: Queries that need a provider.
PYTHON = {"generate_specs"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = sorted(n for n, q in QUERIES.items() if q.__module__ in (text_queries.__name__, record_queries.__name__, relational_queries.__name__) and n not in PYTHON)


@pytest.mark.parametrize("name", NATIVE)
def test_native(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(x in text for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct"))


def test_pushdown(spark):
    text = plan(QUERIES["repo_count"](spark, SF))
    assert "EqualTo(source,src3)" in text and "ReadSchema: struct<source:string>" in text
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(QUERIES["running_quota"](spark, SF))


def test_native_filter_below_python(spark):
    """Rows without code never reach Python: the filter is below the rewriting."""
    from pyspark.sql import functions as F

    from quarrysift.operators.code import transform_dataset

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("code"))
    text = plan(transform_dataset(docs.where(F.col("code").contains("def ")), ["if_invert"]))
    assert "StringContains(text,def )" in text and text.index("ArrowEvalPython") < text.index("Filter")


def test_rank_limits_come_before_the_shuffle(spark):
    assert plan(QUERIES["running_quota"](spark, SF)).count("WindowGroupLimit") == 2


def test_rewrites_are_one_function(spark):
    assert plan(QUERIES["transform_dataset"](spark, SF)).count("ArrowEvalPython") == 1 and code_queries.REWRITES
