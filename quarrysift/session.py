"""Session defaults shared by tests, the benchmark and local runs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution re-plans skewed and small joins at run time; UTC keeps timestamps comparable across engines.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", app: str = "quarrysift", driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A local[cores] session with the defaults above; conf overrides, with dots as they are."""
    os.environ.setdefault("TZ", "UTC")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", driver_memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder they start in.

    On clusters whose machines don't have that folder the package is installed or sent with --py-files instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    try:
        environment = spark.sparkContext.environment
    except Exception:  # noqa: BLE001  a remote session has no context here
        return
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is a plain scan with fewer tasks than there are cores (files of one row group); else as it is.

    For work that costs much more than moving the rows. Large inputs have more tasks than cores and aren't moved.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return df
    return df.repartition(cores) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
