"""Incremental collection: a stream of programs against an index of content hashes that never expires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrysift.functions.text import content_hash
from quarrysift.operators.curate import anti_duplicate, dedup_exact


def distinct_programs(stream: DataFrame, code: str = "text") -> DataFrame:
    """A stream's programs, each content once. The state holds a hash for each program ever seen, as the index must."""
    return stream.withColumn("content_hash", content_hash(F.col(code))).dropDuplicates(["content_hash"])


def collect_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Takes what has arrived, appends what is new to a table, and ends."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()


def run_batches(stream: DataFrame, spark: SparkSession, index_path: str, log_path: str, checkpoint: str, seq: str, code: str = "text") -> None:
    """Each micro-batch joins the index by anti-join; a row in the log tells its state. A batch that is run again adds nothing.

    The index is partitioned by batch and a batch overwrites its own partition, so repeats are exact.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark.createDataFrame([(batch_id, "in_progress", 0)], "batch_id long, status string, added long").write.mode("append").json(log_path)
        try:
            index = spark.read.parquet(index_path).where(F.col("batch") != batch_id)
        except Exception as e:  # noqa: BLE001  the first batch has no index yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            index = spark.createDataFrame([], "content_hash string, batch long")
        new = anti_duplicate(dedup_exact(batch, content_hash(F.col(code)), seq).drop("content_hash"), index, content_hash(F.col(code)))
        path = f"{index_path}/batch={batch_id}"
        new.write.mode("overwrite").parquet(path)
        added = spark.read.parquet(path).count()
        spark.createDataFrame([(batch_id, "completed", added)], "batch_id long, status string, added long").write.mode("append").json(log_path)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
