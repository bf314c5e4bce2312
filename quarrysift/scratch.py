"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on one machine (a local master) may it be unset: a temporary one then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quarrysift-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor then costs a reread, not a recomputation.

    drop() removes a table as soon as nothing reads it any more. The others, which a lazy result may still need, go when the
    owner closes the scratch, or at the latest when the driver ends: `with Scratch(spark) as own:` around all uses of results
    of operators that got `own` as their owner.
    """

    def __init__(self, spark: SparkSession, owner: Scratch | None = None):
        self.spark, self.paths = spark, {}
        self.root = f"{owner.root if owner else shared_folder(spark) + '/quarrysift'}/{uuid.uuid4().hex}"
        if owner is None:
            atexit.register(self.close)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.paths.pop(name))

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._remove(self.root)
        except Exception:  # noqa: BLE001  the session has ended already; its folder is the cluster's to clean
            pass
