"""Tables that cut lineage: written as Parquet to the folder that driver and executors share.

A lost executor costs only the tasks of the stage that runs, never what such a table holds.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallywright.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallywright-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("tallywright.scratch", found)
    return found


class Scratch:
    """Names the tables of one operator run and removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def write(self, df: DataFrame, name: str, schema=None) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema or df.schema).parquet(path)
        out._scratch_path = path
        self.release()
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of jobs that are over: it does when their plans are garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            path, fs = self._fs(t._scratch_path)
            fs.delete(path, True)
