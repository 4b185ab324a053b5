"""Intermediate tables, which also cut lineage.

They are written into the folder named by ``spark.checkpoint.dir`` (shared by driver and
executors) and read back, so a lost executor costs a re-read and never a recomputation of what
came before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

_OWN_DIR: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _OWN_DIR:
        _OWN_DIR[key] = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
        atexit.register(_remove_local, _OWN_DIR[key][7:])
    return _OWN_DIR[key]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Intermediate tables of one operator call, as Parquet files in the shared folder.

    Tables the result still reads stay until the application ends; those that are no longer
    needed are dropped with ``drop``.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexiquarry/{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop_all)

    def keep(self, frame: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        conf = self.spark.conf
        flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(flag, "false")
        conf.set(flag, "true")  # the shuffle files of a table that is now written serve no one
        try:
            frame.write.options(compression="zstd", **(options or {})).mode("overwrite").parquet(path)
        finally:
            conf.set(flag, before)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _quiet_drop_all(self) -> None:
        sc = self.spark.sparkContext
        if sc is not None and sc._jsc is not None and not sc._jsc.sc().isStopped():
            self.drop("")
