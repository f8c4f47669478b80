"""Durable intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs the tasks that were running, never a finished
stage.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_OWN: list[str] = []
_MADE: list[Scratch] = []


@atexit.register
def _sweep() -> None:
    """Delete what this driver made: nothing that reads it outlives the driver."""
    for scratch in _MADE:
        try:
            scratch.drop("")
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of a local
    session, whose tasks share one machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="textkeel-"))
        root = _OWN[0]
    return root.rstrip("/")


class Scratch:
    """A folder for the intermediate tables of one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.tag = f"{label}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_root(spark)}/textkeel/{self.tag}"
        _MADE.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        # row groups are buffered in memory, by every task
        df.write.mode("overwrite").options(compression="zstd", **{"parquet.block.size": str(16 << 20)}).parquet(self.path(name))
        self.release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark delete shuffle files of finished jobs, which it does when their handles are collected."""
        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(0.2)  # deletion follows collection a little later

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more (the whole folder, if unnamed)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, for scans the size of the files; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target_bytes: int = 12 << 20) -> int:
    """Enough partitions for tasks of a bounded size, at least the session's own
    number. Of frames that are no file scans Spark knows no size (the estimate is
    astronomic); they get the session's number."""
    own, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return max(own, size // target_bytes) if size < 1 << 50 else own


_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory of this process back to the system. Python workers are reused, and what
    they keep counts against the executor's memory while they idle."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


def prepare_python(spark: SparkSession, rows: int = 400) -> None:
    """Ship the package, and keep an Arrow batch of long texts small enough for a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
