"""Session helpers of the operators: checkpoint folder, row identity, columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import NULL_ID


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is
    unset, as in local tests, a temporary folder of this machine is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as so many narrow rows need, so that small steps write few files."""
    return df.coalesce(max(8, rows // 100_000))


def shared_folder(spark: SparkSession) -> str:
    """The session's own part of the checkpoint folder, set up if need be."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to a new folder (the given one, if any) and read again."""
    path = path or new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written, whatever store it is in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Have Spark drop what no table needs any more: shuffles, broadcasts and, if so configured, checkpoints.

    Its cleaner learns of them when the driver's JVM collects garbage, which a
    driver that handles few rows does too late for the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back(spark)


def give_back(spark: SparkSession) -> None:
    """Return freed memory of the driver's two processes to the system, where their allocator (glibc's) can.

    Freed pieces of plans' code, messages and training stay with a process
    otherwise, and the driver's memory grows from stage to stage.
    """
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm, java = spark.sparkContext._jvm, spark.sparkContext._gateway
    with suppress(Py4JError, StopIteration):  # a command of some JVMs only
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = java.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def back_to_id(column: str) -> Column:
    return F.when(F.col(column) != F.lit(NULL_ID), F.col(column))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
