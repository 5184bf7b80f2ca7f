"""Reliable lineage barriers: what an iteration keeps is written to the cluster's shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

_PLANNING = threading.RLock()


def shared_folder(spark: SparkSession) -> str:
    """The application's folder within the session's spark.checkpoint.dir; a temporary one only on one machine, where none is named (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/vertexflow-shared"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def planned_with(spark: SparkSession, setting: str, value: str):
    """A setting of the planner for the actions within. Those of one session wait for each other."""
    with _PLANNING:
        old = spark.conf.get(setting)
        spark.conf.set(setting, value)
        try:
            yield
        finally:
            spark.conf.set(setting, old)


def barrier(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, in the partitions that its plan has.

    Planned without adaptive execution: an adaptive plan's partitioning is unknown to what reads the checkpoint, a static one's is
    known, so the next join by the same key moves only the messages, not the state. Barriers of one session wait for each other.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with planned_with(spark, "spark.sql.adaptive.enabled", "false"):
        out = df.checkpoint(eager=True)
    out._vf_barrier = True
    return out


def drop_barrier(df: DataFrame) -> None:
    """Deletes the files of a barrier whose rows nothing reads any more."""
    if getattr(df, "_vf_barrier", False):
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
