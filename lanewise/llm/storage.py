"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from .frames import give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and no cluster is used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"file://{tempfile.gettempdir()}/lanewise-checkpoints"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def release(spark: SparkSession) -> str:
    """Gives back what the driver holds and nothing refers to any more: Python's memory, the JVM's heap, with which Spark
    deletes the shuffle files of plans that are gone, and what the JVM's native allocator keeps after compiling, loading
    classes and unpacking.  Else all of it grows over a long session, as none is given back without being asked.  Returns
    what the JVM says of the last; nothing if it doesn't know that command."""
    give_back()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    named, own = jvm.java.lang.Class.forName, jvm.java.lang.Object
    kinds, given = array(jvm.java.lang.Class, 4), array(own, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = named(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(own, 0), array(jvm.java.lang.String, 0)
    try:
        # By reflection: the server's own class isn't public.
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given))
    except Py4JError:
        return ""


class Scratch:
    """Written tables of one run.  They outlive lost executors; drop() removes those that are no longer read, and what a
    result is still read from goes when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove)

    def _remove(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop("")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back, so that later steps neither recompute it nor carry its plan."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self, *names: str) -> None:
        """Deletes tables, and lets Spark delete the shuffle files of plans that nothing refers to any more; it does so
        when the driver's memory is collected, which may otherwise be long after the last use."""
        self.drop(*names)
        release(self.spark)
