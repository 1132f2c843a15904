"""Where operators keep intermediate tables: the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from . import flat

KEY = "spark.checkpoint.dir"
#: Bytes of an Arrow batch between Spark and Python, about.
BATCH = str(4 << 20)


def shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own in local sessions that name none."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="murmurate-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes at most: rows hold whole texts, and the default of 10,000 rows would make batches as long as the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and a lost executor costs no more than a task."""
    path = new_path(df.sparkSession, name)
    bounded_batches(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what keep() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_kept_at", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def rest(spark: SparkSession) -> None:
    """Driver: Python and the JVM collect their garbage and hand freed memory back to the system; Spark then forgets broadcasts and shuffles of jobs that are over.

    A driver that starts hundreds of jobs and broadcasts otherwise keeps what its heap and its threads' native memory once grew to.
    """
    gc.collect()  # Python's references hold Java's objects
    flat.trim()
    spark.sparkContext._jvm.System.gc()
    _trim_jvm(spark)


def _trim_jvm(spark: SparkSession) -> str:
    """What the JVM says to its own trim of native memory; empty where it has none (before 17.0.9, or not HotSpot on Linux)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    named = jvm.java.lang.Class.forName
    try:  # by the interface's method: the server's class is hidden from Py4J
        signature = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = named("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, *signature))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return str(invoke.invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))))
    except Py4JError:
        return ""
