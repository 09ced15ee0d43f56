"""Where iterative operators cut their lineage."""

from __future__ import annotations

import contextlib
import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch where the session leaves Spark's own number: texts are long, and a batch is held several times over.
ARROW_ROWS = "1000"
_shipped: set[str] = set()


def one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this library: by path where they run beside the driver, else from an archive of it that
    Spark hands to every executor. Arrow batches get smaller unless the session has a size of its own."""
    top = Path(__file__).resolve().parents[2]
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if one_process(spark):
        have = spark.sparkContext.environment.get("PYTHONPATH", "")
        if str(top) not in have.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = f"{top}:{have}" if have else str(top)
    elif spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='millrace-')}/millrace", "zip", top, Path(__file__).resolve().parents[1].name))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only where that is unset and all of Spark runs in
    this one process is it a temporary folder of our own; on a cluster nobody else would see one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._cut_at = path
    return made


def drop_cut(*frames: DataFrame) -> None:
    """Deletes what `cut` wrote for these frames; nothing read later may depend on them."""
    for df in frames:
        path = getattr(df, "_cut_at", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what `cut` has finished: it does so when the driver collects its garbage, which by
    itself may be long after. What the driver's JVM has freed then goes back to the system; a JVM that can't do so keeps it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(Exception):
        trim_native(spark)


def trim_native(spark: SparkSession) -> str:
    """Hands memory outside the heap that the driver's JVM holds but has freed back to the system: hundreds of MB after many
    compilations and threads. Returns what the JVM says of it; fails where it knows no such command (before JDK 17.0.9)."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    find = jvm.java.lang.Class.forName
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = find(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by the interface's method: the server's own class is not open to calls from outside
    return find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
