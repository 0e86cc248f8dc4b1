"""Lineage cuts on storage that every executor shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only where that is unset and all runs in one process a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared folder and read it back.

    Columnar and compressed, so it costs far less disk than a row checkpoint, survives lost executors, and
    gives the next plan real sizes to choose joins by. The table goes with :func:`release`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gristmill-{name}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gristmill_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` (no-op for other frames)."""
    path = getattr(df, "_gristmill_path", None)
    if path:
        p, fs = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


def settle(spark: SparkSession) -> None:
    """Lets go of plans that are done: their shuffle files, broadcasts and the driver's heap stay until both sides of the driver collect their garbage.

    For work of many plans in a row, whose shared tables are written by then.
    """
    gc.collect()  # Python's names of frames hold plans in the JVM
    spark._jvm.System.gc()
