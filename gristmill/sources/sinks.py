"""Sinks that refuse existing output and install all or nothing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def refuse_existing(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)


def write_csv(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    (df.orderBy(*order_by) if order_by else df).write.mode("errorifexists").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_manifest(df: DataFrame, path: str, column: str) -> None:
    """Sorted text lines; range-sorted part files keep the order at any size."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("errorifexists").text(path)


def write_lines(df: DataFrame, path: str, order: list[str], value: str = "value") -> None:
    """Lines in a total order: part files by name hold consecutive ranges, so joined together they are the whole text. All or nothing."""
    build = lambda staging: df.orderBy(*order).select(F.col(value).alias("value")).write.text(staging)
    install(df.sparkSession, path, build)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def write_document(spark: SparkSession, path: str, value: object) -> None:
    """One small driver-side JSON report, indent 2, LF."""
    refuse_existing(spark, path)
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray((json.dumps(value, indent=2) + "\n").encode()))
    finally:
        out.close()


def install(spark: SparkSession, path: str, build: Callable[[str], None]) -> None:
    """``build(staging)`` writes beside ``path``; a rename commits, and any failure removes the staging folder."""
    refuse_existing(spark, path)
    staging = path.rstrip("/") + ".staging"
    fs, tmp = _fs(spark, staging)
    fs.delete(tmp, True)
    try:
        build(staging)
        if not fs.rename(tmp, _fs(spark, path)[1]):
            raise OSError(f"rename to {path} failed")
    except BaseException:
        fs.delete(tmp, True)
        raise
