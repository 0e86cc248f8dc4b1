"""Readers: driver tables, label text, CSV, JSON and line lists, and sorted file discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IMAGE_SUFFIXES = ("jpg", "jpeg", "png")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds split (parent folder), stem and lower-case suffix, derived from a path column."""
    name = F.element_at(F.split(path, "/"), -1)
    return df.withColumns({
        "split": F.element_at(F.split(path, "/"), -2),
        "stem": F.regexp_replace(name, r"\.[^.]*$", ""),
        "suffix": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)),
    })


def scan_files(spark: SparkSession, root: str, splits: Sequence[str], suffixes: Sequence[str], content: bool = False) -> DataFrame:
    """Files under root/<split>, suffix matched in any case, keyed by (split, stem).

    A missing split folder raises ``FileNotFoundError`` before anything is read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for s in splits:
        p = hadoop(f"{root}/{s}")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(f"{root}/{s}")
    df = spark.read.format("binaryFile").load([f"{root}/{s}" for s in splits])
    cols = ["path", "length"] + (["content"] if content else [])
    return path_parts(df.select(*cols)).filter(F.col("suffix").isin([x.lower() for x in suffixes]))


def read_label_text(spark: SparkSession, root: str, splits: Sequence[str]) -> DataFrame:
    """Whole label files, one row each: path, split, stem, text."""
    df = spark.read.text([f"{root}/{s}/*.txt" for s in splits], wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return path_parts(df)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, null_value: str = "") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue=null_value, escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines without blank ones and those that begin with ``#``; white space at both ends is stripped after that test."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(line.alias("value")).filter("value != ''")


def keyed_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order`` (a later duplicate replaces an earlier one)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def with_sha256(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(content), 256))


def verify_sha256(df: DataFrame, expected: str, content: str = "content") -> DataFrame:
    """Raises at run time on the first row whose hash differs (case of ``expected`` is ignored)."""
    ok = F.assert_true(F.sha2(F.col(content), 256) == expected.lower(), F.lit("sha256 mismatch"))
    return df.filter(ok.isNull())
