"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII characters (fixed by the data contracts).
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: A side may be broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them; for columns that live beside those of a caller."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(key: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % m


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Python stages that run inside get batches of so many rows: whole texts and their arrays are held once per batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system; idle workers would hold it while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not a glibc


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the counted rows fit the bound; otherwise leave the join to Catalyst."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
