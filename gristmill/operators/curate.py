"""Relational curation: manifest anti joins, required joins, first choices and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.validate import checked


def not_in_manifest(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return df.join(manifest.select(key), key, "left_anti")


def required_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Inner join that aborts, with the count, if a row of ``df`` has no partner; both sides are read once, by a left join."""
    both = df.join(other.withColumn("_there", F.lit(True)), key, "left")
    return checked(both, {"n": F.col("_there").isNull()}, f"{key} missing on the right: {{n}}").drop("_there")


def first_choice(df: DataFrame, key: str, value: str, preference: list[str]) -> DataFrame:
    """The row of each key whose value comes first in ``preference``; others are dropped."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(value))
    w = Window.partitionBy(key).orderBy("_p", *[c for c in df.columns if c != key])
    return df.withColumn("_p", rank).filter("_p > 0").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_p", "_r")


def with_fallback(df: DataFrame, verified: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Verified fields win when present, an empty string included; else the row's own."""
    v = verified.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return df.join(v, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def wanted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed columns in order, '' for missing columns and nulls."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns])


def first_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """One row per group in rank order, then the first k groups."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(*order).limit(k)
