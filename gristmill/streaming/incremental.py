"""The label parser as a stream: the same plan over files as they arrive, with good rows and rejects apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.validate import label_lines, parse_polygons


def label_stream(spark: SparkSession, folder: str, classes: int, width: float, height: float) -> DataFrame:
    raw = spark.readStream.text(folder, wholetext=True).select(F.col("value").alias("text"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    return parse_polygons(label_lines(raw), classes)
