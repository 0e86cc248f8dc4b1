"""COCO-style nested annotation documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.split import dense_ids
from gristmill.operators.validate import ContractError

SETS = ("full", "union")


def categories(spark, names: list[str], supercategory: str = "object") -> DataFrame:
    return spark.createDataFrame([(i + 1, n, supercategory) for i, n in enumerate(names)], "id int, name string, supercategory string")


def full_instances(instances: DataFrame) -> DataFrame:
    """category_id = class + 1, segmentation wrapped in a list, numbers rounded to 4 places."""
    r = lambda c: F.round(c, 4)
    return instances.select("file_name", "line_no", (F.col("class_id") + 1).alias("category_id"),
                            F.array(r(F.col("bbox.x")), r(F.col("bbox.y")), r(F.col("bbox.w")), r(F.col("bbox.h"))).alias("bbox"),
                            F.array(F.transform("segmentation", r)).alias("segmentation"), r(F.col("area")).alias("area"), F.lit(0).alias("iscrowd"))


def remapped(instances: DataFrame, mapping: DataFrame, pass_through: bool = False) -> DataFrame:
    """Adds category_id by a caller's (class_id, category_id) table; classes it does not name go, or keep class + 1 with ``pass_through``."""
    out = instances.join(mapping.select("class_id", F.col("category_id").alias("_to")), "class_id", "left" if pass_through else "inner")
    return out.withColumn("category_id", F.coalesce("_to", F.col("class_id") + 1) if pass_through else F.col("_to")).drop("_to")


def union_instances(instances: DataFrame, mapping: DataFrame, pass_through: bool = False, whole_image: int | None = None) -> DataFrame:
    """One union box per image and category after :func:`remapped`, areas summed; with ``whole_image`` one per image, of that category."""
    b = F.col("bbox")
    x1, y1 = F.min(b["x"]), F.min(b["y"])
    rows = remapped(instances, mapping, pass_through)
    rows = rows if whole_image is None else rows.withColumn("category_id", F.lit(whole_image))
    return (rows.groupBy("file_name", "category_id")
            .agg(F.min("line_no").alias("line_no"), F.array(x1, y1, F.max(b["x"] + b["w"]) - x1, F.max(b["y"] + b["h"]) - y1).alias("bbox"),
                 F.transform(F.array_sort(F.collect_list(F.struct("line_no", "segmentation"))), lambda s: s["segmentation"]).alias("segmentation"),
                 F.sum("area").alias("area"), F.lit(0).alias("iscrowd")))


def document_rows(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and annotations with 1-based ids in (file name) and (image id, line) order."""
    img = dense_ids(images, ["file_name"], "id")
    ann = annotations.join(img.select("file_name", F.col("id").alias("image_id")), "file_name")
    return img, dense_ids(ann.drop("file_name"), ["image_id", "line_no", "category_id"], "id").drop("line_no")


def document_lines(images: DataFrame, annotations: DataFrame, cats: DataFrame, annotation_set: str = "full") -> DataFrame:
    """section, pos and value: the document as lines, a row's JSON each; in that order they are one JSON object of any size.

    Rows of a section end with a comma but for the last one, which its id tells, so no task sees more than its own rows.
    """
    if annotation_set not in SETS:
        raise ContractError(f"unknown annotation set {annotation_set}")
    spark, (img, ann) = images.sparkSession, document_rows(images, annotations)
    parts = []
    for k, (name, df) in enumerate((("images", img), ("annotations", ann), ("categories", cats))):
        df = df.select("id", *[c for c in df.columns if c != "id"])
        last = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
        line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        rows = df.select(F.col("id").cast("long").alias("pos"), line.alias("line")).join(F.broadcast(last), F.lit(True))
        parts.append(rows.select(F.lit(k).alias("section"), "pos", F.concat("line", F.when(F.col("pos") < F.col("_last"), ",").otherwise("")).alias("value")))
        start = ("{" + f'"info":{{"description":"{annotation_set}"}},' if k == 0 else "],") + f'"{name}":['
        parts.append(spark.createDataFrame([(k, -1, start)], "section int, pos long, value string"))
    parts.append(spark.createDataFrame([(3, -1, "]}")], "section int, pos long, value string"))
    return reduce(DataFrame.unionByName, parts)


def coco_document(images: DataFrame, annotations: DataFrame, cats: DataFrame, annotation_set: str = "full") -> DataFrame:
    """One nested row per split. Meant for one document that fits an executor; use the rows for larger sets."""
    if annotation_set not in SETS:
        raise ContractError(f"unknown annotation set {annotation_set}")
    img, ann = document_rows(images, annotations)
    pack = lambda df, n: df.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in df.columns if c != "id"]))).alias(n))
    info = F.struct(F.lit(annotation_set).alias("description"))
    return pack(img, "images").join(pack(ann, "annotations"), F.lit(True)).join(pack(cats, "categories"), F.lit(True)).withColumn("info", info)
