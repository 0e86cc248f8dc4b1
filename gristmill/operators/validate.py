"""Strict parsing of polygon label text into good rows and rejects, and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gristmill.functions import geometry as G
from gristmill.sources.materialize import materialize, release

TOLERANCE = 1e-6


class ContractError(ValueError):
    pass


def label_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line: the other columns, 1-based line_no, stripped line."""
    rest = [c for c in df.columns if c != text]
    return (df.select(*rest, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("p", "line"))
            .select(*rest, (F.col("p") + 1).alias("line_no"), F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("line")).filter("line != ''"))


def parse_polygons(lines: DataFrame, classes: int, width: str = "width", height: str = "height") -> DataFrame:
    """Adds class_id, segmentation, bbox, area and reason (null: accepted).

    Reasons in the order they are tested: token, class, arity, range, degenerate.
    """
    parts = F.split("line", r"\s+")
    cid = F.expr("try_cast(element_at(_t, 1) AS int)")
    coords = F.expr("transform(slice(_t, 2, greatest(size(_t) - 1, 0)), x -> try_cast(x AS double))")
    df = lines.withColumn("_t", parts).withColumns({"class_id": cid, "_c": coords})
    ok = ~F.isnan(F.col("class_id").cast("double"))
    finite = F.forall("_c", lambda v: ~F.isnan(v) & v.between(-TOLERANCE, 1 + TOLERANCE))
    pre = (F.when(F.col("class_id").isNull() | ~ok | F.exists("_c", lambda v: v.isNull()), "token")
           .when(~F.col("class_id").between(0, classes - 1), "class")
           .when((F.size("_c") < 6) | (F.size("_c") % 2 != 0), "arity")
           .when(~finite, "range"))
    df = df.withColumn("_r", pre).withColumn("segmentation", F.when(F.col("_r").isNull(), G.clamp_scale(F.col("_c"), F.col(width), F.col(height))))
    df = df.withColumns({"bbox": F.when(F.col("_r").isNull(), G.bbox(F.col("segmentation"))), "area": F.when(F.col("_r").isNull(), G.polygon_area(F.col("segmentation")))})
    flat = (F.col("bbox.w") <= 0) | (F.col("bbox.h") <= 0) | (F.col("area") <= 0)
    return df.withColumn("reason", F.coalesce("_r", F.when(flat, "degenerate"))).drop("_t", "_c", "_r")


def good_and_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter("reason IS NULL").drop("reason"), parsed.filter("reason IS NOT NULL")


def image_records(images: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    """Images with their instances gathered in line order; images without any get an empty array."""
    inst = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "class_id", "segmentation", "bbox", "area"))).alias("instances"))
    empty = F.array().cast(inst.schema["instances"].dataType)
    return images.join(inst, keys, "left").withColumn("instances", F.coalesce("instances", empty))


def usable(records: DataFrame) -> DataFrame:
    """Records with at least one instance."""
    return records.filter(F.size("instances") > 0)


def require_empty(df: DataFrame, message: str) -> None:
    """Raises with the count if any row is left."""
    n = df.count()
    if n:
        raise ContractError(f"{message}: {n}")


def checked(df: DataFrame, faults: dict[str, Column], message: str) -> DataFrame:
    """``df`` as a table, written by one pass that also counts the rows with each fault; raises with the counts if there are any.

    ``message`` names the faults in braces. What is returned is read from the table, so nothing is evaluated a second time.
    """
    seen = Observation()
    out = materialize(df.observe(seen, *[F.count_if(c).alias(n) for n, c in faults.items()]), "checked")
    counts = {n: seen.get.get(n) or 0 for n in faults}
    if any(counts.values()):
        release(out)
        raise ContractError(message.format(**counts))
    return out


def require_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that aborts, with both counts, if either side has an unmatched row. Each side is read once, by a full join."""
    a, b = left.withColumn("_in_a", F.lit(True)), right.withColumn("_in_b", F.lit(True))
    both = a.join(b, keys, "full")
    return checked(both, {"a": F.col("_in_b").isNull(), "b": F.col("_in_a").isNull()}, "unpaired rows: {a} left, {b} right").drop("_in_a", "_in_b")


def require_status(df: DataFrame, column: str, value: str) -> DataFrame:
    return checked(df, {"n": ~F.col(column).eqNullSafe(value)}, f"{column} is not {value}: {{n}}")


def collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def reconcile(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value differs or is missing on a side; empty when all agree."""
    a, e = actual.select(*keys, F.col(value).alias("actual")), expected.select(*keys, F.col(value).alias("expected"))
    return a.join(e, keys, "full").filter(~F.col("actual").eqNullSafe(F.col("expected")))
