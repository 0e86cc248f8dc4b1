"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts.

Every row gets a random key (64 bits of the MD5 of seed, id and text). Keys are ranged into equal cells, one aggregate gives
each source's cell sums, a prefix sum over a source's cells finds the cell its budget ends in, and only the rows of
those cells are sorted and summed. A source is cut at one key, so assigning rows is a map-side comparison: no text
and no full sort is shuffled, and a source with a third of all rows is spread over its cells.

Null text has size 0; null sources form a source of their own, last in code-point order; null ids are allowed.
Identical rows share a key and share what is left at the cut evenly. Empty input gives an empty result. Very long texts are
rows like any other (the cut leaves at most one key's rows in part). Columns are held under names of their own while the operator
works, so no name of the input can clash; :func:`mix` returns id, source and the columns it adds, :func:`mixed_rows` the input's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, small, table, text_or_empty
from gristmill.sources.materialize import materialize

#: Cells of a source: at least 2^CELL_BITS, and so many that a cell has about CELL_ROWS rows, which is what one task sorts.
CELL_BITS, CELL_ROWS = 10, 100_000


def cyclic_weights(n: int) -> list[float]:
    """1, 2, 3, repeating."""
    return [1.0 + i % 3 for i in range(n)]


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0, total: float | None = None) -> list[float]:
    """Shares of the total by weight; a target stops at cap times its size and the excess is shared again."""
    left = float(sum(sizes) if total is None else total)
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = cap * float(sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _keyed(df: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """The columns of ``df`` as _in0, _in1, ..., and _sk (source, null apart), size (words) and _h (random key)."""
    id_col, text, source = (df[c] for c in (id_col, text, source))
    return df.select(*[df[c].alias(f"_in{i}") for i, c in enumerate(df.columns)], *[c.alias(k) for k, c in {
        "_sk": F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string"))),
        "size": F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long"),
        "_h": F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), text_or_empty(text))), 1, 16), 16, -10).cast("long"),
    }.items()])


def mixture_cuts(rows: DataFrame, weights: Callable[[int], Sequence[float]] = cyclic_weights, cap: float = 3.0) -> tuple[DataFrame, int]:
    """Per source: source_size, target, whole epochs, cut key and what each row at the cut key takes; and the number of sources.

    ``rows`` has _sk, size, _h. The driver holds one total per source and nothing per document.
    """
    spark = rows.sparkSession
    bits = min(40, max(CELL_BITS, (rows.count() // CELL_ROWS).bit_length()))
    cell = F.shiftrightunsigned("_h", 64 - bits)
    cells = materialize(rows.groupBy("_sk", cell.alias("cell")).agg(F.sum("size").alias("n")), "cells")
    sums = {r["_sk"]: r["n"] for r in cells.groupBy("_sk").agg(F.sum("n").alias("n")).collect()}
    names = sorted(sums, key=lambda s: (s == "n", s.encode()))
    goal = targets([sums[s] for s in names], weights(len(names)), cap) if names else []
    plan = [(s, sums[s], t, *(divmod(round(t), sums[s]) if sums[s] else (0, 0))) for s, t in zip(names, goal, strict=True)]
    plan = spark.createDataFrame(plan, "_sk string, source_size long, target double, epochs long, rest long")
    w = Window.partitionBy("_sk").orderBy("cell")
    at = cells.withColumn("off", F.sum("n").over(w) - F.col("n")).join(small(plan, len(names), 128), "_sk").filter("off <= rest AND rest < off + n")
    at = at.select("_sk", "cell", "off", "rest")
    keys = rows.withColumn("cell", cell).join(small(at, len(names), 128), ["_sk", "cell"]).groupBy("_sk", "_h", "off", "rest").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    run = F.sum("n").over(Window.partitionBy("_sk").orderBy("_h")) + F.col("off")
    cut = keys.withColumn("end", run).filter("end - n <= rest AND rest < end").select("_sk", F.col("_h").alias("cut"), F.floor((F.col("rest") - F.col("end") + F.col("n")) / F.col("k")).alias("part"))
    return materialize(plan.join(cut, "_sk", "left").drop("rest"), "cuts"), len(names)


def _taken(rows: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
    # keys are ranged as unsigned, so the sign bit is flipped before comparing
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    extra = F.when(flip("_h") < flip("cut"), F.col("size")).when(F.col("_h") == F.col("cut"), F.least("size", "part")).otherwise(F.lit(0))
    j = rows.join(small(cuts, n, 160), "_sk")
    return j.withColumn("_extra", extra.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("_extra"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=cyclic_weights, cap: float = 3.0, seed: int = 0) -> DataFrame:
    """One row per row of ``df``: id, size, source, source_size, target, taken."""
    keys = [f"_in{df.columns.index(c)}" for c in (id_col, source)]
    rows = materialize(_keyed(df, id_col, text, source, seed).select(*keys, "_sk", "size", "_h"), "mix")
    cuts, n = mixture_cuts(rows, weights, cap)
    return _taken(rows, cuts, n).select(F.col(keys[0]).alias(id_col), F.col(keys[1]).alias(source), "size", "source_size", "target", "taken")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=cyclic_weights, cap: float = 3.0, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``df``, repeated for whole epochs; the row at the cut stays if at least half of it is due.

    Rows without words add nothing and are left out.
    """
    keyed = _keyed(df, id_col, text, source, seed)
    cuts, n = mixture_cuts(materialize(keyed.select("_sk", "size", "_h"), "mix"), weights, cap)
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("_extra") * 2 >= F.col("size")).cast("long"))
    rows = _taken(keyed, cuts, n).withColumn("_n", copies).filter("_n > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return rows.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(df.columns)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
