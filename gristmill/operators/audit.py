"""Audit aggregates: leakage, dense class grids, quantiles, overlaps and totals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.grouping import pair_order_statistics
from gristmill.sources.materialize import materialize, release

QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
#: Rows of a bracket that are read and sorted.
EXACT_ROWS = 20_000


def leakage_profile(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups and rows of groups that reach over more than one split, with rates to 6 places."""
    g = df.groupBy(group).agg(F.count_distinct(split).alias("k"), F.count("*").alias("n"))
    cross = F.when(F.col("k") > 1, 1).otherwise(0)
    out = g.agg(F.count("*").alias("source_group_count"), F.coalesce(F.sum(cross), F.lit(0)).alias("cross_split_source_groups"),
                F.coalesce(F.sum(cross * F.col("n")), F.lit(0)).alias("cross_split_images"), F.coalesce(F.sum("n"), F.lit(0)).alias("image_count"))
    rate = lambda x, y: F.round(F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0), 6)
    return out.withColumns({"group_rate": rate("cross_split_source_groups", "source_group_count"), "image_rate": rate("cross_split_images", "image_count")})


def class_grid(dims: DataFrame, rows: DataFrame, keys: list[str], image: str) -> DataFrame:
    """Instance and distinct image counts on a dense grid; cells without rows hold 0."""
    got = rows.groupBy(*keys).agg(F.count("*").alias("instance_count"), F.count_distinct(image).alias("image_count"))
    return dims.join(got, keys, "left").na.fill(0, ["instance_count", "image_count"])


def order_statistics(df: DataFrame, column: str, ranks: list[int], exact_rows: int = EXACT_ROWS, accuracy: int = 1000) -> dict[int, float]:
    """The values at the given 0-based ranks of a column of numbers without nulls; NaN is the largest.

    Each round brackets every rank between two values of the column by bounded sketches and counts what lies below and inside; a bracket
    of at most ``exact_rows`` rows is read and sorted. A bracket shrinks at least ``accuracy / 4`` times a round, or is one value, so the
    driver holds a few brackets and at most ``exact_rows`` values of each, whatever the rows, their spread and their ties.
    """
    out: dict[int, float] = {}
    v = F.col(column)
    todo = [(sorted(set(ranks)), None, None, 0, df.count())]  # ranks, least and greatest value (both inside), rows below, rows inside
    while todo:
        inside = [df if lo is None else df.filter(v.between(lo, hi)) for _, lo, hi, _, _ in todo]
        nxt = []
        for (rs, lo, hi, below, n), part in zip(todo, inside):
            if lo is not None and lo == hi:
                out |= dict.fromkeys(rs, lo)
                continue
            if n <= exact_rows:
                got = sorted((r[0] for r in part.select(v).collect()), key=lambda x: (x != x, x))
                out |= {r: got[r - below] for r in rs}
                continue
            # one sketch for all ranks of the bracket; its error is a rank of n / accuracy either way
            share = lambda r: min(1.0, max(0.0, r / n))
            wide = 1.5 * n / accuracy + 1
            marks = [share(r - below + d) for r in rs for d in (-wide, wide)]
            edges = part.agg(F.percentile_approx(v, F.array(*[F.lit(m) for m in marks]), F.lit(accuracy))).first()[0]
            pairs = sorted({(edges[2 * i], edges[2 * i + 1]) for i in range(len(rs))}, key=lambda e: [(x != x, x) for x in e])
            counts = part.agg(*[c for a, b in pairs for c in (F.count_if(v < a), F.count_if(v.between(a, b)))]).first()
            for i, (a, b) in enumerate(pairs):
                under, n_in = below + counts[2 * i], counts[2 * i + 1]
                held = [r for r in rs if under <= r < under + n_in and r not in out]
                done = {x for t in nxt for x in t[0]}
                if held := [r for r in held if r not in done]:
                    nxt.append((held, a, b, under, n_in))
            if {r for r in rs} - {x for t in nxt for x in t[0]}:
                raise RuntimeError("a quantile sketch missed its error bound")
        todo = nxt
    return out


def quantiles(df: DataFrame, column: str, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Exact linear quantiles, one row each, to 6 places; nulls do not count, and no rows for an empty input."""
    held = materialize(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), "values")
    n = held.count()
    at = [(q, q * (n - 1)) for q in QUANTILES] if n else []
    got = order_statistics(held, "v", [r for _, x in at for r in (math.floor(x), math.ceil(x))], exact_rows) if n else {}
    release(held)
    rows = [(q, got[math.floor(x)] + (got[math.ceil(x)] - got[math.floor(x)]) * (x - math.floor(x))) for q, x in at]
    return df.sparkSession.createDataFrame(rows, "q double, value double").select("q", F.round("value", 6).alias("value"))


def pair_quantiles(df: DataFrame, block: str, key: str, vector: str, exact_rows: int = EXACT_ROWS, tile_rows: int | None = None) -> DataFrame:
    """As :func:`quantiles`, of the cosines of all pairs inside blocks, none of which is stored."""
    got = pair_order_statistics(df, block, key, vector, QUANTILES, exact_rows, tile_rows)
    rows = [(q, lo + (hi - lo) * (x - math.floor(x))) for q, x, lo, hi in got]
    return df.sparkSession.createDataFrame(rows, "q double, value double").select("q", F.round("value", 6).alias("value"))


def overlap(df: DataFrame, group: str, split: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Number of groups that two splits share, for each pair of splits; one pass."""
    g = df.groupBy(group).agg(F.collect_set(split).alias("s"))
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    g = g.select("s", F.explode(both).alias("p"))
    return g.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count_if(F.array_contains("s", F.col("p.a")) & F.array_contains("s", F.col("p.b"))).alias("shared_groups"))


def selection_reason(instances: Column, selected: Column) -> Column:
    """Order matters: an image without instances is excluded whatever its selection."""
    return F.when(instances == 0, "excluded_empty_label").when(selected, "selected").otherwise("omitted_correlated_eval_variant")


def provenance_merge(df: DataFrame, key: str, source: str, order: str, sep: str = "; ", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the ``keep`` columns of its first row, and its sources, each once, joined in order of arrival."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(order, source))), lambda s: s[source])
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in keep], F.array_join(F.array_distinct(seq), sep).alias("provenance"), F.count("*").alias("n_rows"))
