"""Embedding near-duplicates: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors are merged into one class first. A class enters one bucket per table; a bucket of more than
``block_rows`` classes is dealt into blocks, and each pair of blocks is a task group of its own, so no group grows
with the bucket and no member is dropped. A task multiplies blocks in double precision, counts each link only in the
first table in which its two classes meet, and returns per class a link count plus a forest of links, never all pairs.
Components are joined by distributed star contraction.

Tables follow from the number of bits and the recall asked for at the threshold; bits follow the number of
classes, so that buckets keep their mean size at any scale.

Vectors that are null, empty, zero or hold null or non-finite components get no links and are components of their
own. Vectors of different lengths never link. Every row gives a row: a vec_id given twice with different vectors keeps a row,
links and a component for each. Rows with a null vec_id still count as links of others; their own
component is named by the smallest id in it, or null if nothing in it has an id. Only id and vector are read, so other columns
cannot clash. Empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import table
from gristmill.operators.grouping import connected_components
from gristmill.sources.materialize import materialize

THRESHOLD, RECALL, LEAST_BITS, BUCKET_ROWS, BLOCK_ROWS, GROUP_ROWS, SEED = 0.95, 0.99, 10, 64, 1024, 16_384, 7


def table_count(bits: int, threshold: float, recall: float) -> int:
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) bucket numbers from the signs of random projections."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    on = (x @ planes > 0).reshape(len(x), tables, bits)
    return (on << np.arange(bits)).sum(axis=2)


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very small or large numbers finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(pdf: pd.DataFrame, threshold: float, bits: int, tables: int, seed: int) -> pd.DataFrame:
    """Link counts and forests of all the buckets and pairs of blocks that were dealt to this group."""
    out = []
    for _, g in pdf.groupby("dim", sort=False):
        where = g[["t", "s", "i", "j"]].to_numpy(dtype=np.int64)
        o = np.lexsort((g["rep"].to_numpy(), g["side"].to_numpy(), *where.T[::-1]))
        where, rep, k, side = where[o], g["rep"].to_numpy()[o], g["k"].to_numpy()[o], g["side"].to_numpy()[o]
        x = _unit(g["v"].to_numpy()[o])
        sig = signatures(x, bits, tables, seed)
        cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(o)]):
            t, _, i, j = where[lo]
            out += _bucket(rep[lo:hi], k[lo:hi], x[lo:hi], sig[lo:hi, :t], int((side[lo:hi] == 0).sum()), i != j, threshold)
    return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3)), columns=["a", "b", "n"]).astype("int64")


def _bucket(rep, k, x, sig, cut: int, cross: bool, threshold: float) -> list[np.ndarray]:
    """Rows (a, a, links) and forest rows (a, b, 0) of one block (rows before cut), or of a block before and one after it."""
    n = len(rep)
    if n < 2 or cross and cut in (0, n):
        return []
    a, b = (slice(0, cut), slice(cut, n)) if cross else (slice(0, n),) * 2
    hit = x[a] @ x[b].T >= threshold
    if not cross:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return []
    for e in range(sig.shape[1]):  # the first table in which two classes meet counts their link
        hit &= sig[a, e][:, None] != sig[b, e][None, :]
    count = np.zeros(n, dtype=np.int64)
    count[a] += hit @ k[b]
    if cross:
        count[b] += k[a] @ hit
    parent = np.arange(n)
    i, j = np.nonzero(hit)
    j = j + (cut if cross else 0)
    while True:
        lo, hi = np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])
        m = lo != hi
        if not m.any():
            break
        np.minimum.at(parent, hi[m], lo[m])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    kid, own = np.flatnonzero(parent != np.arange(n)), np.flatnonzero(count)
    return [np.stack([rep[own], rep[own], count[own]], axis=1), np.stack([rep[kid], rep[parent[kid]], np.zeros(len(kid), dtype=np.int64)], axis=1)]


def near_groups(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, bits: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    zero = F.lit(0.0).cast(df.schema[vector].dataType.elementType)
    rows = rows.select("id", F.when(fine, F.transform(v, lambda x: F.when(x == 0, zero).otherwise(x))).alias("v"))  # -0.0 becomes 0.0
    rows = materialize(rows.withColumn("h", F.when(F.col("v").isNull(), F.uuid()).otherwise(F.sha2(F.to_json("v"), 256))), "vectors")
    classes = materialize(rows.filter("v IS NOT NULL").groupBy("h").agg(F.min("id").alias("low"), F.count("*").alias("k"), F.any_value("v").alias("v")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    bits = bits or max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS)))
    tables = table_count(bits, threshold, recall)

    def hashed(it):
        for pdf in it:
            for dim, g in pdf.groupby(pdf["v"].map(len)):
                s = signatures(_unit(g["v"]), bits, tables, seed)
                yield pd.DataFrame({"rep": np.repeat(g["rep"].to_numpy(), tables), "dim": int(dim), "t": np.tile(np.arange(tables), len(g)), "s": s.ravel()})

    hashed_rows = materialize(classes.select("rep", "v").mapInPandas(hashed, "rep long, dim int, t int, s long"), "buckets")
    key = ["dim", "t", "s"]
    # blocks of a bucket: members are dealt by hash into ceil(size / block_rows) parts
    sizes = hashed_rows.groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1").withColumn("m", F.ceil(F.col("c") / block_rows).cast("int"))
    part = F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")
    b = hashed_rows.join(sizes, key).withColumn("p", part)
    # block pair (i, j), i <= j: a member of part p serves all pairs that hold p
    b = b.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    b = b.select("rep", *key, F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).cast("int").alias("side"))
    b = b.join(classes.select("rep", "k", "v"), "rep")
    # buckets share task groups of about GROUP_ROWS rows; a block pair is never split, and has 2 * block_rows rows at most or so
    groups = max(1, -(-n * tables // GROUP_ROWS))
    found = b.groupBy(F.pmod(F.xxhash64(*key, "i", "j"), F.lit(groups)).alias("g")).applyInPandas(lambda pdf: _links(pdf, threshold, bits, tables, seed), "a long, b long, n long")
    found = materialize(found, "links")
    comp = connected_components(found.filter("a != b").select("a", "b"))
    links = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    # classes have numbers of their own, since a vec_id may stand for several vectors; ids name components only at the end
    seen = classes.select("rep", "low").join(comp, classes["rep"] == comp["node"], "left").withColumn("root", F.coalesce("component", "rep"))
    names = seen.groupBy("root").agg(F.min("low").alias("component_id"))
    info = classes.select("h", "rep", "k").join(links, "rep", "left").join(seen.select("rep", "root"), "rep").join(names, "root").select("h", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "h").join(info, "h", "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.cast("long").alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))
