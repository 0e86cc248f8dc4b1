"""Minimax contiguous sharding of atomic groups.

Rows of equal text form a group, groups are ordered by the SHA-256 of their text, and the smallest capacity is
sought for which a greedy walk needs no more than the given shards. The walk never sees single groups: the driver
holds a bounded summary of the prefix sums (at most ``POINTS`` group boundaries per pass) and asks for finer
boundaries only where a cut can still fall, until the smallest capacity with cuts inside unknown stretches equals
the smallest one with known boundaries only. That capacity is exact at any size.

The cuts are keys, so assigning a row compares its hash with at most shards-1 literals: no join, and a group of a
third of all rows costs no skewed task. Law: ``bytes``. Null text counts as empty text (size 0 plus overhead);
rows of equal text share a shard; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import table, text_or_empty
from gristmill.sources.materialize import materialize

SHARDS, OVERHEAD, POINTS, CELLS, SLOT_CELLS = 24, 8, 4096, 4096, 512


class Summary:
    """Known group boundaries (prefix sums, ascending) and the number of groups up to each from the one before."""

    def __init__(self, points: dict[int, int]):
        self.set(points)

    def set(self, points: dict[int, int]):
        self.at = sorted(points)
        self.n = [points[x] for x in self.at]
        self.total = self.at[-1] if self.at else 0

    def reach(self, limit: int, fluid: bool) -> int:
        """Furthest cut at or before limit; fluid: anywhere inside a stretch of several groups."""
        i = bisect_right(self.at, limit)
        if i == len(self.at):
            return self.total
        return limit if fluid and self.n[i] > 1 else (self.at[i - 1] if i else 0)

    def walk(self, cap: int, shards: int, fluid: bool, start: int = 0) -> list[int]:
        out = [start]
        for _ in range(shards):
            if out[-1] >= self.total:
                break
            out.append(self.reach(out[-1] + cap, fluid))
        return out

    def least(self, shards: int, fluid: bool) -> int:
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, fluid)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def _points(groups: DataFrame, width: int, where: Column | None = None) -> dict[int, int]:
    g = groups if where is None else groups.filter(where)
    rows = g.groupBy(F.expr(f"(cum - 1) div {width}")).agg(F.max("cum").alias("c"), F.count("*").alias("n")).collect()
    return {r["c"]: r["n"] for r in rows}


def minimax_cuts(groups: DataFrame, total: int, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity, and cuts as prefix sums. ``groups`` has cum, the prefix sum of group sizes."""
    if not total:
        return 0, []
    width = max(1, -(-total // POINTS))
    known = Summary(_points(groups, width))
    while True:
        low, high = known.least(shards, True), known.least(shards, False)
        if low == high:
            break
        a, b = known.walk(low, shards, False), known.walk(high, shards, True)
        a += [known.total] * (len(b) - len(a))
        spans = []
        for s in range(1, len(b)):
            lo, hi = min(a[s], b[s]), b[s - 1] + high
            i = bisect_right(known.at, lo)
            while i < len(known.at) and (known.at[i - 1] if i else 0) < hi:
                if known.n[i] > 1:
                    spans.append((known.at[i - 1] if i else 0, known.at[i]))
                i += 1
        spans = sorted(set(spans))
        merged: list[list[int]] = []
        for x, y in spans:
            if merged and merged[-1][1] == x:
                merged[-1][1] = y
            else:
                merged.append([x, y])
        where = None
        for x, y in merged:
            c = (F.col("cum") > x) & (F.col("cum") <= y)
            where = c if where is None else where | c
        old = dict(zip(known.at, known.n, strict=True))
        width = max(1, min(width // 2, sum(y - x for x, y in spans) // max(POINTS, 8 * len(spans))))
        known.set(old | _points(groups, width, where))
    # even out below that capacity: cut nearest the mean of what is left, if what follows still fits
    cuts, pos = [], 0
    for left in range(shards, 1, -1):
        if pos >= known.total:
            break
        far, mean = known.reach(pos + low, False), pos + -(-(known.total - pos) // left)
        i = bisect_right(known.at, mean)
        near = [x for x in (known.at[i - 1] if i else 0, known.at[i] if i < len(known.at) else known.total) if pos < x <= far]
        near = [x for x in near if known.walk(low, left - 1, False, x)[-1] >= known.total]
        pos = min(near, key=lambda x: (abs(x - mean), x), default=far)
        cuts.append(pos)
    return low, [c for c in cuts if c < known.total]


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard, capacity."""
    t = text_or_empty(text)
    rows = materialize(df.select(F.col(id_col), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.sha2(t, 256).alias("key")), "shard")
    groups = rows.groupBy("key").agg(F.sum("size").alias("n")).withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    groups = materialize(groups.withColumn("run", F.sum("n").over(Window.partitionBy("cell").orderBy("key"))), "groups")
    sums = sorted((r["cell"], r["n"]) for r in groups.groupBy("cell").agg(F.sum("n").alias("n")).collect())  # at most CELLS rows
    offs, total = [], 0
    for c, n in sums:
        offs.append((c, total))
        total += n
    offs = df.sparkSession.createDataFrame(offs, "cell int, off long")
    cum = groups.join(F.broadcast(offs), "cell").select("key", (F.col("run") + F.col("off")).alias("cum"))
    cum = materialize(cum, "prefix")
    cap, cuts = minimax_cuts(cum, total, shards)
    keys = sorted(r["key"] for r in cum.filter(F.col("cum").isin(cuts)).collect()) if cuts else []  # fewer than shards rows
    no = F.lit(0)
    for k in keys:
        no = no + (F.col("key") > k).cast("int")
    rows = rows.withColumn("shard", no).withColumn("_c", F.pmod(F.xxhash64(id_col, "key"), F.lit(SLOT_CELLS)).cast("int"))
    at = rows.groupBy("shard", "_c").agg(F.count("*").alias("_k"))  # at most shards * SLOT_CELLS rows
    at = at.withColumn("_off", F.sum("_k").over(Window.partitionBy("shard").orderBy("_c")) - F.col("_k")).drop("_k")
    w = Window.partitionBy("shard", "_c").orderBy(id_col, "key")
    out = rows.withColumn("_r", F.row_number().over(w)).join(F.broadcast(at), ["shard", "_c"])
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_r") - 1 + F.col("_off")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(cap).cast("long").alias("capacity"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
