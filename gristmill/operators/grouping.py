"""Blocked pair scoring, threshold edges, connected components and component keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from gristmill.functions.geometry import dot
from gristmill.operators.split import dense_ids
from gristmill.sources.materialize import materialize, release, settle

#: Most rows and bytes of a tile; a task compares two tiles, by so many scores at once. A table is broadcast only if its counted rows fit these bytes.
TILE_ROWS, TILE_BYTES, SCORES, BROADCAST_BYTES = 4096, 16 << 20, 1 << 20, 32 << 20
#: Bins that a task counts scores in.
BINS = 4096
#: Pairs that a task puts in order at once: fewest (in fewer, rounded scores hardly repeat) and most (as two full tiles have; below 2^26). Pairs of one row on their way to Spark.
RUNS, ORDERED, LIST = 1 << 20, 20 << 20, 4096
#: Different vectors whose copies are paired in turn (their scores repeat within a codec's 64 KB), and the share of a tile above which copies of one vector are spread.
TURN, COPIES = 64, 32


def rows_of_tile(df: DataFrame, vector: str) -> int:
    """Rows of a tile for the longest vector of ``df``, 64 at least. Few large tiles: each row is shuffled once per tile of its block."""
    longest = df.agg(F.max(F.size(vector))).first()[0] or 1
    return max(64, min(TILE_ROWS, TILE_BYTES // (8 * longest)))


def tile_plan(df: DataFrame, block: str, key: str, angle: Column | None = None, width: float = 0.0, tile_rows: int = TILE_ROWS, weight: Column | None = None, deal: str | None = None) -> DataFrame:
    """Deals the rows of each block to tiles and gives every row once for each pair of tiles it is part of.

    Adds tile_a <= tile_b (the pair, a task) and side (0: the row is of tile_a, 1: of tile_b). A block of any size becomes tiles of
    about ``tile_rows`` rows, so no task holds a block, and all pairs of rows meet in exactly one task. With ``angle`` (radians to some pivot of the block) only
    tiles that may hold rows nearer than ``width`` are paired: angles to the pivot differ by no more than the rows do. A row counts as ``weight`` rows (1).
    Rows of one value of ``deal`` (by default the key) share a tile.
    """
    zone = F.lit(0) if angle is None else F.floor(angle / width).cast("int")
    held = df.withColumn("_zone", zone)
    counts = held.groupBy(F.col(block).alias("_block"), "_zone").agg(F.ceil((F.count("*") if weight is None else F.sum(weight)) / tile_rows).cast("int").alias("_tiles"))
    counts = materialize(counts, "tiles")
    n = counts.count()
    side = lambda c: F.broadcast(c) if n * 64 <= BROADCAST_BYTES else c  # noqa: E731  a row per block and zone, counted
    own = held.join(side(counts), F.col(block).eqNullSafe(F.col("_block")) & (held["_zone"] == counts["_zone"])).drop("_block", counts["_zone"])
    own = own.withColumn("_own", F.struct("_zone", F.pmod(F.xxhash64(deal or key), F.col("_tiles")).cast("int").alias("t"))).drop("_tiles")
    near = F.array(F.lit(0)) if angle is None else F.array(F.lit(-1), F.lit(0), F.lit(1))
    there = counts.select(F.col("_block").alias("_b2"), F.col("_zone").alias("_z2"), "_tiles")
    met = own.withColumn("_z", F.explode(F.transform(near, lambda x: x + F.col("_zone")))).join(side(there), F.col(block).eqNullSafe(F.col("_b2")) & (F.col("_z") == F.col("_z2")))
    met = met.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).withColumn("_other", F.struct(F.col("_z").alias("_zone"), F.col("_t").alias("t")))
    return (met.withColumns({"tile_a": F.least("_own", "_other"), "tile_b": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")})
            .drop("_zone", "_own", "_z", "_b2", "_z2", "_tiles", "_t", "_other"))


def with_copies_together(df: DataFrame, block: str, key: str, vector: str, tile_rows: int) -> DataFrame:
    """Adds _deal, one value for equal vectors of a block, so that ``tile_plan`` puts them in one tile; many copies are spread in groups of 1/COPIES of a tile."""
    most = max(1, tile_rows // COPIES)
    held = df.withColumn("_hash", F.xxhash64(block, vector))
    many = materialize(held.groupBy(F.col("_hash").alias("_many")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most), "copies")
    side = F.broadcast(many) if many.count() * 64 <= BROADCAST_BYTES else many
    spread = F.xxhash64("_hash", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / most)))
    return held.join(side, F.col("_hash") == F.col("_many"), "left").withColumn("_deal", F.coalesce(spread, "_hash")).drop("_hash", "_many", "_n")


def vectors_of(rows: pa.Table, vector: str) -> np.ndarray:
    """The vectors in double precision, divided by the column ``norm`` if there is one."""
    v = rows[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows.num_rows, -1)
    return v / rows["norm"].to_numpy()[:, None] if "norm" in rows.column_names else v


def scored(rows: pa.Table, key: str, vector: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, first, s) of the rows of a pair of tiles, by blocks of about SCORES scores: row numbers i and j, where key i < key j, and the scores.

    Rows go by key, so a block leaves out the rows whose keys are all too large for it; each pair of rows is computed once.
    """
    if not rows.num_rows:
        return
    rank = pd.factorize(rows[key].to_pandas(), sort=True)[0]
    v = vectors_of(rows, vector)
    side = rows["side"].to_numpy()
    # rows of one key go by their vectors, so that every run computes the same
    order = np.lexsort((*v.T[:8], rank))
    one, two = order[side[order] == 0], order[side[order] == 1]
    same = rows["tile_a"][0] == rows["tile_b"][0]
    for x, y in [(one, one)] if same else [(one, two), (two, one)]:
        kx, vx, lo = rank[x], v[x], 0
        while lo < len(y):
            hi = min(len(y), lo + max(16, min(SCORES // max(1, len(x)), len(y) // 16)))
            n = np.searchsorted(kx, rank[y[hi - 1]])
            if n:
                yield x[:n], y[lo:hi], kx[:n, None] < rank[y[lo:hi]][None, :], score(vx[:n], v[y[lo:hi]])
            lo = hi


class Copies:
    """Rows of one side of a pair of tiles, by number of copies, then by the least key of equal vectors, then by key."""

    def __init__(self, at: np.ndarray, v: np.ndarray, rank: np.ndarray):
        at = at[np.argsort(rank[at], kind="stable")]
        # equal bytes; the classes are numbered as they are met, so by their least key
        of, _ = pd.factorize(np.ascontiguousarray(v[at]).view(np.dtype((np.void, 8 * v.shape[1]))).ravel().astype(object))
        n = np.bincount(of)
        place = np.empty(len(n), dtype=np.int64)
        place[np.argsort(n, kind="stable")] = np.arange(len(n))
        order = np.argsort(place[of], kind="stable")
        #: Rows, the class and number among its copies of each; start of each class in them, and its vector.
        self.rows, self.of = at[order], place[of][order]
        self.start = np.append(np.searchsorted(self.of, np.arange(len(n))), len(at))
        self.copy = np.arange(len(at)) - self.start[self.of]
        self.vectors = v[self.rows[self.start[:-1]]]

    def __len__(self) -> int:
        return len(self.vectors)


def copied_scores(rows: pa.Table, key: str, vector: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """(i, j, s), one element a pair, of the pairs that ``scored`` gives, if most vectors have copies; else None.

    Each two different vectors are scored once. The copies of one are paired in turn with those of TURN others, so the same TURN scores come once for
    each two copies, and the same keys once for each copy.
    """
    if not rows.num_rows:
        return None
    rank, v, side = pd.factorize(rows[key].to_pandas(), sort=True)[0], vectors_of(rows, vector), rows["side"].to_numpy()
    same = rows["tile_a"][0] == rows["tile_b"][0]
    one = Copies(np.flatnonzero(side == 0), v, rank)
    two = one if same else Copies(np.flatnonzero(side == 1), v, rank)
    if 4 * len(one) * len(two) > len(one.rows) * len(two.rows) or not len(one) or not len(two):
        return None

    def run() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        turn, most, turns = two.of // TURN, max(1, SCORES // 4 // len(two.rows)), {}

        def in_turn(m: int) -> tuple[np.ndarray, np.ndarray]:
            """Numbers of a copy and of a row of ``two``, for m copies."""
            if m not in turns:
                a, b = np.repeat(np.arange(m), len(two.rows)), np.tile(np.arange(len(two.rows)), m)
                order = np.lexsort((two.of[b], two.copy[b], a, turn[b]))
                turns[m] = a[order], b[order]
            return turns[m]

        step = max(1, SCORES // len(two))
        for lo in range(0, len(one), step):
            some = one.vectors[lo:lo + step]
            firsts, seconds = score(some, two.vectors), score(two.vectors, some).T
            for c in range(lo, min(lo + step, len(one))):
                for at in range(one.start[c], one.start[c + 1], most):
                    copies = one.rows[at:min(at + most, one.start[c + 1])]
                    a, b = in_turn(len(copies))
                    if same:  # classes before this one had it already
                        cut = np.searchsorted(turn, c // TURN) * len(copies)
                        a, b = a[cut:], b[cut:]
                    i, j, of = copies[a], two.rows[b], two.of[b]
                    less = rank[i] < rank[j]
                    held = (of > c) & (rank[i] != rank[j]) | (of == c) & less if same else rank[i] != rank[j]
                    s = np.where(less, firsts[c - lo][of], seconds[c - lo][of])
                    yield np.where(less, i, j)[held], np.where(less, j, i)[held], s[held]

    return run()


def tiled_scores(plan: DataFrame, block: str, key: str, vector: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float | None) -> DataFrame:
    """(block, key_a < key_b, score) of the row pairs of each pair of tiles; with a ``threshold`` only those that reach it.

    ``score(first, second)`` gives the matrix of scores of two stacks of vectors; for each pair the row of the smaller key is in ``first``.
    A task holds two tiles and one block of scores; pairs leave it block by block, as one row for each first key with the lists of its
    second keys and scores, which Spark takes apart: a row from Python costs far more than an element of a list.
    """
    types = {f.name: f.dataType for f in plan.schema}
    many = lambda t: ArrayType(t, containsNull=False)
    schema = StructType([StructField(block, types[block]), StructField(f"{key}_a", types[key], False), StructField("_keys", many(types[key]), False), StructField("_scores", many(DoubleType()), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        keys, label = rows[key].combine_chunks(), rows[block].combine_chunks()
        for i, j, first, s in scored(rows, key, vector, score):
            held = first if threshold is None else first & (s >= threshold)
            n = held.sum(axis=1)
            some = np.flatnonzero(n)
            ends = pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, x, pa.list_(pa.field("element", x.type, False))) for x in (keys.take(pa.array(np.broadcast_to(j, s.shape)[held])), pa.array(s[held])))
            parts = (label.take(pa.array(np.zeros(len(some), dtype=np.int32))), keys.take(pa.array(i[some])), *lists)
            whole = pa.RecordBatch.from_arrays(list(parts), names=schema.names)
            step = max(1, SCORES // 8 // len(j))
            yield from (whole.slice(lo, step) for lo in range(0, len(some), step))

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # Spark tells the kind of function by them
    lists = dealt_tiles(plan, block, key, vector).applyInArrow(run, schema)
    each = lists.select(block, f"{key}_a", "_keys", F.posexplode("_scores").alias("_at", "score"))
    # in range, hence no null, which spares Parquet a level a value
    return each.select(block, f"{key}_a", F.coalesce(F.get("_keys", "_at"), f"{key}_a").alias(f"{key}_b"), "score")


def ordered_scores(plan: DataFrame, block: str, key: str, vector: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """All pairs as ``tiled_scores`` gives them, those of a pair of tiles by their scores, or where most vectors have copies, by ``copied_scores``.

    Scores are most of a table of all pairs, and in key order they hardly compress: by score, equal (rounded) ones are runs, and what is left of
    a pair are the numbers of two keys in a dictionary. A task holds two tiles and at most ORDERED pairs, in 24 bytes each.
    """
    types = {f.name: f.dataType for f in plan.schema}
    many = lambda t: ArrayType(t, containsNull=False)
    schema = StructType([StructField(block, types[block]), StructField("_any", types[key], False), StructField("_a", many(types[key]), False), StructField("_b", many(types[key]), False), StructField("_scores", many(DoubleType()), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        keys, label, n, at = rows[key].combine_chunks(), rows[block].combine_chunks(), rows.num_rows, 0

        def listed(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            cuts = np.append(np.arange(0, len(s), LIST), len(s))
            lists = (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x, pa.list_(pa.field("element", x.type, False))) for x in (keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(np.ascontiguousarray(s))))
            return pa.RecordBatch.from_arrays([label.take(pa.array(np.zeros(len(cuts) - 1, dtype=np.int32))), keys.take(pa.array(i[cuts[:-1]])), *lists], names=schema.names)

        if (copied := copied_scores(rows, key, vector, score)) is not None:
            for i, j, s in copied:
                for lo in range(0, len(s), SCORES // 8):
                    yield listed(*(x[lo:lo + SCORES // 8] for x in (i, j, s)))
            return
        bits, most = n.bit_length(), min(ORDERED, n * (n - 1) // 2)
        # score and row numbers of a pair side by side, as they are read in no order
        pairs, order = np.empty(most, dtype=[("score", np.float64), ("ends", np.int64)]), np.empty(most, dtype=np.int64)

        def give() -> Iterator[pa.RecordBatch]:
            if at >= RUNS:
                order[:at].sort()
            for lo in range(0, at, SCORES // 8):
                some = pairs.take(order[lo:min(at, lo + SCORES // 8)] & _NUMBER)
                yield listed(some["ends"] >> bits, some["ends"] & ((1 << bits) - 1), some["score"])

        for i, j, first, c in scored(rows, key, vector, score):
            v, ends = c[first], ((i[:, None] << bits) | j)[first]
            while len(v):
                k = min(len(v), most - at)
                pairs["score"][at:at + k], pairs["ends"][at:at + k] = v[:k], ends[:k]
                order[at:at + k] = _by_value(v[:k], at)
                v, ends, at = v[k:], ends[k:], at + k
                if at == most:
                    yield from give()
                    at = 0
        if at:
            yield from give()

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    each = dealt_tiles(plan, block, key, vector).applyInArrow(run, schema).select(block, "_any", "_a", "_b", F.posexplode("_scores").alias("_at", "score"))
    return each.select(block, F.coalesce(F.get("_a", "_at"), "_any").alias(f"{key}_a"), F.coalesce(F.get("_b", "_at"), "_any").alias(f"{key}_b"), "score")


#: Bits that hold the number of a pair.
_NUMBER = np.int64((1 << 26) - 1)


def _by_value(v: np.ndarray, at: int) -> np.ndarray:
    """Whole numbers in the order of ``v``, up to 2^-26 of it, that hold its upper bits and the numbers from ``at``: a plain sort of them is ten times as fast as argsort."""
    bits = np.ascontiguousarray(v).view(np.int64)
    bits = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    bits &= ~_NUMBER
    bits |= np.arange(at, at + len(v))
    return bits


def dealt_tiles(plan: DataFrame, block: str, key: str, vector: str) -> GroupedData:
    """The pairs of tiles as groups. Their work is out of proportion to their bytes, so they are dealt to all shuffle partitions, which are not merged."""
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = ["norm"] if "norm" in plan.columns else []
    return plan.select(block, key, vector, *more, "tile_a", "tile_b", "side").repartition(parts, block, "tile_a", "tile_b").groupBy(block, "tile_a", "tile_b")


def numbers(df: DataFrame, vector: str) -> Column:
    """The vector as a task gets it: single precision stays, as it takes half the bytes; all else is double."""
    return F.col(vector) if df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) else F.col(vector).cast("array<double>")


def with_norm(df: DataFrame, block: str, key: str, vector: str) -> DataFrame:
    """block, key, v and its norm. Null, zero and non-finite vectors, and null keys, are left out."""
    v = df.select(block, key, numbers(df, vector).alias("v")).filter(F.col(key).isNotNull())
    wide = F.col("v").cast("array<double>")
    return v.withColumn("norm", F.sqrt(dot(wide, wide))).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))


def unit_vectors(df: DataFrame, block: str, key: str, vector: str) -> DataFrame:
    """block, key, unit: each vector divided by its norm, once a row. Null, zero and non-finite vectors, and null keys, are left out."""
    v = with_norm(df, block, key, vector).withColumn("v", F.col("v").cast("array<double>"))
    # the norm is repeated, as it would be computed again for every element inside a transform
    return v.select(block, key, F.zip_with("v", F.array_repeat("norm", F.size("v")), lambda x, n: x / n).alias("unit"))


def block_pairs(df: DataFrame, block: str, key: str, vector: str, threshold: float | None = None, tile_rows: int | None = None) -> DataFrame:
    """Pairs key_a < key_b inside a block with their cosine: all of them, or with a ``threshold`` above 0 the edges that reach it.

    Pairs of tiles are the tasks, so a label with a third of all rows is many tasks; with a threshold, tiles whose angles to the block's
    pivot (its first vector) are too far apart are not compared, and only edges leave a task.
    """
    tile_rows = tile_rows or rows_of_tile(df, vector)
    if threshold is None:
        # a row's own vector and its norm are shuffled, and divided in the task
        held = with_copies_together(with_norm(df, block, key, vector), block, key, "v", tile_rows)
        return ordered_scores(tile_plan(held, block, key, tile_rows=tile_rows, deal="_deal"), block, key, "v", _products)
    unit = unit_vectors(df, block, key, vector)
    if threshold <= 0:
        return tiled_scores(tile_plan(unit, block, key, tile_rows=tile_rows), block, key, "unit", _products, threshold)
    pivots = unit.groupBy(F.col(block).alias("_p")).agg(F.min_by("unit", key).alias("pivot"))
    unit = unit.join(pivots, F.col(block).eqNullSafe(F.col("_p"))).drop("_p")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("unit"), F.col("pivot")))))
    # the small margin covers rounding at the edge of a zone
    return tiled_scores(tile_plan(unit.withColumn("angle", angle).drop("pivot"), block, key, F.col("angle"), math.acos(threshold) + 1e-6, tile_rows), block, key, "unit", _products, threshold)


def _bins(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Number of each value's bin among BINS of one width from lo to hi; values beyond them are in the first and the last."""
    hi = max(hi, np.nextafter(lo, np.inf))
    return np.clip((v - lo) * (BINS / (hi - lo)), 0, BINS - 1).astype(np.int32)


def pair_order_statistics(df: DataFrame, block: str, key: str, vector: str, quantiles: tuple[float, ...], exact_rows: int = 20_000, tile_rows: int | None = None) -> list[tuple[float, float, float, float]]:
    """(q, x, below, above): linear position x of each quantile among the cosines of all pairs inside blocks, and the two scores around it.

    No score is stored: each round scores all pairs again and a task gives counts of bins alone. A bracket is a chain of (lo, hi, bin); those
    that hold a position are split into bins again, and once one holds at most ``exact_rows`` scores, these are read. A bracket whose
    least and greatest score are equal is done, so ties do not matter. Nothing for an input without pairs.
    """
    unit = materialize(unit_vectors(df, block, key, vector), "units")
    plan = dealt_tiles(tile_plan(unit, block, key, tile_rows=tile_rows or rows_of_tile(df, vector)), block, key, "unit")

    def scan(chains: list[tuple], read: bool) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((len(chains), BINS), dtype=np.int64)
            ends, held = [(np.inf, -np.inf)] * len(chains), [[np.empty(0)] for _ in chains]
            for _, _, first, s in scored(pa.Table.from_batches(batches), key, "unit", _products):
                s = s[first]
                top = _bins(s, *chains[0][0][:2])
                for c, chain in enumerate(chains):
                    v = s if chain[0][2] is None else s[top == chain[0][2]]
                    for lo, hi, b in chain[1:]:
                        v = v if b is None else v[_bins(v, lo, hi) == b]
                    if read:
                        held[c].append(v)
                    elif len(v):
                        n[c] += np.bincount(_bins(v, *chain[-1][:2]), minlength=BINS)
                        ends[c] = min(ends[c][0], v.min()), max(ends[c][1], v.max())
            if read:
                c, v = np.repeat(np.arange(len(chains)), [sum(map(len, x)) for x in held]), np.concatenate([y for x in held for y in x])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, np.zeros(len(c), dtype=np.int64), np.ones(len(c), dtype=np.int64), v, v)], names=["c", "bin", "n", "lo", "hi"])
            else:
                c, b = np.nonzero(n)
                e = np.array(ends).reshape(-1, 2)[c]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, b, n[c, b], e[:, 0], e[:, 1])], names=["c", "bin", "n", "lo", "hi"])

        run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        found = plan.applyInArrow(run, "c long, bin long, n long, lo double, hi double")
        if read:
            return found.select("c", "lo").collect()  # exact_rows of each bracket at most
        return found.groupBy("c", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()

    out: dict[int, float] = {}
    # (chain, scores below it, its scores, ranks in it); cosines lie between -1 and 1, but for rounding
    todo = [(((-1.0, 1.0, None),), 0, None, None)]
    at: list[tuple[float, float]] = []
    while todo:
        got: dict[int, list] = {}
        for r in scan([t[0] for t in todo], False):
            got.setdefault(r["c"], []).append(r)
        nxt = []
        for c, (chain, below, n, ranks) in enumerate(todo):
            rows = sorted(got.get(c, []), key=lambda r: r["bin"])
            total = sum(r["n"] for r in rows)
            if n is None:
                n, at = total, [(q, q * (total - 1)) for q in quantiles] if total else []
                ranks = sorted({r for _, x in at for r in (math.floor(x), math.ceil(x))})
            if total != n:
                raise RuntimeError("scores changed between two rounds")
            if not n:
                continue
            lo, hi = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
            if lo == hi:
                out |= dict.fromkeys(ranks, lo)
                continue
            for r in rows:
                if inside := [x for x in ranks if below <= x < below + r["n"]]:
                    a, b, _ = chain[-1]
                    w = (b - a) / BINS
                    # the first and last bin reach to what lies beyond
                    edge = (min(lo, a) if r["bin"] == 0 else a + r["bin"] * w), (max(hi, b) if r["bin"] == BINS - 1 else a + (r["bin"] + 1) * w)
                    nxt.append(((*chain[:-1], (a, b, r["bin"]), (max(lo, edge[0]), min(hi, edge[1]), None)), below, r["n"], inside))
                below += r["n"]
        few = [t for t in nxt if t[2] <= exact_rows]
        values: dict[int, list] = {}
        for r in scan([t[0] for t in few], True) if few else []:
            values.setdefault(r["c"], []).append(r["lo"])
        for c, (_, below, n, ranks) in enumerate(few):
            v = sorted(values.get(c, []))
            if len(v) != n:
                raise RuntimeError("scores changed between two rounds")
            out |= {x: v[x - below] for x in ranks}
        todo = [t for t in nxt if t[2] > exact_rows]
    release(unit)
    return [(q, x, out[math.floor(x)], out[math.ceil(x)]) for q, x in at]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with component the smallest node reachable, for every node on an edge.

    ``edges`` has two orderable columns. Large-star and small-star rounds (Kiveris et al., 2014) keep the edge
    count at or below its start and need a logarithmic number of rounds in practice. Each round's edges are
    written to shared storage, so no lineage grows and a lost executor costs one round. Null ends and self
    loops are ignored; an empty input gives an empty result.
    """
    a, b = edges.columns
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "edges")
    last = None
    for _ in range(max_rounds):
        # the least neighbour of a node is a smaller one or none; each edge goes from its larger end to that of its smaller end
        low = e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = e.join(low, e["v"] == low["x"], "left").select("u", F.coalesce("m", "v").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(down, "u")
        small = (j.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))).distinct()
        nxt = materialize(small, "edges")
        release(e)
        e = nxt
        settle(e.sparkSession)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def component_keys(df: DataFrame, prefix: str, component: str, order: str) -> DataFrame:
    """``{prefix}__visual_{NN}`` with NN the component's ordinal in its prefix by first ``order`` value.

    First values are numbered by one range sort over all prefixes; the least number of a prefix is its start, so no task holds a prefix.
    """
    first = materialize(df.groupBy(prefix, component).agg(F.min(order).alias("_first")), "first")
    ids = materialize(dense_ids(first.select(prefix, "_first").distinct(), [prefix, "_first"], "_id"), "ordinals")
    start = ids.groupBy(prefix).agg(F.min("_id").alias("_start"))
    rank = first.join(ids, [prefix, "_first"]).join(start, prefix).select(prefix, component, (F.col("_id") - F.col("_start")).cast("int").alias("_nn"))
    return df.join(rank, [prefix, component]).withColumn("group_key", F.format_string("%s__visual_%02d", F.col(prefix), F.col("_nn"))).drop("_nn")


def grouping_profile(blocks: DataFrame, edges: DataFrame, components: DataFrame, block: str) -> DataFrame:
    """Compared pairs (from the blocks' sizes), matched edges, prefix groups and refined groups. ``blocks`` has the compared rows."""
    n = F.col("n").cast("decimal(38,0)")
    p = blocks.groupBy(block).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long").alias("pair_count"))
    e = edges.agg(F.count("*").alias("matched_edges"))
    c = components.agg(F.count_distinct(block).alias("prefix_groups"), F.count_distinct("component").alias("refined_groups"))
    return p.join(e, F.lit(True)).join(c, F.lit(True))
