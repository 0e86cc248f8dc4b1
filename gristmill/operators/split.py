"""Leakage-resistant grouped splits, representatives and dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.sources.materialize import materialize

#: Attempts of the split search.
ATTEMPTS = 512
#: Modulus of the places, cells an attempt is counted in at least, groups of a cell (about).
PRIME, CELLS, CELL_ROWS = 4_503_599_627_370_449, 64, 100_000
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


def class_presence(df: DataFrame, group: str, cls: str) -> DataFrame:
    return df.select(group, cls).distinct()


def split_counts(n: int) -> tuple[int, int]:
    """Groups of train and val among n: shares rounded half to even; test has the rest."""
    return round(n * RATIOS["train"]), round(n * RATIOS["val"])


def split_boundaries(groups: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """Splits whole groups by position in a seeded md5 order: round(n*.7) train, round(n*.15) val, the rest test."""
    keys = groups.select(key).distinct()
    a, b = split_counts(keys.count())
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    ranked = dense_ids(keys.withColumn("_h", order), ["_h", key], "_r")
    return ranked.select(key, F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "val").otherwise("test").alias("split"))


def _places(df: DataFrame, key: str) -> DataFrame:
    """Adds _h1 and _h2, two numbers below 2^52 from the md5 of the key: its place in an attempt is (_h1 + attempt * _h2) modulo PRIME."""
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return df.withColumn("_h", h).withColumns({f"_h{i}": F.conv(F.substring("_h", 13 * i - 12, 13), 16, 10).cast("long") for i in (1, 2)}).drop("_h")


def _attempts(placed: DataFrame, attempts: int) -> DataFrame:
    """One row per attempt, with its place _o; hashes are made before, once a row."""
    each = placed.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return each.withColumn("_o", (F.col("_h1") + F.col("attempt").cast("long") * F.col("_h2")) % PRIME).drop("_h1", "_h2")


def split_cuts(groups: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """attempt, ao, ak, bo, bk: the last place and key in train and in val; null where that part is empty.

    The places of an attempt are counted in equal cells (map-side, so nothing of the size groups x attempts is shuffled), running
    sums over its cells find the two that hold a cut, and only the groups of those cells are ranked.
    """
    keys = materialize(_places(groups.select(key).distinct(), key), "groups")
    n = keys.count()
    a, b = split_counts(n)
    width = PRIME // max(CELLS, 1 << (n // CELL_ROWS).bit_length()) + 1
    rows = _attempts(keys, attempts).withColumn("cell", F.expr(f"_o div {width}"))
    counts = rows.groupBy("attempt", "cell").agg(F.count("*").alias("n"))
    run = counts.withColumn("off", F.sum("n").over(Window.partitionBy("attempt").orderBy("cell")) - F.col("n"))
    ranks = F.array(*[F.struct(F.lit(c).alias("cut"), F.lit(r).alias("rank")) for c, r in (("a", a), ("b", a + b))])
    at = run.withColumn("r", F.explode(ranks)).filter("off < r.rank AND r.rank <= off + n").select("attempt", "cell", "off", "r.cut", "r.rank")
    at = materialize(at, "cells")  # two rows an attempt
    w = Window.partitionBy("attempt", "cut").orderBy("_o", key)
    last = rows.join(F.broadcast(at), ["attempt", "cell"]).withColumn("k", F.row_number().over(w) + F.col("off")).filter("k = rank")
    pick = lambda cut, c: F.max(F.when(F.col("cut") == cut, F.col(c)))
    cuts = last.groupBy("attempt").agg(pick("a", "_o").alias("ao"), pick("a", key).alias("ak"), pick("b", "_o").alias("bo"), pick("b", key).alias("bk"))
    return materialize(keys.sparkSession.range(attempts).select(F.col("id").cast("int").alias("attempt")).join(cuts, "attempt", "left"), "cuts")


def _upto(key: str, part: str) -> Column:
    """Whether a place is at or before the cut of ``part`` (a: train, b: val)."""
    o, k = F.col(f"{part}o"), F.col(f"{part}k")
    return F.coalesce((F.col("_o") < o) | ((F.col("_o") == o) & (F.col(key).isNull() | (F.col(key) <= k))), F.lit(False))


def split_scores(cuts: DataFrame, presence: DataFrame, key: str, cls: str, least_groups: int = 6, excluded: tuple = ()) -> DataFrame:
    """Mean absolute deviation of each class's split shares from the ratios, per attempt.

    ``cuts`` are those of :func:`split_cuts` (a row per attempt, so they are broadcast); ``presence`` has each group and class once. Classes in fewer
    than ``least_groups`` groups and the ``excluded`` ones do not count; without any class every score is 0.
    """
    kept = presence.filter(~F.col(cls).isin(*excluded)) if excluded else presence
    rows = _attempts(_places(kept.select(key, cls), key), cuts.count()).join(F.broadcast(cuts), "attempt")
    got = rows.groupBy("attempt", cls).agg(F.count_if(_upto(key, "a")).alias("a"), F.count_if(_upto(key, "b")).alias("b"), F.count("*").alias("n")).filter(F.col("n") >= least_groups)
    # a class that has no group in a split deviates by the whole ratio; without a cut for val it has none
    has = {"train": F.col("a"), "val": F.greatest(F.col("b") - F.col("a"), F.lit(0)), "test": F.col("n") - F.greatest("a", "b")}
    dev = sum(F.abs(has[s] / F.col("n") - r) for s, r in RATIOS.items())
    scores = got.groupBy("attempt").agg(F.round(F.sum(dev) / (len(RATIOS) * F.count("*")), 8).alias("score"))
    return cuts.select("attempt").join(scores, "attempt", "left").na.fill(0.0, ["score"])


def best_split(groups: DataFrame, key: str, cuts: DataFrame, scores: DataFrame) -> DataFrame:
    """Assignment of the lowest score; a tie keeps the first attempt."""
    best = cuts.join(scores.orderBy("score", "attempt").limit(1).select("attempt"), "attempt")
    rows = _places(groups.select(key).distinct(), key).join(F.broadcast(best), F.lit(True)).withColumn("_o", (F.col("_h1") + F.col("attempt").cast("long") * F.col("_h2")) % PRIME)
    return rows.select(key, F.when(_upto(key, "a"), "train").when(_upto(key, "b"), "val").otherwise("test").alias("split"))


def representatives(df: DataFrame, group: str, count: str, name: str) -> DataFrame:
    """One row per group: most instances, then smallest name."""
    w = Window.partitionBy(group).orderBy(F.desc(count), name)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def select_records(df: DataFrame, group: str, count: str, name: str) -> DataFrame:
    """Adds selected: train keeps all, the others one representative per group."""
    w = Window.partitionBy(group).orderBy(F.desc(count), name)
    return df.withColumn("_rn", F.row_number().over(w)).withColumn("selected", (F.col("split") == "train") | (F.col("_rn") == 1)).drop("_rn")


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based consecutive ids in a total order without pulling all rows into one task.

    A range sort deals the rows out and sorts them, each partition numbers its own, and the partitions' counts (one row
    each) give the offsets. Rows are shuffled once.
    """
    place = F.monotonically_increasing_id()  # partition and position in it
    held = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", place), "dense")
    part = F.shiftright("_m", 33)
    counts = held.groupBy(part.alias("_pid")).agg(F.count("*").alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return held.join(F.broadcast(offs), part == F.col("_pid")).withColumn(name, F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_off") + 1).drop("_m", "_pid", "_off")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds inclusive running sums (new name: column) in a total order inside each key, a key of any size being many tasks.

    A range sort over key and order deals the rows out; each partition sums its own part of a key, and one row per key and
    partition gives what lies before.
    """
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
    held = materialize(rows, "running").withColumn("_pid", F.shiftright("_m", 33))
    part = Window.partitionBy("_pid", *keys).orderBy("_m")
    total = held.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_pid")
    total = total.select("_pid", *keys, *[(F.sum(f"_t_{n}").over(before) - F.col(f"_t_{n}")).alias(f"_b_{n}") for n in sums])
    own = held.withColumns({f"_o_{n}": F.sum(c).over(part) for n, c in sums.items()})
    return own.join(total, ["_pid", *keys]).withColumns({n: F.col(f"_o_{n}") + F.col(f"_b_{n}") for n in sums}).select(*df.columns, *sums)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    return dense_ids(df, order, "_id").withColumn("batch", F.floor((F.col("_id") - 1) / size)).drop("_id")
