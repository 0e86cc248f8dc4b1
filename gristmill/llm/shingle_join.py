"""Near copies of texts: SimHash trie self-join over five-word shingles, exact check, and MinHash bands for what SimHash cannot reach.

Two texts link when the sets of their five-word shingles (ASCII-lower-cased; a shorter text is one shingle) have a
similarity of 4/5 or more. Candidates come first from the trie self-join of :mod:`gristmill.llm.simhash` over fingerprints of the same
shingles, with an error budget of ``BITS`` bits. That is what a trie can prune with; pairs of similarity 0.8 differ in up to
about 15 of 64 bits, so the others come from ``BANDS`` bands of ``DEPTH`` minimum hashes each. Every candidate is decided on the whole
sets. A pair at exactly 0.8 shares no band with probability (1 - 0.8^3)^24 = 3e-8, and agrees in under half of its minimum hashes,
where a candidate is dropped unread, with about 1e-8; more similar pairs are missed less often still.

Distribution: equal sets are merged first (one class, told by a 64-bit hash). A row keeps its bands and a byte per minimum
hash, and sets are made again from the texts of the classes that have candidates. A band's classes are compared with one hub, components of
the trie's and hubs' links are contracted, and classes of one band in different components are compared with each other inside pairs of tiles by sizes, minimum hashes
and parity bitmaps (a bound that drops no similar pair), then on whole sets; a task joins components as it goes, so only links that join two of them leave it:
fewer than its rows, however dense the group. Pairs with a hub or of the trie meet by one shuffle of the smaller side of the star.

Texts without a word (null, empty) are one class. Rows with equal keys _h are one row of the result each time; ties do not matter, as
components have no representative. Very long texts are shingled whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from gristmill.llm.common import arrow_rows, give_back, small
from gristmill.llm.simhash import bits_of, near_links
from gristmill.operators.grouping import connected_components, tile_plan
from gristmill.sources.materialize import materialize, release, settle

#: Words of a shingle, error budget of the trie; the least similarity is PART / WHOLE. Bands, minimum hashes of a band; texts are worked on by BLOCK rows.
WIDTH, BITS, PART, WHOLE, BANDS, DEPTH, BLOCK = 5, 3, 4, 5, 24, 3, 256
#: Bits of a parity bitmap, classes of a tile, shingles from which a class counts as more than one.
MAP, TILE, TILE_TOKENS = 1024, 1024, 256
_MULT = np.random.default_rng(42).integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles in their order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    f = xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return np.array([f(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    lo, hi = [0, *ends[:-WIDTH].tolist()], (ends[WIDTH - 1:] - 1).tolist()
    return np.fromiter((f(flat[a:b], 42) for a, b in zip(lo, hi)), dtype=np.uint64, count=len(hi))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Least hash of each set (none empty) under each of the BANDS * DEPTH hash functions."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(_MULT)), dtype=np.uint64)
    for j, m in enumerate(_MULT):
        out[:, j] = np.minimum.reduceat((flat ^ (flat >> np.uint64(31))) * m, starts)
    return out


def signatures(sets: list[np.ndarray]) -> tuple[list[bytes], list[list[int]]]:
    """A byte per minimum hash, and a key per band, of each set; nothing for empty ones."""
    full = [i for i, s in enumerate(sets) if len(s)]
    sig, keys = [b""] * len(sets), [[] for _ in sets]
    if full:
        least = minima([sets[i] for i in full])
        short = (least >> np.uint64(40)).astype(np.uint8)
        band = np.zeros((len(full), BANDS), dtype=np.uint64)
        for d in range(DEPTH):
            band = (band ^ least[:, d::DEPTH]) * np.uint64(0x9E3779B97F4A7C15)
        band += np.arange(BANDS, dtype=np.uint64)
        for i, s, b in zip(full, short, band.view(np.int64).tolist()):
            sig[i], keys[i] = s.tobytes(), b
    return sig, keys


def parity(s: np.ndarray) -> bytes:
    """Bitmap of odd and even counts: two sets differ in at least as many shingles as their bitmaps in bits."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % MAP, minlength=MAP) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _classes(df: DataFrame, text: str) -> DataFrame:
    """_h of each row, its class _k, number of shingles n, fingerprint fp, sig, map and bands."""

    def run(it):
        for pdf in (whole.iloc[i:i + BLOCK] for whole in it for i in range(0, len(whole), BLOCK)):
            sets = [np.unique(shingles(t)) for t in pdf[text]]
            sig, bands = signatures(sets)
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"_h": pdf["_h"].to_numpy(), "_k": keys, "n": [len(s) for s in sets], "fp": np.array([bits_of(s) for s in sets], dtype=np.int64), "sig": sig, "map": [parity(s) for s in sets], "bands": bands})
        give_back()

    return df.select("_h", text).mapInPandas(run, "_h long, _k long, n long, fp long, sig binary, map binary, bands array<long>")


def _sets(df: DataFrame, text: str) -> DataFrame:
    """_k and its distinct shingles, of rows that have _h and _k."""

    def run(it):
        for pdf in (whole.iloc[i:i + BLOCK] for whole in it for i in range(0, len(whole), BLOCK)):
            yield pd.DataFrame({"_k": pdf["_k"].to_numpy(), "toks": [np.unique(shingles(t)).view(np.int64) for t in pdf[text]]})
        give_back()

    return df.select("_k", text).mapInPandas(run, "_k long, toks array<long>")


@F.pandas_udf(IntegerType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many minimum hashes are equal."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


def _sizes(a: Column, b: Column) -> Column:
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PART


def _pruned(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that may be similar enough by their sizes and minimum hashes."""
    x, y = (one.select(F.col("_k").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("n", "sig")]) for k in "ab")
    near = pairs.distinct().join(x, "a").join(y, "b").filter(_sizes(F.col("na"), F.col("nb")))
    return near.withColumn("agree", _agree("siga", "sigb")).filter(F.col("agree") * 2 >= BANDS * DEPTH).select("a", "b")


def joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """a, b: links between classes of one pair of tiles that join all their components which hold a similar pair across them.

    Sizes, minimum hashes and parity bitmaps decide for all pairs of a class at once, whole sets for those that pass, the likeliest
    first; pairs whose components have been joined meanwhile need no look. So at most one link for each component leaves the task.
    """
    one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    same = pdf["tile_a"].iloc[0] == pdf["tile_b"].iloc[0]
    two = one if same else two
    if not len(one) or not len(two):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    cols = lambda d: (d["_k"].to_numpy(), d["c"].to_numpy(), d["n"].to_numpy(), *(np.frombuffer(b"".join(d[c]), dtype=t).reshape(len(d), -1) for c, t in (("sig", np.uint8), ("map", np.uint64))), d["toks"].to_numpy())
    (ka, ca, na, sa, ma, ta), (kb, cb, nb, sb, mb, tb) = cols(one), cols(two)
    both = np.unique(np.concatenate([ca, cb]), return_inverse=True)[1]
    ca, cb, out = both[:len(ca)], both[len(ca):], []
    for i in range(len(ka)):
        ok = (ca[i] != cb) & (np.minimum(na[i], nb) * WHOLE >= np.maximum(na[i], nb) * PART)
        ok[:i + 1] &= not same
        j = np.flatnonzero(ok)
        j = j[np.bitwise_count(ma[i] ^ mb[j]).sum(axis=1) * (PART + WHOLE) <= na[i] + nb[j]]
        agree = (sa[i] == sb[j]).sum(axis=1)
        likely = agree * 2 >= BANDS * DEPTH
        for x in j[likely][np.argsort(-agree[likely], kind="stable")]:
            if ca[i] != cb[x] and len(np.intersect1d(ta[i], tb[x], assume_unique=True)) * (PART + WHOLE) >= (na[i] + nb[x]) * PART:
                out.append((max(ka[i], kb[x]), min(ka[i], kb[x])))
                lo, hi = sorted((ca[i], cb[x]))
                ca, cb = np.where(ca == hi, lo, ca), np.where(cb == hi, lo, cb)
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _rest(entries: DataFrame, comp: DataFrame, one: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """Links (a, b) between components whose classes share a band; the hubs have been compared."""
    e = entries.join(comp, entries["_k"] == comp["node"], "left").select("band", "hub", "_k", F.coalesce("component", "_k").alias("c")).filter("_k != hub")
    live = e.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("band")
    e = materialize(e.join(live, "band", "left_semi").select("band", "_k", "c"), "open")
    used = materialize(e.select("_k").distinct().join(one.select("_k", "_h", "n", "sig", "map"), "_k"), "used")
    sets = _sets_of(used, df, text)
    whole = e.join(used.drop("_h"), "_k").join(sets, "_k")
    plan = tile_plan(whole, "band", "_k", tile_rows=TILE, weight=F.greatest(F.lit(1), F.col("n") / TILE_TOKENS))

    def run(it):
        held = None
        for pdf in it:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            ends = [0, *(np.flatnonzero(pdf["pair"].to_numpy()[1:] != pdf["pair"].to_numpy()[:-1]) + 1).tolist(), len(pdf)]
            for lo, hi in zip(ends[:-2], ends[1:-1]):
                got = joined(pdf.iloc[lo:hi])
                if len(got):
                    yield got
            held = pdf.iloc[ends[-2]:]
        if held is not None and len(held):
            got = joined(held)
            if len(got):
                yield got

    plan = plan.select(F.xxhash64("band", "tile_a", "tile_b").alias("pair"), F.xxhash64("tile_a").alias("tile_a"), F.xxhash64("tile_b").alias("tile_b"), "side", "_k", "c", "n", "sig", "map", "toks")
    with arrow_rows(df.sparkSession, BLOCK):
        out = materialize(plan.repartition("pair").sortWithinPartitions("pair").mapInPandas(run, "a long, b long"), "rest")
    for t in (e, used, sets):
        release(t)
    return out


def _sets_of(used: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """_k, toks: the set of each class; ``used`` has its row _h. Equal rows have equal texts: one of them is enough."""
    texts = df.select("_h", text).join(small(used.select("_k", "_h"), used.count(), 32), "_h")
    with arrow_rows(df.sparkSession, BLOCK * 2):
        sets = materialize(_sets(texts, text), "sets")
    many = materialize(sets.groupBy("_k").agg(F.count("*").alias("n")).filter("n > 1").select("_k"), "equal")
    once = sets
    if not many.isEmpty():
        side = small(many, many.count(), 16)
        once = materialize(sets.join(side, "_k", "left_anti").unionByName(sets.join(side, "_k").groupBy("_k").agg(F.any_value("toks").alias("toks"))), "sets")
        release(sets)
    release(many)
    return once


def _verified(pairs: DataFrame, one: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough; ``one`` has one row for each class, ``df`` the texts."""
    near = materialize(pairs, "pairs")
    m = near.count()
    used = near.select(F.explode(F.array("a", "b")).alias("_k")).distinct().join(one.select("_k", "_h"), "_k")
    used = materialize(used, "used")
    once = _sets_of(used, df, text)
    left = once.withColumnsRenamed({"_k": "a", "toks": "ta"}).join(small(near, m, 32), "a")
    hubs = materialize(near.select(F.col("b").alias("_k")).distinct(), "hubs")
    right = once.join(small(hubs, hubs.count(), 16), "_k").withColumnsRenamed({"_k": "b", "toks": "tb"})
    both = left.join(right, "b").select("a", "b", (F.size("ta") + F.size("tb")).alias("n"), F.size(F.array_intersect("ta", "tb")).alias("both"))
    links = materialize(both.filter(F.col("both") * (PART + WHOLE) >= F.col("n") * PART).select("a", "b"), "links")
    for t in (near, used, once, hubs):
        release(t)
    return links


def near_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """(_h, component) for the rows of ``df``, which holds a key _h of its rows; equal keys have equal texts."""
    with arrow_rows(df.sparkSession, BLOCK * 2):
        rows = materialize(_classes(df, text), "classes")
    # one row stands for each class
    first = materialize(rows.groupBy("_k").agg(F.min("_h").alias("_h")), "first")
    one = rows.filter("n > 0").join(small(first, first.count(), 32), ["_k", "_h"])
    one = materialize(one.groupBy("_k", "_h").agg(*[F.any_value(c).alias(c) for c in ("n", "fp", "sig", "map", "bands")]), "one")
    held = materialize(rows.select("_h", "_k"), "keys")
    release(rows)
    release(first)

    # the trie's forest of fingerprints, and classes of one fingerprint with the first of them
    named = materialize(one.groupBy("fp").agg(F.min("_k").alias("k")), "fingerprints")
    x, y = (named.select(F.col("fp").alias(f), F.col("k").alias(f"k{f}")) for f in "ab")
    trie = near_links(named, BITS).join(x, "a").join(y, "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    same = one.join(named, "fp").filter("_k != k").select(F.col("_k").alias("a"), F.col("k").alias("b"))

    # each class with the hub of each band it shares: its least class
    entries = one.select("_k", F.explode("bands").alias("band"))
    shared = materialize(entries.groupBy("band").agg(F.min("_k").alias("hub"), F.max("_k").alias("hi")).filter("hub < hi").select("band", "hub"), "bands")
    entries = materialize(entries.join(small(shared, shared.count(), 32), "band"), "entries")
    hubs = entries.filter("_k != hub").select(F.col("_k").alias("a"), F.col("hub").alias("b"))
    links = _verified(_pruned(trie.unionByName(same).unionByName(hubs), one), one, df, text)

    # what is left: pairs of classes that share a band and are in different components
    comp = materialize(connected_components(links), "components")
    settle(df.sparkSession)
    rest = _rest(entries, comp, one, df, text)
    # they join components, not classes: what is joined already is not gone through again
    over = materialize(connected_components(_between(rest, comp)), "joined")
    for t in (one, named, shared, entries, rest, links):
        release(t)
    to = held.join(comp, held["_k"] == comp["node"], "left").select("_h", F.coalesce("component", "_k").alias("c"))
    more = over.select(F.col("node").alias("c"), F.col("component").alias("to"))
    return to.join(small(more, over.count(), 32), "c", "left").select("_h", F.coalesce("to", "c").alias("component"))


def _between(links: DataFrame, comp: DataFrame) -> DataFrame:
    """The links (a, b) between classes as links between their components; a class that ``comp`` does not name is its own."""
    for k in "ab":
        side = comp.select(F.col("node").alias(k), F.col("component").alias("c"))
        links = links.join(side, k, "left").withColumn(k, F.coalesce("c", k)).drop("c")
    return links.select("a", "b").distinct()
