"""Quality scores by a hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A word counts as itself, as its shape (runs of letters of one case, digits and other characters, each run as one character) and
as equal or not to the words before it. N-grams of these are hashed to ``2^BITS`` weights; a feature's value is its share among the text's n-grams of
its kind. Training is FTRL-Proximal with a rate per coordinate: ``SHARDS`` shards, dealt by hash, are learned online by a task each from
the common state, whose sums are then averaged, for ``ROUNDS`` rounds. Shards and their order come from hashes, so the model does not
depend on the number of partitions or executors. Scores are sparse dot products over all n-grams of whole texts, in blocks of texts.

The model is fitted on a bounded sample: about ``SAMPLE`` labelled texts (all if there are fewer), chosen by a hash of id and text. What
the driver holds is two numbers per weight and shard; features stay in a table and are read batch by batch. Everything is scored.

Labels other than 0 and 1 and labels without an id teach nothing; an id with several labels teaches their mean; equal rows teach once, rows that share an id each. Without
any labelled text every score is 0.5. Null and empty texts get the score of a text without words (the bias alone). Repeated rows are
scored each; ties cannot matter. An empty table gives an empty result. Columns named score or predicted are replaced, others kept
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import arrow_rows, crc_mod, give_back, small, table
from gristmill.sources.materialize import materialize, release

#: Weights (2^BITS and a bias), labelled texts of the sample, shards and rounds of training, tokens of a block, words remembered by a task.
BITS, SAMPLE, SHARDS, ROUNDS, BLOCK, MOST_WORDS = 18, 20_000, 8, 4, 1 << 17, 1 << 18
#: FTRL: learning rate and its smoothing, both penalties; SCALE is the sum of a kind's feature values.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 1e-4, 1e-4, 8.0
#: Score from which a text is predicted to have label 1.
THRESHOLD = 0.3

_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word to number; arrays hold the hashes of the word and of its shape."""

    def __init__(self):
        super().__init__()
        self.word, self.shape = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)

    def __missing__(self, w: bytes) -> int:
        i = len(self)
        if i == len(self.word):
            self.word, self.shape = (np.concatenate([a, np.zeros(i, np.uint64)]) for a in (self.word, self.shape))
        self[w] = i
        self.word[i] = xxhash.xxh64_intdigest(w, 1)
        self.shape[i] = xxhash.xxh64_intdigest(_RUN.sub(rb"\1", w.translate(_SHAPE)), 2)
        return i


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return ((((h ^ np.uint64(kind)) * _MULT) ^ (h >> np.uint64(29))) * _MULT >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(w: np.ndarray, s: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the text of each one, and its slot. w, s: word and shape hashes of the tokens; who: their texts, ascending."""
    two = who[1:] == who[:-1]
    three = two[1:] & two[:-1]
    yield who, _slots(w, 1)
    yield who, _slots(s, 2)
    pair, here = who[1:][two], lambda a: (a[:-1] * _MULT + a[1:])[two]
    yield pair, _slots(here(w), 3)
    yield pair, _slots(here(s), 4)
    yield who[2:][three], _slots(((s[:-2] * _MULT + s[1:-1]) * _MULT + s[2:])[three], 5)
    same = (w[1:] == w[:-1]).astype(np.uint64)
    yield pair, _slots(same[two], 6)
    yield who[2:][three], _slots((same[1:] + np.uint64(2) * same[:-1] + np.uint64(4) * (w[2:] == w[:-2]).astype(np.uint64))[three], 7)


def _blocks(texts: Sequence[str | None], words: Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts lo to hi of about BLOCK tokens or one long text: lo, hi and the arrays of :func:`ngrams`, who from 0."""
    lo, held, size = 0, [], 0
    for i, t in enumerate(texts):
        tokens = (t or "").encode("utf-8", "surrogatepass").split()
        held.append(np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
        size += len(tokens)
        if size >= BLOCK or i == len(texts) - 1:
            ids = np.concatenate(held)
            yield lo, i + 1, words.word[ids], words.shape[ids], np.repeat(np.arange(len(held)), [len(x) for x in held])
            lo, held, size = i + 1, [], 0
            if len(words) > MOST_WORDS:
                words.clear()


def features(texts: Sequence[str | None], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text."""
    for lo, hi, w, s, who in _blocks(texts, words):
        keys, values = [], []
        for at, slot in ngrams(w, s, who):
            n = np.bincount(at, minlength=hi - lo)
            k, c = np.unique((at << BITS) | slot, return_counts=True)
            keys.append(k)
            values.append(c * SCALE / n[k >> BITS])
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        v = np.bincount(at, weights=np.concatenate(values), minlength=len(k)) if len(k) else np.zeros(0)
        ends = np.searchsorted(k, np.arange(hi - lo + 1) << BITS)
        for a, b in zip(ends[:-1], ends[1:]):
            yield (k[a:b] & ((1 << BITS) - 1)).astype(np.int32), v[a:b].astype(np.float32)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader under both penalties."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, slots: np.ndarray, x: np.ndarray, y: float) -> None:
    """One update in place; the last coordinate is the bias."""
    slots, x = np.append(slots, len(z) - 1), np.append(x, 1.0)
    zs, ns = z[slots], n[slots]
    w = weights(zs, ns)
    g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
    more = ns + g * g
    z[slots] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
    n[slots] = more


class Model:
    def __init__(self, w: np.ndarray):
        self.w, self.bias = w[:-1].astype(np.float32), float(w[-1])

    def scores(self, texts: Sequence[str | None], words: Words | None = None) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for lo, hi, w, s, who in _blocks(texts, Words() if words is None else words):
            for at, slot in ngrams(w, s, who):
                n = np.bincount(at, minlength=hi - lo)
                out[lo:hi] += SCALE * np.bincount(at, weights=self.w[slot], minlength=hi - lo) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text: str, label: str, most: int) -> DataFrame:
    """u, y, text of about ``most`` labelled texts; ids and hashes are joined first, texts are read only for what is chosen."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label).alias("y"))
    rows = docs.filter(train).select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text).alias("u"), F.col(text).alias("_text"))
    known = materialize(rows.groupBy("_id", "u").agg(F.lit(1).alias("one")).join(marks, "_id").select("_id", "u", "y"), "labelled")
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("u"), F.lit(1 << 40)) < int(min(1.0, most / max(n, 1)) * (1 << 40)))
    return rows.join(small(chosen, min(n, 2 * most), 32), ["_id", "u"]).select("u", "y", "_text")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> Model:
    """A model of ``label`` (0 or 1) from the texts of ``docs`` that ``train`` admits."""
    spark = docs.sparkSession

    def encode(it):
        words = Words()
        for pdf in it:
            got = list(features(pdf["_text"].tolist(), words))
            yield pd.DataFrame({"u": pdf["u"].to_numpy(), "y": pdf["y"].to_numpy(), "slots": [s for s, _ in got], "x": [x for _, x in got]})
        give_back()

    with arrow_rows(spark, 128):
        rows = _sample(docs, labels, F.lit(True) if train is None else train, id_col, text, label, most)
        rows = materialize(rows.mapInPandas(encode, "u long, y double, slots array<int>, x array<float>").withColumn("shard", F.pmod("u", F.lit(SHARDS))), "features")
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        for r in range(ROUNDS):
            state = spark.sparkContext.broadcast((z, n))
            order = F.xxhash64(F.lit(r), "u")  # another order each round

            def run(it, state=state):
                def out():
                    at = np.flatnonzero((zs != state.value[0]) | (ns != state.value[1]))
                    return pd.DataFrame({"shard": [shard], "at": [at.tobytes()], "z": [zs[at].tobytes()], "n": [ns[at].tobytes()]})

                shard, last = None, None
                for pdf in it:
                    for k, u, y, slots, x in zip(pdf["shard"], pdf["u"], pdf["y"], pdf["slots"], pdf["x"]):
                        if k != shard:
                            if shard is not None:
                                yield out()
                            shard, zs, ns = k, *(a.copy() for a in state.value)
                        if u != last:  # equal rows lie side by side
                            learn(zs, ns, slots, x, y)
                        last = u
                if shard is not None:
                    yield out()

            dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", order, "u")
            got = sorted(dealt.mapInPandas(run, "shard long, at binary, z binary, n binary").collect(), key=lambda g: g["shard"])  # one row per shard
            if not got:
                break
            dz, dn = np.zeros_like(z), np.zeros_like(n)
            for g in got:
                at = np.frombuffer(g["at"], dtype=np.int64)
                dz[at] += np.frombuffer(g["z"]) - z[at]
                dn[at] += np.frombuffer(g["n"]) - n[at]
            z, n = z + dz / len(got), n + dn / len(got)
            state.unpersist()
    release(rows)
    return Model(weights(z, n))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``threshold`` on)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for s in it:
            yield pd.Series(held.value.scores(s.tolist(), words))
        give_back()

    kept = [c for c in df.columns if c not in ("score", "predicted")]
    # texts leave and come back under names of their own
    rows = df.select(*[df[c].alias(f"_in{i}") for i, c in enumerate(kept)], run(df[text]).alias("_s"))
    return rows.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)], F.col("_s").alias("score"), (F.col("_s") >= threshold).cast("int").alias("predicted"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = crc_mod("doc_id", 5) == 0
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), fit(docs, labels, ~held_out)).select("doc_id", "held_out", "score", "predicted")
