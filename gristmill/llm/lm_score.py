"""Language-model scoring with a hashed maximum-entropy model and a unigram base.

Counts: every training token is counted by a distributed aggregate; nothing about the vocabulary is capped. Words with a count
over a cut-off that leaves at most ``HEAD`` of them are broadcast and looked up in place; all other tokens are joined with their
counts by shuffle, so no count is approximated and no frequent word is a hot key.

Model: the whole vocabulary is factored into a tree of classes by frequency. A node has ``FAN`` children: half of them words,
the most frequent ones nearest the root, half of them classes of rarer words. In the lowest level that half are buckets of all other
words, by hash, whose words share the bucket's probability by their smoothed counts (one unseen word included). P(word | history) is
the product of the choices on the way; each is a softmax over hashed features: the previous word, a skip feature (the word
before it) and both together, as themselves and whatever their frequency. Levels, buckets and table rows grow with the counted vocabulary.

Training: weights start from the counts of every (feature, choice) pair and take ``ROUNDS`` steps along the gradient, observed less
expected counts; the latter are counted from choices drawn from the model at every token (by a fixed hash), an unbiased estimate. Both
are sums of whole numbers over all tokens of all training texts, made by tasks and added up by block of the tables, so the
model does not depend at all on how the input is split. Texts are tokenized once, to numbers.

Null text counts as empty (its end token is still scored). Repeated rows give a row each, ties in frequency go by the word.
Very long texts are scored whole. Only id and text are read besides ``train``, so other columns cannot clash. With no
training text N is 0 and all tokens get the base's uniform value. Empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import crc_mod, table
from gristmill.sources.materialize import materialize

HEAD, FAN, ROUNDS, BLOCK, LOT, CHUNK, FLUSH, EXTRA = 1 << 17, 16, 1, 1024, 1 << 18, 1 << 15, 300_000, 11
HALF = FAN // 2
#: Most bits of a row number of the smaller tables (weights of 13 MB) and tokens a task sums at least, so that its sums are small beside its input; shares of the three features in the starting weights, the pseudo counts of their estimates, and the length and damping of a step.
MOST_BITS, TASK_TOKENS, START_SHARE, PSEUDO, RATE, DAMPING = 15, 1 << 22, (0.5, 0.4, 0.5), 16.0, 1.2, 100.0
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NO_WORD = 0
ONES = np.ones(FAN, dtype=np.float32)
LOG10 = math.log(10)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def levels_for(distinct: int) -> int:
    """4 levels up to 2^24 words, one more for each 8 times as many (at most 6)."""
    return min(6, max(4, 4 + -(-(max(distinct, 1).bit_length() - 24) // 3)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ x >> np.uint64(31)) * MIX[0]
    x = (x ^ x >> np.uint64(29)) * MIX[1]
    return x ^ x >> np.uint64(32)


class Tree:
    """Leaves: words by rank, then buckets. Nodes by level; path and choice of each leaf at each level."""

    def __init__(self, levels: int):
        self.levels = levels
        first = [(HALF ** k - 1) // (HALF - 1) for k in range(levels + 1)]  # number of the first node of each level
        self.nodes, self.buckets = first[levels], HALF ** levels
        self.words = sum(HALF ** (k + 1) for k in range(levels))
        path, choice, depth = [], [], []
        for k in range(levels):
            i = np.arange(HALF ** (k + 1))
            path.append(self._up(i // HALF, k, first))
            choice.append(self._turns(i // HALF, k, i % HALF))
            depth.append(np.full(len(i), k + 1))
        b, k = np.arange(self.buckets), levels - 1
        path.append(self._up(b // HALF, k, first))
        choice.append(self._turns(b // HALF, k, HALF + b % HALF))
        depth.append(np.full(len(b), levels))
        self.path, self.choice = (np.ascontiguousarray(np.concatenate(x).T) for x in (path, choice))  # [level, leaf]
        self.depth = np.concatenate(depth).astype(np.int64)

    def _up(self, node: np.ndarray, level: int, first: list[int]) -> np.ndarray:
        out = np.zeros((len(node), self.levels), dtype=np.int32)
        for k in range(level, -1, -1):
            out[:, k] = first[k] + node
            node = node // HALF
        return out

    def _turns(self, node: np.ndarray, level: int, last: np.ndarray) -> np.ndarray:
        out = np.zeros((len(node), self.levels), dtype=np.int32)
        out[:, level] = last
        for k in range(level - 1, -1, -1):
            out[:, k] = HALF + node % HALF
            node = node // HALF
        return out


class MaxEnt:
    """Three tables of weights [row, choice]; each node has rows of its own, as many as its share of all tokens."""

    def __init__(self, mass: np.ndarray, distinct: int, bits: int | None = None):
        """mass: smoothed count of each leaf."""
        self.tree = t = Tree(levels_for(distinct))
        at = np.zeros((t.nodes, FAN))
        for k in range(t.levels):
            on = t.depth > k
            np.add.at(at, (t.path[k, on], t.choice[k, on]), mass[on])
        self.base = np.log(at / at.sum(axis=1, keepdims=True)).astype(np.float32)
        self.bits = bits or min(MOST_BITS, max(12, max(distinct, 1).bit_length() - 4))
        share = at.sum(axis=1) / at[0].sum()
        self.size, self.off, self.node, self.t = [], [], [], []
        for k in range(3):
            rows = np.maximum(2, share / share.sum() * (1 << self.bits + (2 if k == 2 else 0))).astype(np.int64)
            self.size.append(rows)
            self.off.append(np.cumsum(rows) - rows)
            self.node.append(np.repeat(np.arange(t.nodes, dtype=np.int32), rows))
            self.t.append(np.zeros((int(rows.sum()), FAN), dtype=np.float32))

    @staticmethod
    def features(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
        """31 hashed bits of the previous word, of the one before it, and of both."""
        a, b = h1 * MIX[0], h2 * MIX[1]
        return [(x >> np.uint64(33)).astype(np.int64) for x in (a, b, (a ^ (b >> np.uint64(7))) * MIX[0])]

    def rows(self, node: np.ndarray, features: list[np.ndarray]) -> list[np.ndarray]:
        return [self.off[k].take(node) + (features[k] * self.size[k].take(node) >> 31) for k in range(3)]

    def steps(self, y: np.ndarray, h1: np.ndarray, h2: np.ndarray):
        """Per level: the tokens that make a choice there, its node, rows and choice."""
        t, f = self.tree, self.features(h1, h2)
        depth, on = t.depth.take(y), np.arange(len(y))
        for k in range(t.levels):
            if k:
                on = on[depth.take(on) > k]
            if len(on):
                leaf = y.take(on)
                node = t.path[k].take(leaf)
                yield on, node, self.rows(node, [x.take(on) for x in f] if k else f), t.choice[k].take(leaf)

    def _odds(self, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Odds of the choices. Weights are logarithms of ratios of counts, so their exponentials stay finite."""
        z = self.base.take(node, axis=0)
        for k in range(3):
            z += self.t[k].take(rows[k], axis=0)
        return np.exp(z, out=z)

    def logp(self, y: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Log probability of each leaf after its history."""
        out = np.zeros(len(y))
        for on, node, rows, choice in self.steps(y, h1, h2):
            e = self._odds(node, rows)
            p = e.reshape(-1).take(np.arange(0, e.size, FAN) + choice) / (e @ ONES)
            out[on] += np.log(p)
        return out

    def observe(self, y, h1, h2, at, into: list[np.ndarray]) -> None:
        """Adds the counts of (row, choice) pairs."""
        for _, _, rows, choice in self.steps(y, h1, h2):
            for k in range(3):
                np.add.at(into[k].reshape(-1), rows[k] * FAN + choice, 1)

    def expect(self, y, h1, h2, at, into: list[np.ndarray]) -> None:
        """Adds counts of choices drawn from the model, an unbiased estimate of those it expects.

        A token draws at one of its levels, which counts as often as it has levels. The draw is a hash of the token's history, its text and place ``at`` in it, and the node, so it is the same in every run.
        """
        seed = _mixed(_mixed(_mixed(h1) ^ h2) ^ at.astype(np.uint64))
        t, depth = self.tree, self.tree.depth.take(y)
        level = (seed >> np.uint64(20)).astype(np.int64) % depth
        node = t.path.reshape(-1).take(level * len(t.depth) + y)
        rows = self.rows(node, self.features(h1, h2))
        e = self._odds(node, rows).cumsum(axis=1)
        u = (_mixed(seed) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24) * e[:, -1]
        choice = np.minimum((e <= u[:, None]) @ ONES, FAN - 1).astype(np.int64)
        for k in range(3):
            np.add.at(into[k].reshape(-1), rows[k] * FAN + choice, depth)

    def start(self, seen: list[np.ndarray]) -> None:
        """Weights from counts: a share of how much more or less often a feature's row makes a choice than its node does."""
        for k in range(3):
            p = np.exp(self.base)[self.node[k]]
            n = seen[k].sum(axis=1, keepdims=True)
            self.t[k] = (START_SHARE[k] * np.log((seen[k] + PSEUDO * p) / ((n + PSEUDO) * p))).astype(np.float32)

    def step(self, seen: list[np.ndarray], expected: list[np.ndarray]) -> None:
        """One damped step along the gradient, scaled by the counts it rests on."""
        for k in range(3):
            self.t[k] += (RATE * (seen[k] - expected[k]) / (seen[k] + expected[k] + DAMPING)).astype(np.float32)


class Vocabulary:
    """The most frequent words with counts, leaves and history numbers; and the smoothed mass of every bucket."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, docs: int, bucket_mass: np.ndarray, tree: Tree):
        """head: by falling count; bucket_mass: of all words but the first of them that are leaves of their own, one unseen word each."""
        self.rank = {w: i for i, (w, _) in enumerate(head)}
        self.n, self.z = total, total + 0.5 * (distinct + 1)
        c = np.array([c for _, c in head] + [docs], dtype=np.float64)  # the end token comes last
        self.c, self.logp = c, np.log10((c + 0.5) / self.z)
        own = min(len(head), tree.words - 1)
        self.buckets, self.first = tree.buckets, tree.words
        crc = np.array([crc32(w) for w, _ in head] + [0], dtype=np.int64)
        self.leaf = np.where(np.arange(len(c)) < own, np.arange(len(c)) + 1, self.first + crc % self.buckets)
        self.leaf[-1] = 0
        self.code = self.leaf << EXTRA | np.where(self.leaf < self.first, 0, crc >> 32 - EXTRA)
        self.bucket_log = np.log10(bucket_mass)
        self.mass = np.full(tree.words, 1e-6)
        self.mass[1:own + 1], self.mass[0] = c[:own] + 0.5, docs + 0.5
        self.mass = np.concatenate([self.mass, bucket_mass])
        in_bucket = self.leaf >= self.first
        self.share = np.where(in_bucket, np.log10(c + 0.5) - self.bucket_log[np.maximum(self.leaf - self.first, 0)], 0.0)

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Ranks and codes of texts laid end to end, where each text starts, and the words outside the head in their order.

        A rank is -1 outside the head, the end token's comes last; a code is the leaf and, for words in buckets, bits that tell them apart.
        """
        g, end, outside = self.rank.get, len(self.rank), []
        r = np.fromiter((x for toks in texts for x in (*[g(t, -1) for t in toks], end)), dtype=np.int64)
        code = self.code.take(r)
        if (r < 0).any():
            outside = [t for toks in texts for t in toks if t not in self.rank]
            h = np.fromiter(map(crc32, outside), dtype=np.int64, count=len(outside))
            code[r < 0] = self.first + h % self.buckets << EXTRA | h >> 32 - EXTRA
        return r, code.astype(np.int32), np.cumsum([0, *[len(x) + 1 for x in texts[:-1]]]), outside


def history(codes: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves, previous words and the words before them (as numbers), and a number of the text and the place in it, of texts laid end to end."""
    h = codes.astype(np.uint64) + np.uint64(1)
    h1, h2 = np.roll(h, 1), np.roll(h, 2)
    first = np.cumsum([0, *sizes[:-1]])
    h1[first] = h2[first] = NO_WORD
    h2[np.minimum(first + 1, len(h) - 1)] = NO_WORD
    texts = np.array([crc32(codes[a:a + n].tobytes()) for a, n in zip(first, sizes)], dtype=np.int64) << 31
    return codes >> EXTRA, h1, h2, np.arange(len(h)) + np.repeat(texts - first, sizes)


def _lots(it, most: int = LOT):
    """Rows of the batches in lots of about ``most`` codes, each with its codes end to end."""
    for pdf in it:
        sizes = pdf["codes"].map(len).to_numpy()
        lot = np.cumsum(sizes) // most
        for _, part in pdf.groupby(lot, sort=False):
            yield part, np.concatenate(part["codes"].to_list()), part["codes"].map(len).tolist()


def count_tokens(train: DataFrame, text: str = "text") -> DataFrame:
    """(tok, c) of all words of all training texts; partial counts are flushed at FLUSH words, so memory is bounded."""
    def run(it):
        have: Counter = Counter()
        for pdf in it:
            for t in pdf["t"]:
                have.update(words(t))
                if len(have) > FLUSH:
                    yield pd.DataFrame({"tok": list(have), "c": list(have.values())})
                    have = Counter()
        if have:
            yield pd.DataFrame({"tok": list(have), "c": list(have.values())})

    return train.select(F.col(text).alias("t")).mapInPandas(run, "tok binary, c long").groupBy("tok").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the highest counts, as many whole count classes as fit into ``most``; by falling count, then word."""
    bin_ = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 64)).cast("int")
    sizes = sorted(((r["b"], r["n"], r["lo"]) for r in counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("lo")).collect()), reverse=True)  # some 7,000 rows at most
    room, least = most, None
    for _, n, lo in sizes:
        if n > room:
            break
        room, least = room - n, lo
    if least is None:
        return []
    return sorted(((bytes(r["tok"]), r["c"]) for r in counts.filter(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))


def _summed(codes: DataFrame, model: MaxEnt, observed: bool) -> list[np.ndarray]:
    """Observed or expected counts over all codes, whole numbers, added up block by block of the tables."""
    held = codes.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = held.value
        into = [np.zeros(x.shape, dtype=np.int64) for x in m.t]
        any_ = False
        for _, flat, sizes in _lots(it):
            parts, any_ = history(flat, sizes), True
            for i in range(0, len(flat), CHUNK):
                (m.observe if observed else m.expect)(*(x[i:i + CHUNK] for x in parts), into)
        for k in range(3) if any_ else ():
            rows = []
            for b in range(0, len(into[k]), BLOCK):
                part = into[k][b:b + BLOCK].reshape(-1)
                at = np.flatnonzero(part)
                if len(at):
                    v = part[at]
                    rows.append((k, b, at.astype(np.uint16).tobytes(), v.astype(np.uint16 if v.max() < 1 << 16 else np.int64).tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "b", "at", "v"])

    def add(pdf):
        out = np.zeros(BLOCK * FAN, dtype=np.int64)
        for at, v in zip(pdf["at"], pdf["v"]):
            out[np.frombuffer(at, dtype=np.uint16)] += np.frombuffer(v, dtype=np.uint16 if len(v) == len(at) else np.int64)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "b": pdf["b"].iloc[:1], "v": [out.astype(np.float32).tobytes()]})

    out = [np.zeros(x.shape) for x in model.t]
    sums = codes.select("codes").mapInPandas(run, "k int, b long, at binary, v binary").groupBy("k", "b").applyInPandas(add, "k int, b long, v binary")
    for r in sums.collect():  # the tables: 13 MB at most
        part = np.frombuffer(r["v"], dtype=np.float32).reshape(-1, FAN)
        into = out[r["k"]][r["b"]:r["b"] + BLOCK]
        into += part[:len(into)]
    return out


def train_model(codes: DataFrame, mass: np.ndarray, distinct: int, rounds: int = ROUNDS) -> MaxEnt:
    model = MaxEnt(mass, distinct)
    tokens = codes.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    codes = codes.coalesce(max(1, tokens // TASK_TOKENS))
    seen = _summed(codes, model, True)
    model.start(seen)
    for _ in range(rounds):
        model.step(seen, _summed(codes, model, False))
    return model


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row per row of ``df``: id, n_tokens, n_known, train_tokens, base_score, score; sums of log10."""
    spark = df.sparkSession
    counts = materialize(count_tokens(df.filter(train), text), "counts")
    docs = df.filter(train).count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    distinct = v + (docs > 0)
    tree = Tree(levels_for(distinct))
    top = frequent(counts, head)
    bucket = (F.crc32("tok") % tree.buckets).cast("int")
    mass = np.full(tree.buckets, 0.5)
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():  # a row per bucket
        mass[r["b"]] += r["m"]
    for w, c in top[:tree.words - 1]:
        mass[crc32(w) % tree.buckets] -= c + 0.5
    vocab = Vocabulary(top, n + docs, distinct, docs, np.maximum(mass, 0.5), tree)
    known = spark.sparkContext.broadcast(vocab)
    kind = df.schema[id_col].dataType.simpleString()

    def encode(it):
        v = known.value
        for pdf in it:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                r, code, first, outside = v.encode([words(t) for t in part["t"]])
                have = r >= 0
                sums = [np.add.reduceat(np.where(have, x.take(r), 0), first) for x in ((v.c > 0).astype(np.int64), v.logp, v.share)]
                at = np.concatenate([[0], np.add.reduceat(~have, first, dtype=np.int64).cumsum()]).tolist()
                rare = [Counter(outside[a:b]) if b > a else {} for a, b in zip(at, at[1:])]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "train": part["train"].to_numpy(), "codes": np.split(code, first[1:]), "known": sums[0], "base": sums[1], "share": sums[2], "rare": [list(x) for x in rare], "times": [list(x.values()) for x in rare]})

    src = df.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("t"))
    codes = src.mapInPandas(encode, f"id {kind}, train boolean, codes array<int>, known long, base double, share double, rare array<binary>, times array<long>")
    codes = materialize(codes.withColumn("rid", F.monotonically_increasing_id()), "codes")
    model = spark.sparkContext.broadcast(train_model(codes.filter("train"), vocab.mass, distinct, rounds))

    def run(it):
        m = model.value
        for part, flat, sizes in _lots(it):
            y, h1, h2, _ = history(flat, sizes)
            lp = np.concatenate([m.logp(y[i:i + CHUNK], h1[i:i + CHUNK], h2[i:i + CHUNK]) for i in range(0, len(y), CHUNK)]) / LOG10
            yield pd.DataFrame({"id": part["id"].to_numpy(), "rid": part["rid"].to_numpy(), "n": sizes, "known": part["known"].to_numpy(), "base": part["base"].to_numpy(), "model": np.add.reduceat(lp, np.cumsum([0, *sizes[:-1]])) + part["share"].to_numpy()})

    rows = codes.select("id", "rid", "codes", "known", "base", "share").mapInPandas(run, f"id {kind}, rid long, n long, known long, base double, model double")
    # words outside the head, with their exact counts
    rare = codes.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("tok"), F.col("x.times").alias("tf"))
    c = F.coalesce("c", F.lit(0))
    log_mass = spark.createDataFrame(list(enumerate(vocab.bucket_log.tolist())), "b int, log_mass double")
    rare = rare.join(counts, "tok", "left").withColumn("b", bucket).join(F.broadcast(log_mass), "b")
    rare = rare.groupBy("rid").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.log10((c + 0.5) / vocab.z)).alias("b"), F.sum(F.col("tf") * (F.log10(c + 0.5) - F.col("log_mass"))).alias("m"))
    out, zero = rows.join(rare, "rid", "left"), F.lit(0)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("k", zero)).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("m", F.lit(0.0))).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
