"""Language identification by prediction by partial matching.

One variable-order byte context tree per language: the blended form of PPM with escape method C, where a context of n
bytes, d of them distinct, escapes to the next shorter one with weight d / (n + d), and the empty context to 256 equal
bytes. Statistics are counted once, frozen, and turned into tables of exact code lengths; the language with the
shortest code wins. A block of texts is coded once per distinct gram, not once per byte.

The bytes are those of the lower-cased text, runs of ASCII characters that are no letters as one space. Contexts have up to
``ORDER`` bytes and none is left out unless ``LEAST_SEEN`` is raised, which smaller tables pay with code lengths that are a little off. The model is fitted on a
bounded sample: ``SAMPLE_DOCS`` labelled rows per language are expected, chosen by a hash of id and text; its size does not grow with the
input. Scoring covers every byte of every text, very long ones in pieces.

Null texts and texts without a letter give ``und`` with score 0, as does everything when there is no labelled row. Ties
go to the language first in code-point order. Rows with a null lang, or that ``train`` leaves out, teach nothing. Repeated rows teach
and are judged each. Columns named lang_pred or score are replaced, others kept whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import crc_mod, free, give_back, small, table
from gristmill.sources.materialize import materialize, release

SAMPLE_DOCS, ORDER, LEAST_SEEN, BLOCK = 1500, 4, 1, 1 << 17
#: Distinct grams of the sample over all languages, 24 bytes each, that a model may be made of.
MOST_GRAMS = 20_000_000


@lru_cache(1)
def _fold() -> np.ndarray:
    """Byte to byte: ASCII that is no letter becomes a space, capitals become small."""
    c = np.arange(256, dtype=np.uint8)
    c[:128] = 32
    c[97:123] = c[65:91] = np.arange(97, 123)
    return c


def symbols(text: str) -> np.ndarray:
    """Bytes of the folded text, runs of spaces as one, after ORDER spaces as a start."""
    s = _fold()[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    return np.concatenate([np.full(ORDER, 32, dtype=np.uint8), s[keep]])


def grams(s: np.ndarray) -> np.ndarray:
    """A number per byte after the start: its ORDER bytes of context, oldest first, then itself."""
    n = len(s) - ORDER
    k = np.zeros(n, dtype=np.int64)
    for j in range(ORDER + 1):
        k = (k << 8) | s[j:n + j]
    return k


def _pieces(texts: Sequence[str], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Grams of the texts in lots of about ``most``, with the index of the text each piece is from."""
    who, held, size = [], [], 0
    for i, t in enumerate(texts):
        s = symbols(t)
        for a in range(0, len(s) - ORDER, most):
            g = grams(s[a:a + most + ORDER])
            who.append(i)
            held.append(g)
            size += len(g)
            if size >= most:
                yield who, held
                who, held, size = [], [], 0
    if held:
        yield who, held


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _find(keys: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each k is in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=bool)
    i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return i, keys[i] == k


class Model:
    """Per order the known edges (context and byte) and contexts, with bits per language of each edge and each escape."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], least_seen: int = LEAST_SEEN):
        """counts: per language the grams and how often each was seen; contexts seen fewer than ``least_seen`` times are left out."""
        self.langs = sorted(counts, key=str.encode)
        self.edges: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        if not self.langs:
            return
        levels, totals = [], []
        for order in range(ORDER + 1):
            each = []
            for lang in self.langs:
                k, at = np.unique(counts[lang][0] & self.mask(order), return_inverse=True)
                each.append((k, np.bincount(at, weights=counts[lang][1])))
            edges = np.unique(np.concatenate([k for k, _ in each]))
            seen = np.zeros((len(edges), len(self.langs)))
            for j, (k, c) in enumerate(each):
                seen[np.searchsorted(edges, k), j] = c
            _, at = np.unique(edges >> 8, return_inverse=True)
            levels.append((edges, seen))
            totals.append(np.bincount(at, weights=seen.sum(axis=1))[at])
        p = np.full((1, len(self.langs)), 1 / 256)
        for order, ((edges, seen), total) in enumerate(zip(levels, totals)):
            if order:
                edges, seen = edges[total >= least_seen], seen[total >= least_seen]
                p = p[np.searchsorted(self.edges[-1], edges & self.mask(order - 1))]
            contexts, first, at = np.unique(edges >> 8, return_index=True, return_inverse=True)
            if len(edges):
                n, d = np.add.reduceat(seen, first, axis=0), np.add.reduceat(seen > 0, first, axis=0, dtype=np.float64)
                escape = np.where(n > 0, d / np.maximum(n + d, 1), 1)
                p = seen / np.maximum(n + d, 1)[at] + escape[at] * p
            else:
                escape = np.ones((0, len(self.langs)))
            self.edges.append(edges)
            self.contexts.append(contexts)
            self.bits.append(-np.log2(p).astype(np.float32))
            self.escape.append(-np.log2(escape).astype(np.float32))

    @staticmethod
    def mask(order: int) -> int:
        return (1 << 8 * (order + 1)) - 1

    def gram_bits(self, k: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the others, per language."""
        out, todo = np.zeros((len(k), len(self.langs)), dtype=np.float32), np.arange(len(k))
        for order in range(ORDER, -1, -1):
            part = k[todo] & self.mask(order)
            i, ok = _find(self.edges[order], part)
            out[todo[ok]] += self.bits[order][i[ok]]
            todo, part = todo[~ok], part[~ok]
            i, ok = _find(self.contexts[order], part >> 8)
            out[todo[ok]] += self.escape[order][i[ok]]
        out[todo] += 8
        return out

    def code_lengths(self, texts: Sequence[str]) -> np.ndarray:
        """Bits [text, language]."""
        n = len(self.langs)
        out = np.zeros((len(texts), n))
        for who, held in _pieces(texts, min(BLOCK, max(1 << 14, (1 << 22) // n))):
            k, at = np.unique(np.concatenate(held), return_inverse=True)
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(out, who, np.add.reduceat(self.gram_bits(k)[at], starts, axis=0, dtype=np.float64))
        return out

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior under equal priors of each text."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        if known:
            bits = self.code_lengths([texts[i] for i in known])
            best = bits.argmin(axis=1)
            score[known] = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
            for i, b in zip(known, best.tolist()):
                langs[i] = self.langs[b]
        return langs, score


def _count(it):
    for pdf in it:
        for lang, g in pdf.groupby("lang"):
            for _, held in _pieces(g["text"].tolist(), BLOCK):
                k, c = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"lang": lang, "k": k, "c": c})


def fit(df: DataFrame, train: Column | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, least_seen: int = LEAST_SEEN) -> Model:
    """A model from about ``sample_docs`` rows per language (all of them if there are fewer)."""
    ok = F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = df.filter(ok if train is None else ok & train).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(id_col, text), F.lit(1 << 40)).alias("u"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    share = df.sparkSession.createDataFrame([(r["lang"], int(min(1.0, sample_docs / r["n"]) * (1 << 40))) for r in sizes], "lang string, cut long")
    got = rows.join(small(share, len(sizes), 64), "lang").filter("u < cut").select("lang", "text").mapInPandas(_count, "lang string, k long, c long")
    got = materialize(got.groupBy("lang", "k").agg(F.sum("c").alias("c")), "grams")
    n = got.count()
    if n > MOST_GRAMS:  # one text of the sample may be of any length
        raise ValueError(f"the sample has {n} grams, more than a driver and workers should hold: lower sample_docs")
    held, got = got, got.toArrow().to_pandas()
    release(held)
    return Model({g: (x["k"].to_numpy(), x["c"].to_numpy(dtype=np.float64)) for g, x in got.groupby("lang")}, least_seen)


def identify(df: DataFrame, model: Model, text: str = "text", names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score (the posterior under equal priors) as ``names``, which replace columns of those names."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(s: pd.Series) -> pd.DataFrame:
        langs, score = held.value.predict(s.tolist())
        give_back()
        return pd.DataFrame({"lang_pred": langs, "score": score})

    (found,) = free(df, "found")
    out = df.withColumn(found, run(F.col(text)))
    return out.select(*[c for c in df.columns if c.lower() not in [n.lower() for n in names]], F.col(f"{found}.lang_pred").alias(names[0]), F.col(f"{found}.score").alias(names[1]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), fit(docs, ~held_out)).select("doc_id", "held_out", "lang_pred", "score")
