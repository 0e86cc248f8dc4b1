"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

A text becomes an array of word hashes. At each position each fixed mask picks four of the next five words and hashes
them, so a substitution at the ignored position does not change the seed. Test seeds and training seeds meet in a hash
join, and a hit is verified on its diagonal: some ``WINDOW`` consecutive item words that hold the seed (the whole item, if it is
shorter) must equal the training words in at least ``SHARE`` of their places. The masks reach every allowed pattern of
substitutions in windows of 5 to 13 words but one (8 words, the two middle ones replaced). Items of fewer than 5 words
are matched exactly, as a whole.

Texts are cut into overlapping pieces (of 128^2, then of 128 positions) before their positions become rows, so work and
memory stay near linear in the length of a text, and a hit carries the 22 training words around it. Seeds of the benchmark are broadcast while their counted bytes fit
the bound; then the training texts are never shuffled. Beyond the bound (id, position, seed) rows are joined by shuffle,
salted against frequent seeds, and only texts with a hit are read again. Both plans give the same rows.

Null and empty texts have no words. Equal rows of doc_id and text are reported once, other texts of the same doc_id on
their own; a null doc_id is kept. Other columns are not read, so their names cannot clash. Ties do not matter: the best
window counts. Empty inputs give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import BROADCAST_BYTES, free, small, table, text_or_empty
from gristmill.sources.materialize import materialize

MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: Masks for whole items of one, two and three words; they are used only where the benchmark has such items.
SHORT = ((0,), (0, 1), (0, 1, 2))
WINDOW, SHARE, SPAN, CHUNK, SALTS = 13, 0.75, 5, 128, 16
#: Words around a hit that a window with the first four words of the seed can reach: BACK before its position, REACH in all.
BACK = WINDOW - 4
REACH = BACK + WINDOW


def word_hashes(text: str | Column) -> Column:
    words = F.array_remove(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(h: Column, i: Column, masks: dict[int, tuple[int, ...]]) -> Column:
    """The seeds at position ``i`` (from 0) of the word hashes ``h``; masks that reach beyond the text give null."""
    one = lambda m, mask: F.when(i + mask[-1] < F.size(h), F.xxhash64(F.lit(m), *[F.get(h, i + o) for o in mask]))
    return F.array(*[one(m, mask) for m, mask in masks.items()])


def _around(h: Column, i: Column) -> Column:
    """The REACH words from BACK before ``i``; null beyond the ends."""
    return F.transform(F.sequence(F.lit(0), F.lit(REACH - 1)), lambda k: F.when(i - BACK + k >= 0, F.get(h, i - BACK + k)))


def _pieces(df: DataFrame, size: int, last: Column) -> DataFrame:
    """Cuts h, whose first word is at position ``off`` of its text, into pieces of ``size`` positions from ``at`` to ``last``.

    Each has BACK words before and WINDOW words after them.
    """
    df = df.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.col("at"), last, F.lit(size)))))
    lo = F.greatest(F.lit(0), F.col("at") - BACK)
    return df.withColumns({"h": F.slice("h", lo - F.col("off") + 1, F.col("at") + size + WINDOW - lo), "off": lo})


def _places(df: DataFrame, masks: dict[int, tuple[int, ...]], around: bool) -> DataFrame:
    """doc_id, text_hash, i, seed of every position of every text (and k, its place in h, a piece of the text); ``df`` has the hashes h."""
    df = df.withColumns({"n": F.size("h"), "at": F.lit(0), "off": F.lit(0)})
    large = CHUNK * CHUNK
    df = _pieces(_pieces(df, large, F.col("n") - 1), CHUNK, F.least(F.col("n"), F.col("at") + large) - 1)
    df = df.withColumn("i", F.explode(F.sequence(F.col("at"), F.least(F.col("n"), F.col("at") + CHUNK) - 1))).withColumn("k", F.col("i") - F.col("off"))
    out = df.select("doc_id", "text_hash", "i", *(["k", "h"] if around else []), F.explode(_seeds(F.col("h"), F.col("k"), masks)).alias("seed"))
    return out.filter("seed IS NOT NULL")


def _verified(hits: DataFrame) -> DataFrame:
    """hits: doc_id, text_hash, i, w, item_id, ih, j. One row per document text and item that passes at some hit."""
    n, j = F.size("ih"), F.col("j")
    equal = F.zip_with("w", _around(F.col("ih"), j), lambda x, y: F.coalesce(x == y, F.lit(False)))
    # exploding an array of one value keeps the optimizer from computing it once for each place it is used in
    hits = hits.select("doc_id", "text_hash", "i", "item_id", "j", n.alias("n"), F.explode(F.array(equal)).alias("eq"))
    size = F.least(F.col("n"), F.lit(WINDOW))
    need = F.when(F.col("n") < SPAN, F.col("n")).otherwise(F.ceil(size * SHARE))
    # windows that lie in the item and hold the seed, by their first word relative to BACK before the hit
    lo = F.greatest(F.lit(0), F.lit(BACK) - j)
    hi = F.least(F.lit(BACK), F.col("n") - size - j + BACK)
    same = F.transform(F.sequence(lo, hi), lambda s: F.size(F.filter(F.slice("eq", s + 1, size), lambda x: x)))
    ok = hits.withColumn("m", F.explode(F.array(F.array_max(same)))).filter(F.col("m") >= need)
    return ok.groupBy("doc_id", "text_hash", "item_id").agg(F.max("n").alias("item_words"), F.max("m").alias("matched_words"), F.count_distinct("i", "j").alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, item_id, item_words, matched_words (best window), hits (places verified); one row per document text and item.

    Items of fewer than ``least_words`` words are left out.
    """
    items = materialize(benchmark.select(F.col(item_id).alias("item_id"), word_hashes(item_text).alias("ih")).filter(F.size("ih") >= max(1, least_words)), "items")
    words, n_items, *few = items.agg(F.coalesce(F.sum(F.size("ih")), F.lit(0)), F.count("*"), *[F.count_if(F.size("ih") == len(m)) for m in SHORT]).first()
    masks = dict(enumerate(MASKS)) | {len(MASKS) + k: m for k, m in enumerate(SHORT) if few[k]}
    at = F.explode(F.sequence(F.lit(0), F.size("ih") - 1)).alias("j")
    seeds = items.select("item_id", "ih", at).select(F.explode(_seeds(F.col("ih"), F.col("j"), dict(enumerate(MASKS)))).alias("seed"), "item_id", "j")
    for m, mask in masks.items():
        if mask in SHORT:
            whole = items.filter(F.size("ih") == len(mask))
            seeds = seeds.unionByName(whole.select(F.explode(_seeds(F.col("ih"), F.lit(0), {m: mask})).alias("seed"), "item_id", F.lit(0).alias("j")))
    seeds = seeds.filter("seed IS NOT NULL").distinct()
    t = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), word_hashes(text).alias("h"))
    if words * (len(masks) * 32 + 8) <= broadcast_bytes:
        hits = _places(t, masks, True).join(F.broadcast(seeds), "seed")
        hits = hits.select("doc_id", "text_hash", "i", "item_id", "j", _around(F.col("h"), F.col("k")).alias("w"))
        return _verified(hits.join(F.broadcast(items), "item_id"))
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = _places(t, masks, False).withColumn("salt", F.pmod(F.xxhash64("doc_id", "i"), F.lit(SALTS)).cast("int"))
    hits = materialize(places.join(salted, ["seed", "salt"]).select("doc_id", "text_hash", "i", "item_id", "j").distinct(), "hits")
    have = materialize(hits.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "hit")
    key = lambda a: F.col("_d").eqNullSafe(a["doc_id"]) & (F.col("_t") == a["text_hash"])
    read = t.join(small(have, have.count(), 32), key(t), "left_semi").groupBy("doc_id", "text_hash").agg(F.any_value("h").alias("h"))
    read = read.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "h")
    back = hits.join(read, key(hits)).select("doc_id", "text_hash", "i", _around(F.col("h"), F.col("i")).alias("w"), "item_id", "j")
    return _verified(back.join(small(items, words, 16), "item_id"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", least_words: int = SPAN) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark passage, with their columns.

    Items of fewer than ``least_words`` words are no passage: single common words would empty the corpus. Null texts stay.
    """
    (key,) = free(docs, "text_hash")
    bad = materialize(contamination(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark, least_words=least_words).select(F.col("text_hash").alias(key)).distinct(), "bad")
    return docs.join(small(bad, bad.count(), 16), F.xxhash64(docs[text]) == F.col(key), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
