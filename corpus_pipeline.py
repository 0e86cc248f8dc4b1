"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, shards.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of ``documents``
(the last one: the shard table). Everything works on whole texts and whole tables.

For all stages: extra columns are kept whatever their names, ties go by hashes and ids as the operators say, very long texts
are whole rows like any other, and an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, language_id, mixing, sharding, shingle_join
from gristmill.llm.common import crc_mod, free, small, table
from gristmill.sources.materialize import materialize, release

#: The winning language's posterior below which a text is rejected.
LEAST_SCORE = 0.5


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or that no language wins with ``LEAST_SCORE``.

    Null lang, id or source does not matter; repeated rows are judged alike. Without any labelled row every text is rejected.
    """
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2)
    lang, score = free(docs, "lang_pred", "score")
    return language_id.identify(docs, model, names=(lang, score)).filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8 or more, linked in chains).

    Candidates come from the SimHash trie and, for what its bits cannot reach, from MinHash bands; all are checked exactly. Null and
    empty texts are one group, equal rows are one row. The row with the smallest doc_id stays, one without a doc_id only where no row of
    the group has one; rows are told apart by a hash of all their columns, so texts that share a doc_id or have none link like any other.
    """
    (h,) = free(docs, "_h")
    named = docs.withColumn(h, F.xxhash64(*docs.columns))
    slim = named.select(F.col(h).alias("_h"), "doc_id", "text")
    found = shingle_join.near_classes(slim).groupBy("_h").agg(F.min("component").alias("component"), F.count("*").alias("n"))
    rows = materialize(found.join(slim.select("_h", "doc_id").distinct(), "_h"), "groups")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h")).alias("r")).select("component", F.col("r._h").alias("best"))
    drop = materialize(rows.join(best, "component").select(F.col("_h").alias("_gone"), (F.col("_h") == F.col("best")).alias("_stays"), "n").filter("NOT _stays OR n > 1"), "drop")
    many = materialize(drop.filter("_stays").select("_gone"), "many")
    out = named.join(small(drop, drop.count(), 32), named[h] == drop["_gone"], "left_anti")
    # equal rows are reduced to one
    again = named.join(small(many, many.count(), 16), named[h] == many["_gone"], "left_semi").groupBy(h).agg(F.min(F.struct(*docs.columns)).alias(h + "r")).select(h + "r.*")
    return out.select(*docs.columns).unionByName(again)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold a benchmark passage of five words or more. Null and empty texts and null ids stay, repeated rows go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target; rows repeat for further epochs.

    Rows without words (null, empty) add nothing and go. Null sources are one source; null ids are allowed; repeated rows share a key.
    """
    return mixing.mixed_rows(docs)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns shards and slots: equal texts share a shard, null texts count as empty, repeated rows get slots of their own."""
    return sharding.shard(docs)


STAGES = [("language_id", stage_language), ("simhash_dedup", stage_near_duplicates), ("decontaminate", stage_decontaminate), ("mix", stage_mix), ("shard", stage_shard)]
#: Shingle sets and the language model are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            release(before)
    return docs
