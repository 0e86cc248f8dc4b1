import corpus_pipeline as C
from gristmill.llm import registry
from tests.llm.test_native import brute_contamination
from tests.llm.test_shingle_join import brute_components

DIR = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    at, seen = docs, [docs.count()]
    for name, stage in C.STAGES[:3]:
        out = C.materialize(stage(spark, at, DIR), name)
        assert out.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in at.collect()]
        kept = {r["doc_id"] for r in out.collect()}
        if name == "simhash_dedup":
            rows.sort()
            assert kept == {rows[c][0] for c in brute_components([t for _, t in rows])}  # five words, similarity 0.8
        if name == "decontaminate":
            assert kept == {i for i, _ in rows} - {d for d, _ in brute_contamination(rows, bench)}
        at = out
        seen.append(out.count())
    assert seen[1] >= 0.98 * seen[0]
    final = C.run(spark, DIR)
    assert final.count() == C.stage_mix(spark, at, DIR).count() > 0 and {"doc_id", "shard", "slot"} <= set(final.columns)


def test_stages_on_nulls_ties_and_empty(spark):
    a, b, c = "the quick brown fox jumps over the lazy dog again", "der schnelle braune fuchs springt weit", "nobody knows the number of this text"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, None, None, 1), (None, a, "en", "s", 1), (None, b, "de", "s", 1), (None, b, "de", None, 2), (None, c, "en", "s", None), (5, None, None, "s", None), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in C.stage_near_duplicates(spark, docs, DIR).collect())
    assert kept == sorted([(1, a), (0, b), (0, c), (5, "")])
    for d in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, d, DIR)
            assert name == "shard" or out.columns == docs.columns
            n = out.count()
            assert d is docs or n == 0
            if name in ("decontaminate", "shard") and d is docs:
                assert n == len(rows)


def test_stages_keep_columns_of_any_name(spark):
    """Values of columns that bear names the operators use themselves come out as they went in."""
    names = ["score", "lang_pred", "found", "fp", "_h", "_n", "_k", "n", "component", "_gm_hash", "_gm_found", "size", "text_hash", "best", "_gone", "_stays", "c", "hub", "taken", "_extra"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    docs = C.materialize(docs.unionByName(docs.limit(3)).select("*", *[C.F.concat(C.F.lit(n + ":"), C.F.col("doc_id")).alias(n) for n in names]), "in")
    at = docs
    for name, stage in C.STAGES[:4]:
        before = {tuple(r) for r in at.collect()}
        at = C.materialize(stage(spark, at, DIR), name)
        after = at.collect()
        assert at.columns == docs.columns and after and all(tuple(r) in before for r in after)
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in after for n in names)
    assert C.stage_shard(spark, at, DIR).count() == at.count()


def test_stages_on_a_very_long_text(spark):
    words = " ".join(f"word{i % 977} the and of" for i in range(60_000))
    rows = [(1, words, "en", "s"), (2, words + " tail", "en", "s"), (3, "the quick brown fox jumps over the lazy dog again and again", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in C.stage_near_duplicates(spark, docs, DIR).collect()) == [1, 3]
    for name, stage in C.STAGES:
        assert stage(spark, docs, DIR).count() == (2 if name == "simhash_dedup" else 3)


def test_registry():
    assert [int(k[2:].split("_")[0]) for k in registry.QUERIES] == list(range(1, 14))
