"""The quality classifier against plain Python features, updates and scores, and on held-out labels."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import quality as Q
from gristmill.llm.common import crc_mod

M = 1 << 64


def slot(h, kind):
    h = ((h ^ kind) * 0x9E3779B97F4A7C15 % M ^ (h >> 29)) * 0x9E3779B97F4A7C15 % M
    return h >> (64 - Q.BITS)


def plain_features(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    shape = lambda w: re.sub(rb"(.)\1+", rb"\1", re.sub(rb"[0-9]", b"0", re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", w))), flags=re.S)
    w = [xxhash.xxh64_intdigest(x, 1) for x in words]
    s = [xxhash.xxh64_intdigest(shape(x), 2) for x in words]
    join = lambda *h: sum(x * pow(0x9E3779B97F4A7C15, len(h) - 1 - i, M) for i, x in enumerate(h)) % M
    n = len(words)
    kinds = {1: w, 2: s, 3: [join(*w[i:i + 2]) for i in range(n - 1)], 4: [join(*s[i:i + 2]) for i in range(n - 1)], 5: [join(*s[i:i + 3]) for i in range(n - 2)],
             6: [int(words[i] == words[i + 1]) for i in range(n - 1)], 7: [int(words[i + 1] == words[i + 2]) + 2 * (words[i] == words[i + 1]) + 4 * (words[i] == words[i + 2]) for i in range(n - 2)]}
    out = {}
    for kind, hs in kinds.items():
        for h in hs:
            k = slot(h, kind)
            out[k] = out.get(k, 0) + Q.SCALE / len(hs)
    return out


def plain_ftrl(rows):
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0)) <= Q.L1:
            return 0.0
        return -(z[k] - math.copysign(Q.L1, z[k])) / ((Q.BETA + math.sqrt(n[k])) / Q.ALPHA + Q.L2)

    for x, y in rows:
        x = {**x, "bias": 1.0}
        p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
        old = {k: weight(k) for k in x}
        for k, v in x.items():
            g = (p - y) * v
            step = (math.sqrt(n.get(k, 0) + g * g) - math.sqrt(n.get(k, 0))) / Q.ALPHA
            z[k], n[k] = z.get(k, 0) + g - step * old[k], n.get(k, 0) + g * g
    return weight


TEXTS = ["good words in a row", "BAD!! BAD!! WORDS!!", "", None, "one", "two two two two", "é ü ß\tx\n12 a1", "a b", "GOOD words 7 in\x0b a row ", "so so la la"] + [f"text {i} of many{'!' * (i % 3)} words" for i in range(30)]


def test_features_and_blocks():
    got = [dict(zip(k.tolist(), v.tolist())) for k, v in Q.features(TEXTS, Q.Words())]
    assert len(got) == len(TEXTS)
    for t, f in zip(TEXTS, got):
        assert f == pytest.approx(plain_features(t), rel=1e-6)
    long = [None, "w " * (Q.BLOCK + 5), "", "last one"]
    assert [len(k) for k, _ in Q.features(long, Q.Words())] == [len(plain_features(t)) for t in long]


def test_model_and_scores_match_plain_python(spark, monkeypatch):
    monkeypatch.setattr(Q, "SHARDS", 1)
    monkeypatch.setattr(Q, "ROUNDS", 1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, None), (0, TEXTS[0]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_s", F.lit("y")).withColumn("_in0", F.lit("z"))
    marks = [(i, i % 2) for i in range(len(TEXTS))] + [(0, 1), (5, None), (6, 7), (None, 1), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    y = {i: i % 2 for i in range(len(TEXTS))} | {0: 0.5}
    order = df.dropDuplicates(["doc_id", "text"]).filter("doc_id IS NOT NULL").withColumn("u", F.xxhash64("doc_id", "text")).orderBy(F.xxhash64(F.lit(0), "u"), "u").collect()
    weight = plain_ftrl([(plain_features(r["text"]), y[r["doc_id"]]) for r in order])
    for parts in (1, 7):
        out = Q.score(df.repartition(parts), Q.fit(df.repartition(parts), labels.repartition(parts)))
        assert out.columns == ["doc_id", "text", "_s", "_in0", "score", "predicted"]
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            want = 1 / (1 + math.exp(-weight("bias") - sum(weight(k) * v for k, v in plain_features(r["text"]).items())))
            assert r["score"] == pytest.approx(want, rel=1e-4) and r["predicted"] == int(r["score"] >= 0.3) and r["_s"] == "y"


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in Q.score(df, Q.fit(df, none)).collect()] == [0.5, 0.5]
    assert Q.score(df.limit(0), Q.fit(df.limit(0), none)).count() == 0


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    marked = docs.join(labels, "doc_id").select("doc_id", "text", "quality")
    out = Q.score(marked.filter(crc_mod("doc_id", 5) == 0), Q.fit(marked.select("doc_id", "text"), labels, crc_mod("doc_id", 5) != 0)).toPandas()
    y, p = out["quality"].to_numpy(), out["predicted"].to_numpy()
    assert len(out) > 700 and (p[y == 1] == 1).mean() > 0.99 and (p[y == 0] == 0).mean() > 0.95
    assert 0 <= out["score"].min() and out["score"].max() <= 1 and np.isfinite(out["score"]).all()
