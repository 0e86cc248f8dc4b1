import re

import pytest

from gristmill.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int"


def rows():
    out = [(i, "w " * (i % 50 + 1), f"s{i % 7 if i % 3 else 0}", 1) for i in range(400)]
    return out + [(400, None, None, 1), (401, "", "s1", 1), (402, "a b c", None, 1), (403, "x " * 30_000, "s2", 1), (404, "same text", "tie", 1), (404, "same text", "tie", 1), (None, "q r", "tie", 1)]


def test_targets():
    assert M.targets([10, 10, 100], [1, 2, 3]) == [22.5, 30.0, 67.5]
    assert M.targets([0, 5], [1, 1]) == [0.0, 5.0] and M.targets([], []) == []
    t = M.targets([1, 1000, 1000], [3, 1, 1])
    assert t[0] == 3.0 and abs(sum(t) - 2001) < 1e-9


def test_mix_is_exact_and_stable(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = M.mix(df).collect()
    size = {}
    for i, t, s, _ in rows():
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, M.targets([size[s] for s in names], M.cyclic_weights(len(names)))))
    assert len(got) == len(rows())
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert {r["target"] for r in mine} == {want[s]} and {r["source_size"] for r in mine} == {size[s]}
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 2
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    key = lambda q: sorted(map(str, q))
    assert key(got) == key(M.mix(df.repartition(7)).collect())


def test_order_is_by_random_key(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    k = {(r["_in0"], r["_in1"]): r["_h"] % 2**64 for r in M._keyed(df, "doc_id", "text", "source", 0).collect()}
    got = [(k[(r["doc_id"], t)], r["taken"] // max(r["size"], 1)) for r, t in ((r, next(x[1] for x in rows() if x[0] == r["doc_id"])) for r in M.mix(df).filter("source = 's0' AND size > 0").collect())]
    seen = [e for _, e in sorted(got)]
    assert seen == sorted(seen, reverse=True)


def test_rows_follow(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = M.mixed_rows(df)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[(r["doc_id"], r["text"], r["source"])] = n.get((r["doc_id"], r["text"], r["source"]), 0) + 1
    assert max(n.values()) <= 6 and all(t and t.strip() for _, t, _ in n)


@pytest.mark.parametrize("data", [[], [(1, None, None, 0)]])
def test_empty(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    assert [r["taken"] for r in M.mix(df).collect()] == [0] * len(data)
    assert M.mixed_rows(df).count() == 0


NAMES = ["epochs", "cut", "part", "size", "_h", "_sk", "_n", "_c", "cell", "target", "taken", "source_size", "_extra"]


def test_clashing_names_are_kept(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    plain, clash = df.drop("size"), df.drop("size").selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in NAMES])
    out = M.mixed_rows(clash)
    assert out.columns == clash.columns
    got = out.collect()
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in got for c in NAMES)
    key = lambda rs: sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in rs)
    assert key(got) == key(M.mixed_rows(plain).collect())
    assert sorted(map(str, M.mix(clash).collect())) == sorted(map(str, M.mix(plain).collect()))
