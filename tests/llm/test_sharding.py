import hashlib
import zlib
from itertools import accumulate

import numpy as np
import pytest

from gristmill.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, size string"


def least_capacity(sizes, shards):
    for cap in range(max(sizes), sum(sizes) + 1):
        n, left = 1, cap
        for s in sizes:
            if s > left:
                n, left = n + 1, cap
            left -= s
        if n <= shards:
            return cap


def rows(n=500, hot=0):
    r = np.random.default_rng(3)
    out = [(i, "t" * int(r.integers(0, 300)), "x", "y") for i in range(n)] + [(n + i, "hot" * 20, "x", "y") for i in range(hot)]
    return out + [(9001, None, "x", "y"), (9002, "", "x", "y"), (9003, "é", "x", "y"), (9003, "é", "x", "y"), (None, "z", "x", "y")]


@pytest.mark.parametrize(("hot", "points"), [(0, 4096), (0, 8), (400, 16)])
def test_capacity_is_least(spark, monkeypatch, hot, points):
    monkeypatch.setattr(S, "POINTS", points)
    data = rows(hot=hot)
    got = S.shard(spark.createDataFrame(data, SCHEMA), 24).collect()
    size = lambda t: len((t or "").encode()) + 8
    groups = {}
    for _, t, *_ in data:
        k = hashlib.sha256((t or "").encode()).hexdigest()
        groups[k] = groups.get(k, 0) + size(t)
    cap = least_capacity([groups[k] for k in sorted(groups)], 24)
    assert {r["capacity"] for r in got} == {cap} and len(got) == len(data)
    load, slots, where = {}, {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(load.values()) == cap and set(load) <= set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = {r["doc_id"]: r for r in got}
    for i, t, *_ in data:
        assert by_id[i]["size"] == size(t) and by_id[i]["text_crc32"] == zlib.crc32((t or "").encode())
        assert where.setdefault(t or "", by_id[i]["shard"]) == by_id[i]["shard"]


def test_summary_walk():
    s = S.Summary({x: 1 for x in accumulate([5, 1, 1, 5])})
    assert s.least(2, False) == 6 == s.least(2, True)


def test_empty_and_single(spark):
    assert S.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [(r["shard"], r["slot"], r["size"]) for r in S.shard(spark.createDataFrame([(1, "a", "", "")], SCHEMA)).collect()] == [(0, 0, 9)]
