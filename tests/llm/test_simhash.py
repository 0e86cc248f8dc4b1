import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import simhash as S


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    ids, fps = [r[0] for r in rows], [brute_fp(r[1]) for r in rows]
    comp = {i: i for i in range(len(rows))}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
                comp[b] = a
    return {(ids[i], f"{fps[i]:016x}", ids[find(i)]) for i in range(len(rows))}


@pytest.mark.parametrize("seed", range(6))
def test_trie_matches_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    keys = [b ^ np.uint64(sum(1 << int(x) for x in r.integers(0, 64, r.integers(0, 4)))) for b in base for _ in range(20)]
    keys = np.unique(np.array(keys, dtype=np.uint64))
    for cut in (None, len(keys) // 3):
        if cut is not None:  # two disjoint nodes: split at the top bit
            cut = int(np.searchsorted(keys, np.uint64(1 << 63)))
            keys = np.unique(np.concatenate([keys, keys ^ np.uint64(1 << 63)]))
            cut = int(np.searchsorted(keys, np.uint64(1 << 63)))
        got = S.trie_forest(keys, cut)
        want = np.arange(len(keys))
        for i in range(len(keys)):
            for j in range(i):
                if (cut is None or j < cut <= i) and int(keys[i] ^ keys[j]).bit_count() <= 2:
                    a, b = want[i], want[j]
                    want[want == max(a, b)] = min(a, b)
        assert (got == want).all()


def docs(n=300, seed=1):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "É x y z"), (6, "é x y z"), (7, "a b c")]
    base = [" ".join(r.choice(words, 60)) for _ in range(20)]
    for i in range(8, n):
        w = base[r.integers(20)].split()
        for _ in range(r.integers(0, 4)):
            w[r.integers(60)] = "zz"
        rows.append((i, " ".join(w)))
    return rows + [(n, "x " * 60_000 + "end")]


@pytest.mark.parametrize("node_rows", [40_000, 8])
def test_groups_match_brute_force(spark, node_rows):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_groups(df, node_rows=node_rows).collect()}
    assert got == brute_groups(rows)


def test_empty_nulls_repeats(spark):
    schema = "doc_id long, text string"
    assert S.near_groups(spark.createDataFrame([], schema)).count() == 0
    got = sorted((r["doc_id"] is None, r["component_id"]) for r in S.near_groups(spark.createDataFrame([(None, "a"), (5, "a"), (5, "a")], schema)).collect())
    assert got == [(False, 5), (False, 5), (True, 5)]


def test_rows_without_id_bridge(spark):
    """Fingerprints 0, 3 (no id) and 15 are one component; so are the ids behind one that only null ids carry."""
    fps = spark.createDataFrame([(0, 1), (3, None), (15, 2), (255 << 40, None), (-1, 9)], "fp long, low long")
    got = S.connected_components(S.near_links(fps)).collect()
    assert {(r["node"], r["component"]) for r in got} == {(0, 0), (3, 0), (15, 0)}
    text = " ".join(f"w{i}" for i in range(500))
    near = [text, text + " x1", text + " x1 x2", text.replace("w250 ", "")]
    rows = [(None if k == 1 else 10 + k, t) for k, t in enumerate(near)]
    got = {r["doc_id"]: r["component_id"] for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = [S.simhash(t) % 2**64 for t in near]
    root = list(range(4))
    for a in range(4):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root = [root[b] if x == root[a] else x for x in root]
    want = {i: min((j for j, (m, _) in enumerate(rows) if root[j] == root[k] and m is not None), default=None) for k, (i, _) in enumerate(rows)}
    assert got == {i: None if k is None else rows[k][0] for i, k in want.items()}
