import numpy as np
import pandas as pd

import corpus_pipeline as C
from gristmill.llm import shingle_join as J
from gristmill.operators.grouping import connected_components


def brute_components(texts):
    """Component label of each text by all pairs of five-word shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def texts(seed=3):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(5000)]
    line = " ".join(r.choice(words, 12))
    out = [None, "", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for n in (9, 25, 60, 60, 150, 400):
        base = r.choice(words, n).tolist()
        for k in (0, 0, 1, 1, 2, 2, 3, 4, 6, 9, 14):
            w = list(base)
            for _ in range(k):
                w[r.integers(n)] = r.choice(words)
            out.append(" ".join(w) + (" " + line if r.random() < 0.5 else ""))
    return out + [" ".join(r.choice(words, 6)) + " " + line for _ in range(10)]


def test_stage_matches_all_pairs(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())]
    comp = brute_components([t for _, t in rows])
    assert 20 < len(set(comp)) < len(rows) - 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits, tile in ((3, 1024), (0, 2)):  # what the trie finds, and how bands are dealt to tasks, does not change the result
        monkeypatch.setattr(J, "BITS", bits)
        monkeypatch.setattr(J, "TILE", tile)
        assert sorted(r["doc_id"] for r in C.stage_near_duplicates(spark, df, "").collect()) == sorted(set(comp))


def test_a_dense_group_gives_fewer_links_than_rows():
    """Both inside a tile and between two; the components are those of all pairs."""
    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.permutation(100)[:k]], r.integers(0, 1 << 63, 100 - k, dtype=np.uint64)])) for k in (96, 96, 93, 90, 88) for _ in range(40)]
    sig, _ = J.signatures(sets)
    rows = pd.DataFrame({"_k": np.arange(200), "c": np.arange(200), "n": [len(s) for s in sets], "sig": sig, "map": [J.parity(s) for s in sets], "toks": [s.view(np.int64) for s in sets], "tile_a": 0, "tile_b": 0, "side": 0})
    similar = [(i, j) for i in range(200) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 9 >= 4 * (len(sets[i]) + len(sets[j]))]
    for side, tile in ((np.zeros(200, dtype=int), 0), (np.arange(200) % 2, 1)):
        want = [p for p in similar if not tile or side[p[0]] != side[p[1]]]
        got = J.joined(rows.assign(side=side, tile_b=tile))
        assert len(want) > 2000 and len(got) < 200 and set(zip(got["a"], got["b"])) <= set(want)
        parts = []
        for links in (want, list(zip(got["a"], got["b"]))):
            comp = list(range(200))
            for a, b in links:
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
            parts.append(comp)
        assert parts[0] == parts[1]


def test_bands_find_pairs_at_the_threshold():
    """Of 2,000 pairs at exactly 0.8 none shares no band or agrees in under half of the minimum hashes."""
    r = np.random.default_rng(5)
    sets = []
    for _ in range(2000):
        both, rest = r.integers(0, 1 << 63, 80, dtype=np.uint64), r.integers(0, 1 << 63, 20, dtype=np.uint64)
        sets += [np.unique(np.concatenate([both, rest[:10]])), np.unique(np.concatenate([both, rest[10:]]))]
    sig, bands = J.signatures(sets)
    assert all(set(bands[i]) & set(bands[i + 1]) for i in range(0, len(sets), 2))
    agree = [sum(x == y for x, y in zip(sig[i], sig[i + 1])) for i in range(0, len(sets), 2)]
    assert min(agree) * 2 >= J.BANDS * J.DEPTH and abs(np.mean(agree) / (J.BANDS * J.DEPTH) - 0.8) < 0.01
    # the bound of the bitmaps holds for every pair, similar or not
    maps = [int.from_bytes(J.parity(s)) for s in sets]
    assert all((maps[i] ^ maps[j]).bit_count() <= len(np.setxor1d(sets[i], sets[j])) for i in range(0, 400, 2) for j in (i + 1, i + 2))
    assert sum(bool(set(bands[i]) & set(bands[i + 2])) for i in range(0, len(sets) - 2, 2)) < 3


def test_near_copies_of_a_few_changed_words_go(spark):
    base = [f"w{i}" for i in range(100)]
    near = list(base)
    near[20] = near[70] = "x"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert [r["doc_id"] for r in C.stage_near_duplicates(spark, df, "").collect()] == [1]


def test_links_of_bands_are_joined_between_components(spark, monkeypatch):
    """The second time only links between labels of components are joined, and the result is that of all links."""
    calls = []

    def join(edges):
        calls.append([tuple(r) for r in edges.collect()])
        return connected_components(edges)

    ids = [f"a{i}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(f"{x}w{j}" for j in range(30))) for i, x in enumerate(ids)], "_h long, text string")
    keys = [r["_k"] for r in J._classes(df, "text").select("_k").distinct().orderBy("_k").collect()]
    first = [(keys[i + 1], keys[i]) for i in range(19)] + [(keys[i + 1], keys[i]) for i in range(20, 38)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    monkeypatch.setattr(J, "connected_components", join)
    monkeypatch.setattr(J, "_verified", lambda *a: frame(first))
    monkeypatch.setattr(J, "_rest", lambda *a: frame([(keys[x], keys[y]) for x in range(20, 38) for y in range(5, 15)]))
    got = sorted(r["component"] for r in J.near_classes(df).collect())
    assert calls[1] == [(keys[20], keys[0])]
    assert got == sorted([keys[0]] * 39 + [keys[39]])
