import numpy as np
import pytest

from gristmill.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def data(n=40, copies=12, dim=16, noise=0.06):
    r = np.random.default_rng(5)
    base = r.standard_normal((n, dim))
    x = [b + noise * r.standard_normal(dim) for b in base for _ in range(copies)]
    x += [base[0]] * 30 + [3 * base[0]]
    return [(i, [float(np.float32(c)) for c in v], 1, "x", 2) for i, v in enumerate(x)]


def brute(rows):
    def ok(v):
        return v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    ids, n, root = [r[0] for r in rows], [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if ok(a) and ok(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root = [root[j] if x == root[i] else x for x in root]
    return {ids[i]: (n[i], min(ids[k] for k in range(len(rows)) if root[k] == root[i])) for i in range(len(rows))}


@pytest.mark.parametrize("block", [1024, 5])
def test_against_brute_force(spark, block):
    rows = data()
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None, *[1.0] * 15], [float("inf")] * 16, rows[0][1][:8]]
    rows += [(5000 + i, v, 0, "x", 2) for i, v in enumerate(bad)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_groups(spark.createDataFrame(rows, SCHEMA), block_rows=block).collect()}
    want = brute(rows)
    assert len(got) == len(rows) and all(got[k][0] <= want[k][0] for k in want)  # none below the threshold
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(got[k][1] == want[k][1] for k in want) and all(g[2] == (g[1] == k) for k, g in got.items())
    assert all(got[5000 + i] == (0, 5000 + i, True) for i in range(7))


def test_empty_ties_null_ids(spark):
    assert E.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    v = [1.0, 2.0]
    got = [tuple(r) for r in E.near_groups(spark.createDataFrame([(None, v, 0, "", 0), (7, v, 0, "", 0), (7, v, 0, "", 0), (None, [-1.0, 5.0], 0, "", 0)], SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, False)], key=repr)


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 0, "", 0), (1, [0.0, 1.0], 0, "", 0), (2, [1.0, 0.01], 0, "", 0), (3, [0.01, 1.0], 0, "", 0)]
    got = sorted(tuple(r) for r in E.near_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_tables_meet_recall():
    for bits in (10, 16, 24):
        p = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - p) ** E.table_count(bits, 0.95, 0.99) >= 0.99
