"""Tiled pairs, rotated images, order statistics, running sums, observed contracts and detection evaluation against plain versions."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.functions.geometry import image_size, rounded
from gristmill.operators import annotate, audit, curate, grouping, images, metrics, split, validate
from gristmill.sources import readers, sinks


# pairs ---------------------------------------------------------------------------------------------------------------

def vectors(seed=1, n=90, dims=8):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dims))
    v[: n // 3] = v[0] + 0.2 * r.normal(size=(n // 3, dims))  # a dense cone
    rows = [(k, int(k % 3 if k >= n // 2 else 0), x.tolist()) for k, x in enumerate(v)]
    return rows + [(500, 0, [0.0] * dims), (501, 0, None), (502, 0, [float("nan")] * dims), (None, 0, rows[0][2])]


@pytest.mark.parametrize("threshold", [None, -0.5, 0.3, 0.95])
@pytest.mark.parametrize("tile_rows", [7, 2048])
def test_tiled_pairs_match_all_pairs(spark, threshold, tile_rows):
    rows = vectors()
    good = [(k, b, np.array(v) / np.linalg.norm(v)) for k, b, v in rows if k is not None and v is not None and np.isfinite(v).all() and any(v)]
    want = {(b, k, m): float(u @ w) for k, b, u in good for m, c, w in good if b == c and k < m and (threshold is None or u @ w >= threshold)}
    df = spark.createDataFrame(rows, "id long, b int, v array<double>")
    got = grouping.block_pairs(df, "b", "id", "v", threshold, tile_rows).collect()
    assert len(got) == len(want) and {(r["b"], r["id_a"], r["id_b"]): pytest.approx(r["score"], abs=1e-12) for r in got} == want


def test_a_large_block_is_many_tasks(spark):
    df = spark.range(1000).select(F.lit(1).alias("b"), "id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("v"))
    plan = grouping.tile_plan(grouping.unit_vectors(df, "b", "id", "v"), "b", "id", tile_rows=100)
    tasks = plan.groupBy("tile_a", "tile_b").count().collect()
    assert len(tasks) == 55 and max(r["count"] for r in tasks) < 300
    assert grouping.block_pairs(df.limit(0), "b", "id", "v", 0.5).count() == 0


def test_a_pair_of_tiles_computes_each_pair_once():
    r = np.random.default_rng(6)
    n, cells, got = 600, 0, set()
    side = r.integers(0, 2, n).astype(np.int32)
    rows = pa.table({"k": r.permutation(n), "v": list(r.normal(size=(n, 4))), "side": side, "tile_a": [0] * n, "tile_b": [1] * n})
    key = rows["k"].to_numpy()
    for i, j, first, s in grouping.scored(rows, "k", "v", lambda a, b: a @ b.T):
        cells += s.size
        got |= {(int(key[x]), int(key[y])) for x, y in zip(i[np.nonzero(first)[0]], j[np.nonzero(first)[1]])}
    of = dict(zip(key.tolist(), side.tolist()))
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if of[a] != of[b]} and cells < 1.2 * len(got)


def test_pairs_leave_a_task_as_lists_and_are_never_null(spark, monkeypatch):
    """A row from Python costs far more than an element of a list."""
    caught, n = [], 600

    class Dealt:
        def applyInArrow(self, run, schema):
            caught.append(run)
            return spark.createDataFrame([], schema)

    monkeypatch.setattr(grouping, "dealt_tiles", lambda *a: Dealt())
    plan = spark.createDataFrame([], "b int, id long, v array<double>, tile_a int, tile_b int, side int")
    out = grouping.tiled_scores(plan, "b", "id", "v", lambda a, b: a @ b.T, None).withColumn("score", rounded(F.col("score")))
    assert out.columns == ["b", "id_a", "id_b", "score"] and [f.name for f in out.schema if f.nullable] == ["b"]
    r = np.random.default_rng(8)
    rows = pa.table({"b": pa.array([3] * n, pa.int32()), "id": r.permutation(n), "v": list(r.normal(size=(n, 4))), "tile_a": [0] * n, "tile_b": [0] * n, "side": [0] * n})
    batches = list(caught[0](iter(rows.to_batches())))
    pairs = [(a, b) for x in batches for a, bs in zip(x["id_a"].to_pylist(), x["_keys"].to_pylist()) for b in bs]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)] and 16 * sum(x.num_rows for x in batches) < len(pairs)


def test_all_pairs_are_written_as_runs_of_scores(spark, tmp_path):
    """In key order a pair takes 8 bytes and more, as rounded scores hardly compress."""
    n, v = 3000, np.random.default_rng(5).normal(size=(3000, 16))
    df = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v)], "id long, b int, v array<double>")
    out = str(tmp_path / "pairs")
    grouping.block_pairs(df, "b", "id", "v").withColumn("score", rounded(F.col("score"))).write.parquet(out)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6 * n * (n - 1) / 2
    got = spark.read.parquet(out).toPandas()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert len(got) == n * (n - 1) // 2 and not got.duplicated(["id_a", "id_b"]).any() and (got["id_a"] < got["id_b"]).all()
    assert np.abs(got["score"] - np.einsum("ij,ij->i", u[got["id_a"]], u[got["id_b"]])).max() < 1e-6


@pytest.mark.parametrize("most", [700, 10**6])
@pytest.mark.parametrize("same", [True, False])
def test_pairs_leave_a_task_by_score_in_bounded_runs(spark, monkeypatch, most, same):
    caught, n = [], 300

    class Dealt:
        def applyInArrow(self, run, schema):
            caught.append(run)
            return spark.createDataFrame([], schema)

    monkeypatch.setattr(grouping, "dealt_tiles", lambda *a: Dealt())
    for name, x in (("RUNS", 1), ("ORDERED", most), ("LIST", 64)):
        monkeypatch.setattr(grouping, name, x)
    plan = spark.createDataFrame([], "b int, id string, v array<double>, tile_a int, tile_b int, side int")
    out = grouping.ordered_scores(plan, "b", "id", "v", lambda a, b: a @ b.T)
    assert out.columns == ["b", "id_a", "id_b", "score"] and [f.name for f in out.schema if f.nullable] == ["b"]
    r = np.random.default_rng(9)
    # one key in a third of the rows; pairs of one key are none
    ids, v, side = [f"{max(0, k - 100):03d}" for k in r.permutation(n)], r.normal(size=(n, 4)), r.integers(0, 2, n) * (not same)
    rows = pa.table({"b": pa.array([None] * n, pa.int32()), "id": ids, "v": list(v), "tile_a": [0] * n, "tile_b": [0 if same else 1] * n, "side": side})
    batches = list(caught[0](iter(rows.to_batches())))
    got = [(a, b, s) for x in batches for c in zip(x["_a"].to_pylist(), x["_b"].to_pylist(), x["_scores"].to_pylist()) for a, b, s in zip(*c, strict=True)]
    want = sorted((ids[i], ids[j], float(v[i] @ v[j])) for i in range(n) for j in range(n) if ids[i] < ids[j] and (same or side[i] != side[j]))
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in want] and np.allclose(sorted(x[2] for x in got), sorted(x[2] for x in want), atol=1e-12)
    s = np.array([x[2] for x in got])
    falls = np.diff(s) < -1e-6
    assert falls.sum() <= len(s) // most and max(len(c) for x in batches for c in x["_scores"].to_pylist()) <= 64


@pytest.mark.parametrize("name", ["block_pairs", "rotated_pairs"])
def test_pairs_of_copies_take_little_disk(spark, tmp_path, name):
    """A table of repeated vectors has few scores, and its output is far below that of as many different ones."""
    n, times = 500, 6
    v = np.random.default_rng(15).normal(size=(n, 16)).astype(np.float32)
    df = spark.createDataFrame([(t * 10_000 + k, 0, x.tolist()) for t in range(times) for k, x in enumerate(v)], "id long, b int, v array<float>")
    out = str(tmp_path / "pairs")
    pairs = grouping.block_pairs(df, "b", "id", "v") if name == "block_pairs" else images.rotated_pairs(df, "b", "id", "v", angles=(0, 90, 180, 270))
    pairs.withColumn("score", rounded(F.col("score"))).write.parquet(out)
    got, m = spark.read.parquet(out).toPandas(), n * times
    assert len(got) == m * (m - 1) // 2 and not got.duplicated(["id_a", "id_b"]).any() and (got["id_a"] < got["id_b"]).all()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2 * len(got)
    w = v.astype(float)
    score = w @ w.T / np.linalg.norm(w, axis=1) / np.linalg.norm(w, axis=1)[:, None] if name == "block_pairs" else images.rotated_scores(w, w, (0, 90, 180, 270))
    assert np.abs(got["score"] - score[got["id_a"] % 10_000, got["id_b"] % 10_000]).max() < 1e-6


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("same", [True, False])
def test_copies_give_each_pair_once(monkeypatch, same, small):
    """Any numbers of copies, scores that depend on the order of the two, one key in several rows, copies in both tiles."""
    if small:
        monkeypatch.setattr(grouping, "SCORES", 300)
        monkeypatch.setattr(grouping, "TURN", 3)
    r, n = np.random.default_rng(11), 240
    of = np.concatenate([np.zeros(60, dtype=int), r.integers(1, 21, n - 60)])  # one vector with a quarter of the rows
    v, key, side = r.normal(size=(21, 9))[of], [f"{k // 2 if k < 20 else k:03d}" for k in r.permutation(n)], r.integers(0, 2, n) * (not same)
    rows = pa.table({"k": key, "v": list(v), "tile_a": [0] * n, "tile_b": [0 if same else 1] * n, "side": side})
    skew = r.normal(size=(9, 9))
    got = [(key[a], key[b], round(float(c), 9)) for i, j, s in grouping.copied_scores(rows, "k", "v", lambda a, b: a @ skew @ b.T) for a, b, c in zip(i, j, s, strict=True)]
    want = [(key[i], key[j], round(float(v[i] @ skew @ v[j]), 9)) for i in range(n) for j in range(n) if key[i] < key[j] and (same or side[i] != side[j])]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)] and np.allclose([x[2] for x in sorted(got)], [x[2] for x in sorted(want)], atol=1e-7)
    alone = pa.table({"k": range(n), "v": list(r.normal(size=(n, 4))), "tile_a": [0] * n, "tile_b": [0] * n, "side": [0] * n})
    assert grouping.copied_scores(alone, "k", "v", lambda a, b: a @ b.T) is None


def test_copies_share_a_tile_and_many_are_spread(spark):
    few = [(k, None if k % 2 else 1, [float(k % 100), 1.0]) for k in range(600)]
    df = spark.createDataFrame(few + [(1000 + k, 1, [0.5, 0.5]) for k in range(2000)], "id long, b int, v array<float>")
    held = grouping.with_copies_together(df, "b", "id", "v", 320)
    assert held.count() == 2600 and held.filter("id < 1000").groupBy("b", "v").agg(F.count_distinct("_deal").alias("n")).filter("n > 1").count() == 0
    groups = [r["count"] for r in held.filter("id >= 1000").groupBy("_deal").count().collect()]
    assert len(groups) > 150 and max(groups) < 40
    tiles = grouping.tile_plan(held, "b", "id", tile_rows=320, deal="_deal").filter("tile_a = tile_b")
    assert max(r["count"] for r in tiles.groupBy("b", "tile_a").count().collect()) < 640
    assert tiles.filter("id < 1000").groupBy("b", "v").agg(F.count_distinct("tile_a").alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_vectors_of_single_precision_are_shuffled_as_such(spark, monkeypatch, kind):
    caught = []
    monkeypatch.setattr(grouping, "dealt_tiles", lambda plan, *a, deal=grouping.dealt_tiles: caught.append(plan) or deal(plan, *a))
    rows = [(k, 0, [k % 7 + 1, k % 5 - 2, 3, 1]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, b int, v array<int>").withColumn("v", F.col("v").cast(f"array<{kind}>"))
    got = grouping.block_pairs(df, "b", "id", "v").collect()
    u = np.array([r[2] for r in rows], dtype=float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    assert len(got) == 780 and max(abs(r["score"] - u[r["id_a"]] @ u[r["id_b"]]) for r in got) < 1e-12
    images.rotated_pairs(df, "b", "id", "v", angles=(0, 90, 180, 270)).collect()
    assert [dict(p.dtypes)[c] for p, c in zip(caught, ("v", "feature"))] == ["array<float>" if kind == "float" else "array<double>"] * 2


@pytest.mark.parametrize("angles", [(0, 90, 180, 270), (0, 45)])
def test_rotated_scores_by_right_angles_match_the_quotient_of_each(angles):
    p = [x.ravel() for x in pictures(8, 10) if np.ptp(x) > 1] + [np.full(64, 7.0)]
    got, turned = images.rotated_scores(np.stack(p), np.stack(p), angles), images.rotations(8, angles)
    for i, x in enumerate(p[:-1]):
        for j, y in enumerate(p[:-1]):
            a, bs = images.rotations(8, (0,))[0] @ x, [t @ y for t in turned]
            assert got[i, j] == pytest.approx(max(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8) for b in bs), abs=1e-12)
    assert not got[-1].any() and not got[:, -1].any()


@pytest.mark.parametrize("exact_rows", [1, 20_000])
def test_quantiles_of_pairs_store_no_pair(spark, monkeypatch, exact_rows):
    written = []
    monkeypatch.setattr(grouping, "materialize", lambda df, name="t": written.append(df.count()) or df)
    rows = vectors(n=120) + [(k, 0, [1.0] * 8) for k in range(1000, 1030)]  # many equal scores
    df = spark.createDataFrame(rows, "id long, b int, v array<double>")
    pairs = [r["score"] for r in grouping.block_pairs(df, "b", "id", "v").collect()]
    got = audit.pair_quantiles(df, "b", "id", "v", exact_rows, tile_rows=16).collect()
    assert [(r["q"], r["value"]) for r in got] == [(q, pytest.approx(np.quantile(pairs, q), abs=1e-6)) for q in audit.QUANTILES]
    assert max(written) <= len(rows) < len(pairs)
    assert audit.pair_quantiles(df.limit(0), "b", "id", "v").collect() == [] and audit.pair_quantiles(df.limit(1), "b", "id", "v").collect() == []


def test_rounding_is_that_of_spark(spark):
    c = F.col("id")
    df = spark.range(-3000, 3000).select(F.explode(F.array(c * 5e-7, c / 7e3, F.rand(1) * 2 - 1, c * -1e-9, c * 1.5e-6 + 1e-13)).alias("s"))
    got = df.select(F.round("s", 6).alias("want"), rounded(F.col("s")).alias("got")).filter(F.xxhash64("want") != F.xxhash64("got")).collect()
    assert got == []


def test_ordinals(spark):
    r = np.random.default_rng(3)
    rows = [(f"p{r.integers(4)}", int(r.integers(9)), int(k)) for k in range(200)]
    first = {}
    for p, c, k in rows:
        first[p, c] = min(k, first.get((p, c), k))
    want = {k: f"{p}__visual_{sorted(v for (q, _), v in first.items() if q == p).index(first[p, c]):02d}" for p, c, k in rows}
    got = grouping.component_keys(spark.createDataFrame(rows, "p string, c int, k int"), "p", "c", "k").collect()
    assert {r["k"]: r["group_key"] for r in got} == want


# rotated images ------------------------------------------------------------------------------------------------------

def turned(image, angle):
    """Image rotated about its centre, bilinear, one pixel at a time; None outside."""
    n, c = len(image), (len(image) - 1) / 2
    quarter = {0: (1, 0), 90: (0, 1), 180: (-1, 0), 270: (0, -1)}
    cos, sin = quarter.get(angle % 360) or (math.cos(math.radians(angle)), math.sin(math.radians(angle)))
    out = {}
    for i in range(n):
        for j in range(n):
            y, x = cos * (i - c) + sin * (j - c) + c, -sin * (i - c) + cos * (j - c) + c
            if -1e-9 <= y <= n - 1 + 1e-9 and -1e-9 <= x <= n - 1 + 1e-9:
                a, b = min(int(max(y, 0)), n - 2), min(int(max(x, 0)), n - 2)
                out[i, j] = sum(image[a + p][b + q] * abs(1 - p - (y - a)) * abs(1 - q - (x - b)) for p in (0, 1) for q in (0, 1))
    return out


def plain_score(first, second, angles, radius=images.RADIUS):
    n, c, best = len(first), (len(first) - 1) / 2, -2.0
    mask = [(i, j) for i in range(n) for j in range(n) if (i - c) ** 2 + (j - c) ** 2 < (n * radius) ** 2]
    for angle in angles:
        t = turned(second, angle)
        assert all(p in t for p in mask)
        a, b = np.array([first[i][j] for i, j in mask]), np.array([t[p] for p in mask])
        a, b = a - a.mean(), b - b.mean()
        if min(np.ptp(a), np.ptp(b)) < 1e-9:  # one grey level
            a = a * 0
        best = max(best, float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8)))
    return best


def pictures(n, count, seed=2):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n] / n
    out = [255 * np.abs(np.sin(r.uniform(1, 9) * x + r.uniform(1, 9) * y + r.uniform(0, 6))) for _ in range(count // 2)]
    out += [np.rot90(out[0]), r.uniform(0, 255, (n, n)), np.full((n, n), 7.0)]
    out += [255 - p + r.normal(0, 3, (n, n)) for p in out[:count - len(out)]]
    return out


def test_rotated_scores_match_one_pixel_at_a_time():
    assert len(images.ANGLES) == 64
    p = pictures(12, 8)
    flat = np.stack([x.ravel() for x in p])
    got = images.rotated_scores(flat, flat)
    assert max(abs(got[i, j] - plain_score(p[i], p[j], images.ANGLES)) for i in range(len(p)) for j in range(len(p))) < 1e-6
    some = images.rotated_scores(flat, flat, least=0.75)
    assert ((some >= 0.75) == (got >= 0.75)).all() and np.abs(some - got)[got >= 0.75].max() < 1e-12


@pytest.mark.parametrize("threshold", [None, 0.6])
def test_rotated_pairs(spark, threshold):
    p = pictures(10, 12)
    rows = [(k, k % 2, x.ravel().tolist()) for k, x in enumerate(p)] + [(99, 0, None)]
    want = {(k, m): plain_score(p[k], p[m], images.ANGLES) for k in range(len(p)) for m in range(k + 1, len(p)) if k % 2 == m % 2}
    got = images.rotated_pairs(spark.createDataFrame(rows, "id int, b int, f array<double>"), "b", "id", "f", threshold, tile_rows=3).collect()
    assert {(r["id_a"], r["id_b"]): pytest.approx(r["score"], abs=1e-6) for r in got} == {k: v for k, v in want.items() if threshold is None or v >= threshold}


def test_small_images_meet_in_few_large_tiles(spark, monkeypatch):
    """A row is shuffled once for each tile of its block, so these are as large as memory allows."""
    monkeypatch.setattr(images, "tiled_scores", lambda plan, *a: plan)
    df = spark.range(3000).select(F.lit(1).alias("b"), "id", F.array_repeat(F.rand(1), 64).alias("f"))
    assert images.rotated_pairs(df, "b", "id", "f", 0.5).count() == 3000
    monkeypatch.setattr(grouping, "TILE_BYTES", 1000 * 64 * 8)
    assert images.rotated_pairs(df, "b", "id", "f", 0.5).count() == 9000


def test_thumbnail(spark):
    r = np.random.default_rng(4)
    flat = images.thumbnail(np.full((30, 70), 9.0))
    assert flat.shape == (48, 48) and np.allclose(flat, 9.0)
    for n, m in ((5, 9), (48, 48), (200, 48), (7, 3)):
        w = images.resize_matrix(n, m)
        assert np.allclose(w.sum(axis=1), 1) and np.allclose(w, w[::-1, ::-1])
    assert np.allclose(images.resize_matrix(48, 48), np.eye(48))
    k = images.blur_matrix(9, 0.7)
    assert np.allclose(k.sum(axis=1), 1) and np.allclose(k[4, 1:8], k[4, 1:8][::-1]) and k[0, 0] > k[4, 4]
    a = r.integers(0, 256, (6, 8))
    df = spark.createDataFrame([(a.ravel().tolist(), 8, 6), ([1, 2], 8, 6), (None, 1, 1)], "pixels array<int>, width int, height int")
    got = [x["feature"] for x in images.with_feature(df, side=4).collect()]
    assert np.allclose(got[0], images.thumbnail(a, 4).ravel()) and got[1:] == [None, None]
    assert spark.range(1).select(images.grey(F.lit(255), F.lit(255), F.lit(255)), images.grey(F.lit(255), F.lit(0), F.lit(0))).first()[:] == (255, 76)


# order statistics, running sums --------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["even", "ties", "spread", "few"])
def test_quantiles_match_numpy(spark, kind):
    r = np.random.default_rng(6)
    v = {"even": r.normal(size=30_000), "ties": r.integers(0, 5, 30_000).astype(float), "spread": np.concatenate([np.exp(r.normal(0, 60, 20_000)), [-1e300, 1e300, 0.0]]), "few": np.array([3.0, 1.0])}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = {x["q"]: x["value"] for x in audit.quantiles(df, "v", exact_rows=100).collect()}
    want = np.quantile(v, audit.QUANTILES)
    assert len(got) == 6 and all(got[q] == pytest.approx(w, rel=1e-9, abs=1e-6) for q, w in zip(audit.QUANTILES, want))


def test_running_sums(spark):
    r = np.random.default_rng(7)
    rows = [("hot" if r.random() < 0.6 else f"k{r.integers(5)}", float(r.integers(50)), int(k), int(r.integers(9))) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, o double, id int, n int").repartition(5)
    got = {x["id"]: x["s"] for x in split.running_sums(df, ["k"], ["o", "id"], {"s": "n"}).collect()}
    assert got == {i: sum(n for q, p, j, n in rows if q == k and (p, j) <= (o, i)) for k, o, i, _ in rows}


# contracts -----------------------------------------------------------------------------------------------------------

def test_observed_contracts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, l string"), spark.createDataFrame([(2, 5), (3, 6), (4, 7)], "k int, r int")
    with pytest.raises(validate.ContractError, match="unpaired rows: 1 left, 1 right"):
        validate.require_pairs(a, b, ["k"])
    with pytest.raises(validate.ContractError, match="k missing on the right: 1"):
        curate.required_join(a, b, "k")
    with pytest.raises(validate.ContractError, match="l is not x: 2"):
        validate.require_status(a, "l", "x")
    both = b.filter("k < 4")
    assert sorted(tuple(x) for x in curate.required_join(both, a, "k").collect()) == [(2, 5, "y"), (3, 6, "z")]
    assert sorted(tuple(x) for x in validate.require_pairs(a.filter("k > 1"), both, ["k"]).collect()) == [(2, "y", 5), (3, "z", 6)]
    assert validate.require_status(a.limit(0), "l", "x").count() == 0
    seen = spark.sparkContext.accumulator(0)
    calls = F.udf(lambda x: (seen.add(1), x)[1], "int").asNondeterministic()
    curate.required_join(both.withColumn("r", calls("r")), a, "k").collect()
    assert seen.value == 2  # each row once, for the check and the result


# detection evaluation ------------------------------------------------------------------------------------------------

def plain_evaluation(truth, dets):
    """The published definition, one detection, box, threshold and range at a time."""
    def iou(d, g, crowd):
        w = min(d[0] + d[2], g[0] + g[2]) - max(d[0], g[0])
        h = min(d[1] + d[3], g[1] + g[3]) - max(d[1], g[1])
        inter = max(0, w) * max(0, h)
        return inter / (d[2] * d[3] if crowd else d[2] * d[3] + g[2] * g[3] - inter) if inter else 0.0

    out = {}
    for cat in {t[2] for t in truth}:
        for area, most in metrics.CASES:
            lo, hi = metrics.AREAS[area]
            inside = lambda a: lo <= a <= hi
            n = sum(1 for t in truth if t[2] == cat and not t[5] and inside(t[4]))
            if not n:
                continue
            for thr in metrics.THRESHOLDS:
                marked = []
                for image in {d[1] for d in dets}:
                    ds = sorted((d for d in dets if d[1:3] == (image, cat)), key=lambda d: (-d[3], d[0]))[:100]
                    gs = sorted((t for t in truth if t[1:3] == (image, cat)), key=lambda t: (bool(t[5]) or not inside(t[4]), t[0]))
                    used = set()
                    for rank, d in enumerate(ds):
                        best, found = min(thr, 1 - 1e-10), None
                        for t in gs:
                            ign = bool(t[5]) or not inside(t[4])
                            if t[0] in used and not t[5]:
                                continue
                            if found and not found[1] and ign:
                                break
                            v = iou(d[4], t[3], t[5])
                            if v >= best:
                                best, found = v, (t[0], ign)
                        if found:
                            used.add(found[0])
                        if rank < most and not (found[1] if found else not inside(d[4][2] * d[4][3])):
                            marked.append((-d[3], d[0], bool(found)))
                marked.sort()
                tp, points = 0, []
                for i, (_, _, hit) in enumerate(marked):
                    tp += hit
                    points.append((tp / n, tp / (i + 1 + metrics.EPS)))
                recs = np.linspace(0, 1, 101)
                ap = sum(max((p for r, p in points if r >= x), default=0) for x in recs) / 101
                out[cat, area, most, thr] = (ap, max((r for r, _ in points), default=0.0))
    return out


def detections(seed=9):
    r = np.random.default_rng(seed)
    truth, dets, k = [], [], 0
    for image in range(8):
        for g in range(int(r.integers(0, 9))):
            box = [float(x) for x in (*r.integers(0, 200, 2), *r.integers(5, 150, 2))]
            cat, crowd = int(r.integers(3)), int(r.random() < 0.15)
            truth.append((image * 100 + g, image, cat, tuple(box), box[2] * box[3] * (0.7 if g % 3 else 1.0), crowd))
            for _ in range(int(r.integers(0, 4))):
                near = [b + float(r.integers(-8, 9)) for b in box[:2]] + [max(1.0, b + float(r.integers(-9, 10))) for b in box[2:]]
                dets.append((k, image, cat if r.random() < 0.9 else 3, round(float(r.random()), 1), tuple(near)))
                k += 1
    truth.append((9000, 50, 7, (0.0, 0.0, 10.0, 10.0), 100.0, 0))
    dets += [(k + i, 0, 0, 0.05, (300.0 + i, 300.0, 9.0, 9.0)) for i in range(120)]
    return truth, dets


def test_evaluation_matches_the_definition(spark):
    truth, dets = detections()
    box = "struct<x:double,y:double,w:double,h:double>"
    t = spark.createDataFrame(truth, f"gt_id long, image_id long, category_id int, box {box}, area double, iscrowd int")
    d = spark.createDataFrame(dets, f"det_id long, image_id long, category_id int, score double, box {box}")
    got = metrics.evaluate(t, d)
    want = plain_evaluation(truth, dets)
    have = {(r["category_id"], r["area"], r["max_dets"], r["threshold"]): (r["ap"], r["recall"]) for r in got.collect()}
    assert have.keys() == want.keys() and len({v for v in want.values()}) > 30
    for k in want:
        assert have[k] == pytest.approx(want[k], abs=1e-12), k
    report = {r["metric"]: r["value"] for r in metrics.report(got).collect()}
    mean = lambda i, f: np.mean([v[i] for k, v in want.items() if f(k)])
    assert report["AP"] == pytest.approx(mean(0, lambda k: k[1:3] == ("all", 100))) and report["AP75"] == pytest.approx(mean(0, lambda k: k[1:] == ("all", 100, 0.75)))
    assert report["AR10"] == pytest.approx(mean(1, lambda k: k[1:3] == ("all", 10))) and report["AR_small"] == pytest.approx(mean(1, lambda k: k[1] == "small"))
    assert {r["category_id"] for r in metrics.class_means(got).collect()} == {k[0] for k in want if k[1] == "all"}


# image headers -------------------------------------------------------------------------------------------------------

def jpeg(w, h, frame=0xC0, before=b"", tail=b"\xff\xda\x00\x02rest"):
    sof = bytes([0xFF, frame, 0, 11, 8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + before + sof + tail


def test_image_sizes(spark, tmp_path):
    exif = b"Exif\0\0" + jpeg(7, 9)  # a thumbnail inside a segment
    app = b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (70000).to_bytes(4, "big") + b"\x08\x02"
    cases = {"a.png": (png, (640, 70000)), "b.jpg": (jpeg(300, 200), (300, 200)), "c.JPG": (jpeg(300, 201, 0xC2, app + b"\xff\xff\xff\xe0\x00\x04ab"), (300, 201)), "d.jpg": (jpeg(1, 1)[:8], None),
             "e.jpg": (b"\xff\xd8" + app, None), "f.png": (png[:18], None), "h.jpg": (b"GIF89a", None), "i.jpg": (b"\xff\xd8\xff\xda\x00\x02" + jpeg(5, 5), None), "j.jpg": (jpeg(65535, 2, 0xC1, b"\xff\xfe\x00\x02" * 40), (65535, 2))}
    (tmp_path / "train").mkdir()
    for name, (data, _) in cases.items():
        (tmp_path / "train" / name).write_bytes(data)
    files = readers.scan_files(spark, str(tmp_path), ["train"], readers.IMAGE_SUFFIXES, content=True)
    got = {r["path"].rsplit("/", 1)[1]: r["s"] and tuple(r["s"]) for r in files.select("path", image_size(F.col("content")).alias("s")).collect()}
    assert {k: v if v is None or None not in v else None for k, v in got.items()} == {k: v for k, (_, v) in cases.items()}


# documents of any size -----------------------------------------------------------------------------------------------

def test_document_in_parts_is_the_small_document(spark, tmp_path):
    img = spark.createDataFrame([(f"f{k:03d}", 4, k % 5) for k in range(300)], "file_name string, width int, height int")
    inst = spark.createDataFrame([(f"f{k % 300:03d}", k, k % 2, [0.0, 0.0, 1.0, k / 3], (0.0, 0.0, 1.0, float(k)), None if k % 7 == 0 else float(k)) for k in range(700)],
                                 "file_name string, line_no int, class_id int, segmentation array<double>, bbox struct<x:double,y:double,w:double,h:double>, area double")
    cats = annotate.categories(spark, ["a", "b"])
    for images_, ann in ((img, annotate.full_instances(inst)), (img.limit(0), annotate.full_instances(inst).limit(0))):
        path = str(tmp_path / f"doc{images_.count()}")
        sinks.write_lines(annotate.document_lines(images_, ann, cats), path, ["section", "pos"])
        text = "".join(p.read_text() for p in sorted((tmp_path / path).glob("part-*")))
        small = annotate.coco_document(images_, ann, cats).select(F.to_json(F.struct("info", "images", "annotations", "categories"), {"ignoreNullFields": "false"})).first()[0]
        assert json.loads(text) == json.loads(small) and len(json.loads(text)["images"]) == images_.count()
    with pytest.raises(FileExistsError):
        sinks.write_lines(cats.select(F.col("id").alias("value")), path, ["value"])


def test_remap_and_union(spark):
    rows = [("f", 1, 0, (0.0, 0.0, 2.0, 2.0), 4.0), ("f", 2, 1, (1.0, 1.0, 4.0, 1.0), 4.0), ("f", 3, 5, (9.0, 9.0, 1.0, 1.0), 1.0), ("g", 1, 5, (0.0, 0.0, 1.0, 1.0), 1.0)]
    df = spark.createDataFrame([(f, n, c, [float(n)], b, a) for f, n, c, b, a in rows], "file_name string, line_no int, class_id int, segmentation array<double>, bbox struct<x:double,y:double,w:double,h:double>, area double")
    to = spark.createDataFrame([(0, 3), (1, 3)], "class_id int, category_id int")
    get = lambda d: sorted((r["file_name"], r["category_id"], tuple(r["bbox"]), r["area"], len(r["segmentation"])) for r in d.collect())
    assert get(annotate.union_instances(df, to)) == [("f", 3, (0.0, 0.0, 5.0, 2.0), 8.0, 2)]
    assert get(annotate.union_instances(df, to, pass_through=True)) == [("f", 3, (0.0, 0.0, 5.0, 2.0), 8.0, 2), ("f", 6, (9.0, 9.0, 1.0, 1.0), 1.0, 1), ("g", 6, (0.0, 0.0, 1.0, 1.0), 1.0, 1)]
    assert get(annotate.union_instances(df, to, pass_through=True, whole_image=1)) == [("f", 1, (0.0, 0.0, 10.0, 10.0), 9.0, 3), ("g", 1, (0.0, 0.0, 1.0, 1.0), 1.0, 1)]
    assert sorted((r["line_no"], r["category_id"]) for r in annotate.remapped(df, to, True).filter("file_name = 'f'").collect()) == [(1, 3), (2, 3), (3, 6)]
