"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are made in Arrow batches, equal ones are merged first (a group of copies is one trie key), and the
distinct ones are joined with themselves by walking pairs of trie nodes, adding up differing bits and dropping a pair
whose error budget is spent.

Distribution: trie levels are the fingerprint's bits, the most balanced first. Prefix counts (2^16, then at most 16 for each
overfull node; never fingerprints) come to the driver, which splits nodes until each holds at most ``node_rows`` keys, or
the ``MOST_NODES``-th part of all if that is more, so the driver and the broadcast list of node pairs stay bounded. It walks node
pairs down to those leaves; each surviving pair of leaves is one task group that walks on. A task returns a forest of links,
not all pairs, and skips node pairs that already lie in one component, so a dense cluster costs no quadratic
output. Components are then joined across tasks by distributed star contraction, between fingerprints; ids are attached at the end.

Null and empty texts have fingerprint zero and link like any other. Equal doc_ids and repeated rows are allowed (a row each); a
null doc_id links and bridges like any other and gets the smallest id of its component, or null if no member has one. Very long
texts are hashed whole. Only id and text are read, so other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table
from gristmill.operators.grouping import connected_components
from gristmill.sources.materialize import materialize

BITS, SHINGLE, DISTANCE, NODE_ROWS, MOST_NODES, FIRST_STEP, STEP = 64, 3, 2, 1 << 17, 4096, 16, 4


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """64-bit fingerprint over word shingles of ASCII-lower-cased text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hs = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        lo, hi, f = [0, *ends[:-width].tolist()], (ends[width - 1:] - 1).tolist(), xxhash.xxh64_intdigest
        hs = np.fromiter((f(flat[a:b], 42) for a, b in zip(lo, hi)), dtype=np.uint64, count=len(hi))
    return bits_of(hs)


def bits_of(hs: np.ndarray) -> int:
    """The fingerprint (signed) of some hashes: bits set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hs), 1 << 14):
        part = hs[i:i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hs)).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", width: int = SHINGLE) -> DataFrame:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in s], dtype="int64")

    return df.withColumn(name, run(F.col(text)))


def _permute(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Bits of fp dealt so that trie level j is bit order[j]."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for j, b in enumerate(order):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - j)
    return out


def trie_forest(keys: np.ndarray, cut: int | None, distance: int = DISTANCE) -> np.ndarray:
    """parent[i] (a smaller or equal index) of each of the sorted distinct keys after joining all links.

    cut None: the keys with themselves; else only links between keys[:cut] and keys[cut:], two disjoint nodes.
    """
    n = len(keys)
    parent, changes = np.arange(n), np.arange(n)
    root = np.array([[0, n, 0, n]]) if cut is None else np.array([[0, cut, cut, n]])
    stack = [(0, root, np.zeros(1, dtype=np.int64))]
    while stack:
        depth, p, dist = stack.pop()
        if len(p) > 1 << 15:
            stack += [(depth, p[1 << 15:], dist[1 << 15:]), (depth, p[:1 << 15], dist[:1 << 15])]
            continue
        one = (changes[p[:, 1] - 1] == changes[p[:, 0]]) & (changes[p[:, 3] - 1] == changes[p[:, 2]]) & (parent[p[:, 0]] == parent[p[:, 2]])
        p, dist = p[~one], dist[~one]
        s1, s2 = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        leaf = (s1 * s2 <= 32) if depth < BITS else np.ones(len(p), dtype=bool)
        if leaf.any():
            q, k1, k2 = p[leaf], s1[leaf], s2[leaf]
            reps = k1 * k2
            who = np.repeat(np.arange(len(q)), reps)
            off = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            i, j = q[who, 0] + off // k2[who], q[who, 2] + off % k2[who]
            ok = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= distance)
            i, j = i[ok], j[ok]
            if len(i):
                joined = False
                while True:
                    a, b = parent[i], parent[j]
                    lo, hi = np.minimum(a, b), np.maximum(a, b)
                    m = lo != hi
                    if not m.any():
                        break
                    joined = True
                    np.minimum.at(parent, hi[m], lo[m])
                    while True:
                        up = parent[parent]
                        if (up == parent).all():
                            break
                        parent = up
                if joined:
                    changes = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
            p, dist = p[~leaf], dist[~leaf]
        if not len(p):
            continue
        bit = np.uint64(63 - depth)
        mid1 = np.searchsorted(keys, ((keys[p[:, 0]] >> bit) | np.uint64(1)) << bit)
        mid2 = np.searchsorted(keys, ((keys[p[:, 2]] >> bit) | np.uint64(1)) << bit)
        mid1, mid2 = np.minimum(mid1, p[:, 1]), np.minimum(mid2, p[:, 3])
        same = (p[:, 0] == p[:, 2])
        c = lambda a, b, x, y: np.stack([a, b, x, y], axis=1)
        near = np.concatenate([c(p[:, 0], mid1, p[:, 2], mid2), c(mid1, p[:, 1], mid2, p[:, 3])])
        far = np.concatenate([c(p[:, 0], mid1, mid2, p[:, 3]), c(mid1, p[:, 1], p[:, 2], mid2)[~same]])
        dn, df_ = np.concatenate([dist, dist]), np.concatenate([dist, dist[~same]]) + 1
        for kids, d in ((far, df_), (near, dn)):
            ok = (kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (d <= distance)
            if ok.any():
                stack.append((depth + 1, kids[ok], d[ok]))
    return parent


def _leaves(counts: dict[int, int], depth: int, base: int, rows: int, step: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Leaves (depth, prefix) of the node ``base`` at ``depth``, by counts of prefixes ``step`` deeper; and prefixes still too full."""
    out, full = [], []
    total: dict[tuple[int, int], int] = {}
    for p, n in counts.items():
        for k in range(step + 1):
            key = (depth + k, p >> (step - k))
            total[key] = total.get(key, 0) + n
    todo = [(depth, base)]
    while todo:
        d, p = todo.pop()
        n = total.get((d, p), 0)
        if not n:
            continue
        if n <= rows or d == BITS:
            out.append((d, p))
        elif d == depth + step:
            full.append(p)
        else:
            todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
    return out, full


def _node_pairs(leaves: list[tuple[int, int]], distance: int) -> list[tuple[int, int]]:
    """Index pairs of leaves whose prefixes differ in at most ``distance`` bits, found by walking node pairs from the root."""
    index = {x: i for i, x in enumerate(leaves)}
    inner = {(k, p >> (d - k)) for d, p in leaves for k in range(d)}
    have = inner | set(leaves)
    out, todo = [], [((0, 0), (0, 0), 0)]
    while todo:
        a, b, dist = todo.pop()
        if a in index and b in index:
            out.append((index[a], index[b]))
            continue
        if a == b:
            l, r = (a[0] + 1, 2 * a[1]), (a[0] + 1, 2 * a[1] + 1)
            new = [(l, l, dist), (r, r, dist), (l, r, dist + 1)]
        else:
            # go down on the shallower side that still has children; bits count once both sides know them
            x, y = (a, b) if a in inner and (a[0] <= b[0] or b not in inner) else (b, a)
            new = []
            for bit in (0, 1):
                k = (x[0] + 1, 2 * x[1] + bit)
                m = min(k[0], y[0])
                new.append((k, y, int(((k[1] >> (k[0] - m)) ^ (y[1] >> (y[0] - m))).bit_count())))
        todo += [(x, y, e) for x, y, e in new if e <= distance and x in have and y in have]
    return out


def near_links(classes: DataFrame, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) between fingerprints, enough to connect all at ``distance`` bits or fewer. ``classes``: distinct fp."""
    spark = classes.sparkSession
    ones = classes.agg(F.count("*"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(1)) for i in range(BITS)]).first()
    n = ones[0]
    order = sorted(range(BITS), key=lambda i: (abs(2 * (ones[i + 1] or 0) - n), i))
    node_rows = max(node_rows, n // MOST_NODES)
    leaves, full, depth, step = [], [0], 0, FIRST_STEP
    while full:
        want, lo = np.array(sorted(full), dtype=np.uint64), depth

        def count(it, want=want, lo=lo, step=step):
            for pdf in it:
                k = _permute(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), order)
                if lo:
                    k = k[np.isin(k >> np.uint64(BITS - lo), want)]
                p, c = np.unique(k >> np.uint64(BITS - lo - step), return_counts=True)
                yield pd.DataFrame({"p": p.astype(np.uint64).view(np.int64), "n": c})

        got: dict[int, dict[int, int]] = {}
        for r in classes.select("fp").mapInPandas(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect():
            p = r["p"] % (1 << 64)
            got.setdefault(p >> step, {})[p] = r["n"]
        full = []
        for base, counts in sorted(got.items()):
            new, more = _leaves(counts, depth, base, node_rows, step)
            leaves += new
            full += more
        depth, step = depth + step, STEP
    leaves.sort(key=lambda x: x[1] << (BITS - x[0]))
    starts = np.array([p << (BITS - d) for d, p in leaves], dtype=np.uint64)
    pairs = _node_pairs(leaves, distance)
    ends = sorted([(min(a, b), k, 0) for k, (a, b) in enumerate(pairs)] + [(max(a, b), k, 1) for k, (a, b) in enumerate(pairs) if a != b])
    node, pair, side = (np.array([e[i] for e in ends], dtype=np.int64) for i in range(3))
    first = np.searchsorted(node, np.arange(len(leaves) + 1))

    plan = spark.sparkContext.broadcast((starts, first, pair, side))

    def deal(it):
        starts, first, pair, side = plan.value
        for pdf in it:
            k = _permute(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), order)
            at = np.searchsorted(starts, k, side="right") - 1
            reps = first[at + 1] - first[at]
            who = np.repeat(np.arange(len(k)), reps)
            j = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + first[at][who]
            yield pd.DataFrame({"pair": pair[j], "side": side[j], "key": k.view(np.int64)[who], "fp": pdf["fp"].to_numpy()[who]})

    def walk(pdf):
        k = pdf["key"].to_numpy().view(np.uint64)
        o = np.argsort(k)
        k, fp, s = k[o], pdf["fp"].to_numpy()[o], pdf["side"].to_numpy()[o]
        cross = bool(s.any())
        if cross and s.all():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        parent = trie_forest(k, int((s == 0).sum()) if cross else None, distance)
        kids = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"a": fp[kids], "b": fp[parent[kids]]})

    return classes.select("fp").mapInPandas(deal, "pair long, side long, key long, fp long").groupBy("pair").applyInPandas(walk, "a long, b long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per row of ``df``: id, fp (signed 64 bits), fingerprint (hex), component_id (smallest id of the component)."""
    rows = materialize(with_fingerprint(df.select(id_col, text), text).select(id_col, "fp"), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("low")), "classes")
    comp = connected_components(near_links(classes, distance, node_rows))
    to = materialize(classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root")), "roots")
    names = to.groupBy("root").agg(F.min("low").alias("component_id"))
    to = to.join(names, "root").select("fp", "component_id")
    return rows.join(to, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
