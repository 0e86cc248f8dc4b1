"""Language ID, language-model scoring and HTML extraction."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import language_id as L
from gristmill.llm import lm_score as M

WORDS = {"aa": ["the", "and", "house", "thing"], "bb": ["der", "und", "haus", "über"]}


def texts():
    r = np.random.default_rng(0)
    return [(i, " ".join(r.choice(WORDS[g], 12)), g) for i in range(120) for g in (["aa", "bb"][i % 2],)]


def ppm_bits(counts, context, x, least=2):
    """Code length by definition: blended PPM, method C, over the contexts seen at least ``least`` times."""
    p = 1 / 256
    for order in range(L.ORDER + 1):
        c = {}
        for g, n in counts.items():
            if g[L.ORDER - order:-1] == context[L.ORDER - order:]:
                c[g[-1]] = c.get(g[-1], 0) + n
        n, d = sum(c.values()), len(c)
        if n < least and order:
            break
        p = (c.get(x, 0) + d * p) / (n + d)
    return -math.log2(p)


@pytest.mark.parametrize("least", [1, 2])
def test_code_lengths_are_exact(least):
    s = L.symbols("The Häuser 12 und")
    assert bytes(s).decode() == "    the häuser und"
    train = "the häuser und the haus unter dem haus, die häuser"
    k, c = np.unique(L.grams(L.symbols(train)), return_counts=True)
    m = L.Model({"aa": (k, c)}, least)
    counts = {int(g).to_bytes(L.ORDER + 1, "big"): int(n) for g, n in zip(k, c)}
    for context in (b"    ", b"haus", b" hau", b"zzha", b"zzzz"):
        bits = m.gram_bits(np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)]))[:, 0]
        assert math.isclose(np.exp2(-bits.astype(float)).sum(), 1, rel_tol=1e-4)  # every context is a distribution
        assert np.allclose(bits, [ppm_bits(counts, context, x, least) for x in range(256)], atol=1e-3)
    text = "das haus unten"
    t = bytes(L.symbols(text))
    want = sum(ppm_bits(counts, t[i - L.ORDER:i], t[i], least) for i in range(L.ORDER, len(t)))
    assert np.allclose(m.code_lengths([text, "", text]), [[want], [0], [want]], atol=1e-2)


def test_texts_in_pieces(monkeypatch):
    k, c = np.unique(L.grams(L.symbols("the cat sat on the mat")), return_counts=True)
    m, some = L.Model({"aa": (k, c), "bb": (k[:5], c[:5])}), ["the cat " * 40, "", "a", "über mat " * 9]
    whole = m.code_lengths(some)
    pieces = lambda texts, most: L_pieces(texts, 7)
    L_pieces = L._pieces
    monkeypatch.setattr(L, "_pieces", pieces)
    assert np.allclose(m.code_lengths(some), whole)


def test_language_id(spark):
    df = spark.createDataFrame([*texts(), (900, None, "aa"), (901, "", None), (902, "12 34!", "bb"), (903, "the house " * 20_000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    r = {x["doc_id"]: x for x in L.identify(df, L.fit(df, F.col("doc_id") % 4 != 2)).collect()}
    assert sum(r[i]["lang_pred"] == g for i, _, g in texts() if i % 4 == 2) == 30
    assert all((r[i]["lang_pred"], r[i]["score"]) == ("und", 0.0) for i in (900, 901, 902)) and r[903]["lang_pred"] == "aa"
    none = df.limit(0)
    assert L.identify(none, L.fit(none)).count() == 0
    assert L.identify(df.limit(3), L.fit(none)).first()["lang_pred"] == "und"


def vocabulary(train, head=1 << 17):
    c = Counter(w for t in train for w in M.words(t))
    top, tree = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:head], M.Tree(M.levels_for(len(c) + 1))
    mass = np.full(tree.buckets, 0.5)
    for k, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))):
        if k >= min(head, tree.words - 1):
            mass[crc32(w) % tree.buckets] += n + 0.5
    return M.Vocabulary(top, sum(c.values()) + len(train), len(c) + 1, len(train), mass, tree), c, tree


def test_tree_sums_to_one():
    r = np.random.default_rng(0)
    for distinct in (100, 3 << 24):
        n = len(M.Tree(M.levels_for(distinct)).depth)
        m = M.MaxEnt(r.random(n) + 0.1, distinct, bits=10)
        for t in m.t:
            t += r.normal(size=t.shape).astype(np.float32)
        lp = m.logp(np.arange(n), np.full(n, 3, dtype=np.uint64), np.full(n, 7, dtype=np.uint64))
        assert math.isclose(np.exp(lp.astype(float)).sum(), 1, rel_tol=1e-3)
        assert len({tuple(zip(p[:d], c[:d])) for p, c, d in zip(m.tree.path.T.tolist(), m.tree.choice.T.tolist(), m.tree.depth.tolist())}) == n
    assert [M.levels_for(x) for x in (0, 1 << 23, 1 << 24, 1 << 26, 1 << 28, 1 << 40)] == [4, 4, 5, 5, 6, 6]


def plain_counts(m, tokens):
    """Observed and expected counts by definition, token by token."""
    seen, expected, total = [{}, {}, {}], [{}, {}, {}], 0.0
    for y, h1, h2 in tokens:
        for k in range(m.tree.depth[y]):
            node, choice = int(m.tree.path[k, y]), int(m.tree.choice[k, y])
            rows = [int(x[0]) for x in m.rows(np.array([node]), m.features(np.array([h1], dtype=np.uint64), np.array([h2], dtype=np.uint64)))]
            z = [float(m.base[node, c]) + sum(float(m.t[j][rows[j], c]) for j in range(3)) for c in range(M.FAN)]
            s = sum(map(math.exp, z))
            total += z[choice] - math.log(s)
            for j in range(3):
                seen[j][rows[j], choice] = seen[j].get((rows[j], choice), 0) + 1
                for c in range(M.FAN):
                    expected[j][rows[j], c] = expected[j].get((rows[j], c), 0) + math.exp(z[c]) / s
    return seen, expected, total


def test_training_against_plain_counts():
    train = [t for _, t, _ in texts()][:30] + ["", "the new the"]
    vocab, _, _ = vocabulary(train, head=5)
    codes = [vocab.encode([M.words(t)])[1] for t in train]
    r, together, first, outside = vocab.encode([M.words(t) for t in train])
    assert np.array_equal(together, np.concatenate(codes)) and first.tolist() == np.cumsum([0] + [len(c) for c in codes[:-1]]).tolist()
    assert outside == [w for t in train for w in M.words(t) if w not in vocab.rank] and (r < 0).sum() == len(outside)
    y, h1, h2, at = M.history(np.concatenate(codes), [len(c) for c in codes])
    assert (at % (1 << 31)).tolist() == [k for c in codes for k in range(len(c))] and len(set(at)) > 0.9 * len(at)
    m = M.MaxEnt(vocab.mass, 20, bits=8)
    tokens = []
    for t in train:
        hist = [M.NO_WORD, M.NO_WORD]
        for code in vocab.encode([M.words(t)])[1].tolist():
            tokens.append((code >> M.EXTRA, hist[-1], hist[-2]))
            hist.append(code + 1)
    assert tokens == list(zip(y.tolist(), h1.tolist(), h2.tolist()))
    last = -math.inf
    for step in range(4):
        want_seen, want_expected, total = plain_counts(m, tokens)
        assert math.isclose(m.logp(y, h1, h2).sum(), total, rel_tol=1e-4) and total > last
        last = total
        seen, expected = [np.zeros(t.shape, dtype=np.int64) for t in m.t], [np.zeros(t.shape, dtype=np.int64) for t in m.t]
        m.observe(y, h1, h2, at, seen)
        for k in range(400):  # other places draw other choices
            m.expect(y, h1, h2, at + np.arange(len(at)) * 977 + 10**6 * k, expected)
        for j in range(3):
            assert {(int(a), int(b)): seen[j][a, b] for a, b in zip(*np.nonzero(seen[j]))} == want_seen[j]
            assert expected[j].sum() == 400 * seen[j].sum()
            assert all(abs(expected[j][k] / 400 - v) < 6 * math.sqrt(4 * v / 400) + 0.1 for k, v in want_expected[j].items())
        m.start(seen) if not step else m.step(seen, [e / 400 for e in expected])


def test_score_does_not_depend_on_splits_and_beats_the_base(spark):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"{a} {a}x{r.integers(3)}" for a in r.choice(["red", "blue", "green", "old"], 15)) + f" then{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 5 != 1
    one, many = ({x["doc_id"]: x for x in M.score(df.repartition(n), train, head=6).collect()} for n in (1, 16))
    assert all(math.isclose(one[i]["score"], many[i]["score"], rel_tol=1e-12) and math.isclose(one[i]["base_score"], many[i]["base_score"], rel_tol=1e-12) for i, _ in rows)
    held = [i for i, _ in rows if i % 5 == 1]
    assert sum(one[i]["score"] for i in held) > 0.8 * sum(one[i]["base_score"] for i in held)


def test_scores_of_all_words_sum_to_one(spark):
    """The probabilities of every training word, the end and one unseen word of each bucket after the start of a text."""
    train = [t for _, t, _ in texts()] + [f"w{i} w{i} w{i // 2}" for i in range(300)]
    vocab, c, tree = vocabulary(train, head=20)
    m = M.MaxEnt(vocab.mass, len(c) + 1, bits=8)
    for t in m.t:
        t += np.random.default_rng(1).normal(size=t.shape).astype(np.float32)
    total = 0.0
    for w in [*c, None]:
        code = int(vocab.encode([[w] if w else []])[1][0])
        lp = m.logp(np.array([code >> M.EXTRA]), np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64))[0] / M.LOG10
        if w is not None and (code >> M.EXTRA) >= tree.words:
            lp += math.log10(c[w] + 0.5) - vocab.bucket_log[(code >> M.EXTRA) - tree.words]
        total += 10 ** lp
    unseen = m.logp(np.arange(tree.words, tree.words + tree.buckets), np.zeros(tree.buckets, dtype=np.uint64), np.zeros(tree.buckets, dtype=np.uint64))
    total += float((np.exp(unseen) * 0.5 / 10 ** vocab.bucket_log).sum())
    empty = np.arange(min(20, len(c)) + 1, tree.words)  # leaves that stand for no word
    total += float(np.exp(m.logp(empty, np.zeros(len(empty), dtype=np.uint64), np.zeros(len(empty), dtype=np.uint64))).sum())
    assert math.isclose(total, 1, rel_tol=1e-3)


@pytest.mark.parametrize("head", [3, 1 << 17])
def test_base_scores(spark, head):
    rows = [(i, t, "x") for i, t, _ in texts()] + [(500, None, "x"), (501, "New THE the", "x"), (502, "the", "x"), (502, "the", "x"), (None, "the\x0bzz zz", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    train = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))
    got = M.score(df, train, head=head).collect()
    assert len(got) == len(rows)
    c, n = {}, 0
    for i, t, _ in rows:
        if i is not None and i % 5 != 1:
            for w in [*M.words(t), b" end"]:
                c[w], n = c.get(w, 0) + 1, n + 1
    for r in got:
        toks = [*M.words(next(x[1] for x in rows if x[0] == r["doc_id"])), b" end"]
        want = sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (len(c) + 1))) for w in toks)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["train_tokens"] == n
        assert r["n_tokens"] == len(toks) and r["n_known"] == sum(w in c for w in toks) and r["score"] < 0
    clash = M.score(df.withColumns({"rid": F.lit("x"), "codes": F.lit(1), "train": F.lit(2), "tok": F.lit(3)}), train, head=head).collect()
    assert sorted(map(str, clash)) == sorted(map(str, got))
    assert M.score(df.limit(0), train).count() == 0
