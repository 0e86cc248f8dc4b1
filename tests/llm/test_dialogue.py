"""Conversation repair against an exhaustive dynamic program over whole strings."""

import hashlib
import re
import zlib

import numpy as np

from gristmill.llm import dialogue as R

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [] if k == 0 else [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def expected(rows, ids):
    """conv: the operator's columns. Keeps, for each role string's last state, the least (cost, audit) over all edits; no heuristic, no blocks."""
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        state = lambda roles: roles[-1:] or "-"
        ok = lambda roles: bool(re.match(r"s?(ua)*u?\Z", roles))
        best = {"-": (0, "", "", [])}  # last role: cost, audit, roles, lines

        def inserts(best):
            for _ in range(3):
                for cost, audit, roles, lines in list(best.values()):
                    for r, name in (("u", "user"), ("a", "assistant")):
                        if ok(roles + r):
                            new = (cost + 5, audit + "I", roles + r, [*lines, f"{name}:"])
                            best[r] = min(best.get(r, new), new, key=lambda x: x[:2])
            return best

        for (_, _, role, text), fault in zip(own, faults):
            new = {}
            for cost, audit, roles, lines in inserts(dict(best)).values():
                opts = [(cost + 2, audit + "D", roles, lines)]
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    opts.append((cost + more, audit + "K", roles + (role[:1] or "?"), [*lines, f"{role}:{text}"]))
                    opts += [(cost + 1 + more, audit + "R", roles + r, [*lines, f"{name}:{text}"]) for r, name in (("u", "user"), ("a", "assistant"))]
                for o in opts:
                    if ok(o[2]):
                        k = state(o[2])
                        new[k] = min(new.get(k, o), o, key=lambda x: x[:2])
            best = new
        cost, audit, _, lines = min((x for x in inserts(dict(best)).values() if GRAMMAR.match(x[2])), key=lambda x: x[:2])
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed=5):
    r = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Fine. \x0b", "é", "x\x85", None, "a\nb.", "end。"]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "User", "u2"]
    rows = []
    for conv in [*range(60), None]:
        n = 40 if conv in (7, None) else int(r.integers(0, 9))
        for t in range(n):
            good = r.random() < 0.5
            rows.append((conv, None if r.random() < 0.05 else int(t + (r.random() < 0.1)), ("user", "assistant")[t % 2] if good else roles[r.integers(len(roles))], f"Text {t}." if good else texts[r.integers(len(texts))]))
    rows += [(100, t, "user", "Same.") for t in range(30)] + [(101, 2**60, "user", "Big."), (101, 2**60 + 3, "assistant", "w " * 100_000 + ".")] + [(102, None, None, None)] * 3 + [(103, 5, "user", "Twice.")] * 2
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = R.audit_conversations(R.damage(df), df).collect()
    ids = {r[0] for r in rows}
    assert len(got) == len(ids)
    return {r["conv_id"]: (*[r[k] for k in R.COUNTS], r["audit"], r["repaired_sha256"]) for r in got}, expected(damaged(rows), ids)


def test_matches_exhaustive_search(spark, monkeypatch):
    rows = conversations()
    got, want = run(spark, rows)
    assert got == want and len({x[6] for x in want.values()}) > 25
    monkeypatch.setattr(R, "BLOCK", 3)  # conversations over many blocks
    assert run(spark, rows)[0] == want


def test_search_is_the_same_in_pieces():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 12))
        s, f = "".join(r.choice(list("suua-a"), n)), "".join(r.choice(list("...TBD"), n))
        cuts = [0, *sorted(r.integers(0, n + 1, 2).tolist()), n]
        blocks = [{"ways": [{"entry": a, "exit": e, "cost": c, "audit": t} for a in R.NEXT for e, (c, t) in R.search(s[x:y], f[x:y], a, tail=False).items()]} for x, y in zip(cuts, cuts[1:]) if x < y]
        whole = R.search(s, f)
        cost, tail, path = R._close(blocks)
        assert (cost, "".join(a for _, a in path) + tail) == min(whole[e] for e in R.ENDS if e in whole)


def test_empty_and_all_dropped(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.audit_conversations(R.damage(df), df).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "Hi.")], df.schema)
    r = R.audit_conversations(R.damage(df), df).collect()
    assert [tuple(x) for x in r] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_legal(spark):
    rows = [r for r in conversations(8) if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(R.repair(df.withColumn("g", df["turn"])).collect(), key=lambda r: (r["conv_id"], r["position"])):
        got.setdefault(r["conv_id"], []).append((r["position"], r["role"]))
    assert len(got) > 40
    for turns in got.values():
        assert [p for p, _ in turns] == list(range(1, len(turns) + 1)) and GRAMMAR.match("".join(x[0] for _, x in turns))
