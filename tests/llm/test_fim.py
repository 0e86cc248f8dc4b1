"""Fill-in-middle against a plain Python version and its own round trip."""

import hashlib
import re

from pyspark.sql import functions as F

from gristmill.llm import fim


def plain_python(doc_id, text, rate=100, spm=50, pattern=fim.LINES):
    t = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    u = re.findall(pattern, t)
    assert "".join(u) == t
    lo, hi = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    a, m, z = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, t
    if h4 % 100 < spm:
        return len(u), "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return len(u), "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


ROWS = [(0, None), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "one line"), (5, "a\nb\nc\n"), (6, "a\r\nb\x0bc\x85d\n\n"), (7, "é𝄞\n𝄞𝄞x\nñ\n"), (8, "has <M> in it\nb\n"), (9, "<S"), (10, "x<\n<P\n<S\nM>\n>\n" * 3),
        (11, "w " * 50_000 + "\n" + "l\n" * 3000), (None, "no id\nhere\n"), (12, "same\nrow\n"), (12, "same\nrow\n"), (12, "same id\nother\ntext\n"), (13, " \t \n  ")] + [(100 + i, "".join(f"line {j}{'!' * (i * j % 7)}\n" for j in range(i % 13))) for i in range(150)]


def check(got, **kw):
    assert len(got) == len(ROWS)
    want = sorted(((str(i), t or "", *plain_python(i, t, **kw)) for i, t in ROWS), key=repr)
    have = sorted(((str(r["doc_id"]), r["text"] or "", r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr)
    assert have == want
    assert all((r["text"] or "") == r["back"] for r in got)


def test_matches_plain_python(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    back = fim.restore(F.col("output"), F.col("form")).alias("back")
    got = fim.fill_in_middle(df).select("*", back).collect()
    check(got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    monkeypatch.setattr("gristmill.llm.common.BROADCAST_BYTES", 0)  # the shuffle join gives the same
    check(fim.fill_in_middle(df, rate=60, spm=20).select("*", back).collect(), rate=60, spm=20)
    words = r"[^ ]* |[^ ]+"
    check(fim.fill_in_middle(df, pattern=words).select("*", back).collect(), pattern=words)


def test_clashing_names_and_empty(spark):
    names = ["_fk", "_ft", "_fid", "_fn", "_lo", "_a", "_b", "_form", "_in0", "n", "output", "ordinal"]
    df = spark.createDataFrame([(1, "a\nb\n", *["k"] * len(names))], ["doc_id", "text", *names])
    out = fim.fill_in_middle(df)
    r = out.first()
    assert out.columns == ["doc_id", "text", *[n for n in names if n not in ("n", "output")], *fim.ADDED]
    assert all(r[n] == "k" for n in names if n not in ("n", "output")) and r["n"] == 2
    assert fim.fill_in_middle(df.limit(0)).count() == 0
