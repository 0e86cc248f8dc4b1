"""Repair of conversations: A* on the edit lattice of each one.

The rows of a conversation, in order, are the lattice's columns and the role wanted next is its state. Each row is kept (0), given
the role user or assistant (1) or deleted (2; blank and repeated rows must be), and a turn without text may be inserted before any row or
at the end (5). A truncated row that stays is charged 5. The repaired roles read ``(system? (user assistant)+)?``, by initials. A*
takes nodes in the order (cost so far + heuristic, audit), where the heuristic is the suffix sum of mandatory deletions (2 a row) and of the least
charge a truncated row can have (2, for deleting it); it is consistent, so the first visit of a node is its cheapest, and of equal
ones the one with the ASCII-least audit (the initials of the edits: D, I, K, R).

Distribution: rows are numbered in the order (conversation, turn, role, text) by a range sort. Blocks of ``BLOCK`` numbers are searched
alone, for each state the block may be entered in, so a conversation of any length is many tasks; what joins the blocks of
one conversation is a stream of small tables (four states to four states; some 40 bytes a turn are held until its end). Paths to equal rows never end in an insertion, so
none is the beginning of another and their order carries over from block to block. Repeated texts are found by hash, with counts merged map-side.
Only the digest of a whole conversation is made in order, by one task that holds a batch of rows at a time.

Order and nulls: turns ascend, null turns come first, rows of one turn go by role and the md5 of their text. Null role or text is one
space, so null text is blank and a null role can only be replaced or deleted. A null conv_id is a conversation of its own. Equal rows are
repeats of each other. Other columns are not read, so no name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import SPACE, small, table
from gristmill.operators.split import dense_ids
from gristmill.sources.materialize import materialize, release

BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. NEXT has what a role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}


def search(initials: str, faults: str, start: int = START, tail: bool = True) -> dict[int, tuple[int, str]]:
    """Cheapest cost and audit from ``start`` before the first row to each state after the last one.

    ``initials``: role initials ('-' for none of s, u, a); ``faults``: '.', 'B'lank, 'D'uplicate, 'T'runcated, one each per
    row. Paths end with a row's edit, or with insertions too if ``tail``.
    """
    n = len(faults)
    rest = [0] * (n + 1)  # admissible: each of these faults costs at least as much as a deletion
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if faults[i] in "BD" else min(DELETE, TRUNCATED) if faults[i] == "T" else 0)
    heap, closed, out = [(rest[0], "", 0, start)], set(), {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost, steps = f - rest[i], []
        if i == n:
            out[state] = (cost, audit)
            if not tail:
                continue
        else:
            steps.append((DELETE, "D", i + 1, state))
            if faults[i] in ".T":
                more = TRUNCATED if faults[i] == "T" else 0
                if initials[i] in NEXT[state]:
                    steps.append((KEEP + more, "K", i + 1, NEXT[state][initials[i]]))
                steps += [(REROLE + more, "R", i + 1, to) for role, to in NEXT[state].items() if role != "s"]
        steps += [(INSERT, "I", i, to) for role, to in NEXT[state].items() if role != "s"]
        for c, edit, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(heap, (cost + c + rest[j], audit + edit, j, to))
    return out


def steps(audit: str, initials: str, state: int = START) -> tuple[list[tuple[str, str]], str, int]:
    """For each row: the initials of the turns inserted before it and its outcome (D, K, or u or a, its new role); the insertions at the end; the last state."""
    out, before, i = [], "", 0
    for edit in audit:
        if edit in "IR":
            role = next(r for r in NEXT[state] if r != "s")
            state = NEXT[state][role]
        elif edit == "K":
            state = NEXT[state][initials[i]]
        if edit == "I":
            before += role
        else:
            out.append((before, role if edit == "R" else edit))
            before, i = "", i + 1
    return out, before, state


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that crc32 of ``conv_id:turn`` deals out; null parts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), k.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("k") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _key() -> Column:
    return F.struct(F.col("conv_id").cast("string").alias("conv_id")).alias("c")


def _numbered(df: DataFrame) -> DataFrame:
    """c (struct of conv_id as text: a null one is a key like others, and pandas cannot round it), g (its number in the order of all rows), turn, role, text, fault, initial."""
    rows = df.select(_key(), "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("h"))
    held = dense_ids(rows, ["c", "turn", "role", "h"], "g")
    held = materialize(held, "turns")
    # all rows of a role and text in a conversation after the first are repeats of it
    many = materialize(held.groupBy("c", "role", "h").agg(F.min("g").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repeats")
    held = held.join(small(many, many.count(), 128), ["c", "role", "h"], "left")
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    fault = F.when(last == "", "B").when(F.col("g") > F.col("first"), "D").when(~last.isin(".", "!", "?"), "T").otherwise(".")
    return materialize(held.select("c", "g", F.floor((F.col("g") - 1) / BLOCK).alias("block"), "turn", "role", "text", fault.alias("fault"), F.substring("role", 1, 1).alias("initial")), "rows")


PLAN = "c struct<conv_id:string>, block long, edits array<struct<ins:string,op:string>>, tail string, n long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _tables(rows: DataFrame) -> DataFrame:
    """One row per conversation and block: its counts, what adjoins the next block, and ways (entry, exit, cost, audit)."""
    seq = F.array_sort(F.collect_list(F.struct("g", "initial", "fault", "turn")))
    b = rows.groupBy("c", "block").agg(seq.alias("q"))
    pick = lambda f: F.transform("q", lambda x: x[f])
    seen = lambda f: F.array_join(F.transform("q", lambda x: F.when(x["initial"].isin("s", "u", "a"), x["initial"]).otherwise("-")) if f == "initial" else pick(f), "")
    b = b.select("c", "block", seen("initial").alias("initials"), seen("fault").alias("faults"), F.filter(pick("turn"), lambda t: t.isNotNull()).alias("t"))

    @F.pandas_udf("array<struct<entry:int,exit:int,cost:long,audit:string>>")
    def ways(initials: pd.Series, faults: pd.Series) -> pd.Series:
        found = {}
        for key in zip(initials, faults):
            if key not in found:
                found[key] = [{"entry": s, "exit": e, "cost": c, "audit": a} for s in NEXT for e, (c, a) in search(*key, s, tail=False).items()]
        return pd.Series([found[key] for key in zip(initials, faults)])

    return b.select("c", "block", "initials", "faults", F.struct(F.array_min("t").cast("string").alias("lo"), F.array_max("t").cast("string").alias("hi")).alias("t"), F.size(F.array_distinct("t")).alias("turns"), ways("initials", "faults").alias("ways"))


def _close(blocks: list) -> tuple[int, str, list[tuple[int, str]], str]:
    """Cost, final insertions' audit, (entry state, audit) of each block on the cheapest path: four states carried over the blocks."""
    at = {START: (0, 0)}  # state: cost, rank of its audit among the paths here
    back = []
    for b in blocks:
        best = {}
        for w in b["ways"]:
            if w["entry"] in at:
                cost, rank = at[w["entry"]]
                key = (cost + w["cost"], rank, w["audit"])
                if w["exit"] not in best or key < best[w["exit"]][0]:
                    best[w["exit"]] = (key, w["entry"])
        order = sorted(best, key=lambda s: best[s][0][1:])
        at = {s: (best[s][0][0], order.index(s)) for s in best}
        back.append({s: (best[s][1], best[s][0][2]) for s in best})
    ends = []
    for s, (cost, rank) in at.items():
        for e, (c, a) in search("", "", s).items():
            if e in ENDS:
                # of equal costs the smaller rank wins: neither path is the beginning of the other
                ends.append((cost + c, rank, a, s))
    cost, _, tail, state = min(ends)
    path = []
    for b in reversed(back):
        state, audit = b[state]
        path.append((state, audit))
    return cost, tail, path[::-1]


def _finish(blocks: list) -> list[tuple]:
    """Rows of PLAN after c: one per block with its edits; the last one has the counts of the whole conversation too."""
    cost, tail, path = _close(blocks)
    out, last_initial, last_turn, turns, illegal = [], None, None, 0, 0
    for b, (state, audit) in zip(blocks, path):
        edits, _, _ = steps(audit, b["initials"], state)
        out.append([b["block"], [{"ins": i, "op": o} for i, o in edits], None] + [None] * 8)
        s = (last_initial or "") + b["initials"]
        illegal += sum(s[i:i + 2] not in ("su", "ua", "au") for i in range(len(s) - 1))
        last_initial = b["initials"][-1]
        if b["turns"]:
            turns += b["turns"] - (b["t"]["lo"] == last_turn)
            last_turn = b["t"]["hi"]
    known = [b for b in blocks if b["turns"]]
    gaps = int(known[-1]["t"]["hi"]) - int(known[0]["t"]["lo"]) + 1 - turns if known else 0
    faults = "".join(b["faults"] for b in blocks)
    state = START
    for b, (s, audit) in zip(blocks, path):
        state = steps(audit, b["initials"], s)[2]
    closing = steps(tail, "", state)[1]
    out[-1][2:] = [closing, len(faults), gaps, *(faults.count(f) for f in "BDT"), illegal, cost, "".join(a for _, a in path) + tail]
    return [tuple(x) for x in out]


def plans(rows: DataFrame) -> DataFrame:
    """PLAN: the edits of each block; the last block of a conversation also has n (rows), counts, cost and audit."""
    columns = ["c", "block", "edits", "tail", "n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(it):
        held, now, first = [], None, True
        for pdf in it:
            out = []
            for b in pdf.to_dict("records"):
                if first or b["c"] != now:
                    out += [(now, *x) for x in _finish(held)] if held else []
                    held, now, first = [], b["c"], False
                held.append(b)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(now, *x) for x in _finish(held)], columns=columns)

    return _tables(rows).repartition("c").sortWithinPartitions("c", "block").mapInPandas(run, PLAN)


def _lines(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their edit e and the tail of their conversation on its last row."""
    p = plan.select("c", "block", "edits", "tail")
    w = Window.partitionBy("c", "block").orderBy("g")
    held = rows.join(p, ["c", "block"]).withColumn("i", F.row_number().over(w))
    return held.withColumns({"e": F.get("edits", F.col("i") - 1), "tail": F.when(F.col("i") == F.size("edits"), F.col("tail"))}).drop("edits", "i")


def _inserted(initials: Column) -> Column:
    return F.transform(F.filter(F.split(initials, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))


def repaired_turns(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """c, g, turns (role and text, in order) of each row that leaves something."""
    role = F.when(F.col("e.op") == "u", "user").when(F.col("e.op") == "a", "assistant").otherwise(F.col("role"))
    own = F.when(F.col("e.op") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), "text")))
    turns = F.concat(_inserted(F.col("e.ins")), own, _inserted(F.coalesce("tail", F.lit(""))))
    return _lines(rows, plan).select("c", "g", turns.alias("turns")).filter(F.size("turns") > 0)


def _digests(turns: DataFrame) -> DataFrame:
    """c, sha256 of the lines ``role:text``: rows arrive sorted, and a task holds one batch of them."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    rows = turns.select("c", "g", text.alias("s"))

    def run(it):
        now, h = None, None
        for pdf in it:
            out = []
            for c, s in zip(pdf["c"], pdf["s"]):
                if h is None or c != now:
                    out += [(now, h.hexdigest())] if h else []
                    now, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(s.encode("utf-8", "surrogatepass"))
            if out:
                yield pd.DataFrame(out, columns=["c", "repaired_sha256"])
        if h:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["c", "repaired_sha256"])

    return rows.repartition("c").sortWithinPartitions("c", "g").mapInPandas(run, "c struct<conv_id:string>, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit_conversations(df: DataFrame, original: DataFrame) -> DataFrame:
    """One row per conv_id of ``original``: conv_id, the COUNTS, audit, repaired_sha256. ``df``: conv_id, turn, role, text without null role or text."""
    rows = _numbered(df)
    plan = materialize(plans(rows), "plan")
    whole = plan.filter(F.col("audit").isNotNull()).select("c", *COUNTS, "audit")
    sums = materialize(_digests(repaired_turns(rows, plan)), "digests")
    ids = original.select("conv_id", _key()).distinct()
    out = ids.join(whole, "c", "left").join(sums, "c", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def repair(df: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text of the repaired conversations; ``df``: conv_id, turn, role, text."""
    rows = _numbered(df.select("conv_id", "turn", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")]))
    turns = repaired_turns(rows, materialize(plans(rows), "plan"))
    flat = turns.select("c", "g", F.posexplode("turns").alias("p", "t"))
    flat = dense_ids(flat, ["c", "g", "p"], "n")
    first = materialize(flat.groupBy("c").agg(F.min("n").alias("n0")), "first")
    return flat.join(first, "c").select(F.col("c.conv_id").cast(df.schema["conv_id"].dataType).alias("conv_id"), (F.col("n") - F.col("n0") + 1).alias("position"), "t.role", "t.text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return audit_conversations(damage(turns), turns)
