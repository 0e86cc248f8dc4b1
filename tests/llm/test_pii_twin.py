"""Pseudonyms against a plain Python twin, and permutations over whole formats."""

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from gristmill.llm import pii as P

KEY = "k"


def feistel(rank, a, b, kind):
    l, r = divmod(rank, b)
    for i in range(P.ROUNDS):
        half, m = (r, a) if i % 2 == 0 else (l, b)
        d = int(hashlib.sha256(f"{KEY}|{kind}|{a}|{i}|{half}".encode()).hexdigest()[:15], 16) % m
        l, r = ((l + d) % a, r) if i % 2 == 0 else (l, (r + d) % b)
    return l * b + r


def check_digit(head):
    v = [int(c) for c in head + "0"][::-1]
    return -sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(v)) % 10


def digits(d, kind):
    u = len(d) // 2
    return f"{feistel(int(d), 10 ** (len(d) - u), 10 ** u, kind):0{len(d)}d}"


def pour(layout, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def number(m):
    d = re.sub("[^0-9]", "", m)
    right = check_digit(d[:-1])
    if int(d[-1]) == right:
        head = digits(d[:-1], "card")
        return pour(m, head + str(check_digit(head)))
    if re.fullmatch("[0-9]{16}", m):
        new = feistel(int(d[:-1]) * 9 + int(d[-1]) - (int(d[-1]) > right), 10**8, 9 * 10**7, "account")
        head, wrong = f"{new // 9:015d}", new % 9
        return head + str(wrong + (wrong >= check_digit(head)))
    return m


def date(m):
    def on(y, mo, d):
        try:
            return dt.date(y, mo, d)
        except ValueError:
            return None

    iso = re.fullmatch(r"(\d{4})([/.-])(\d\d?)([/.-])(\d\d?)", m)
    if iso:
        c, s1, b, s2, a = iso.groups()
        day, american = on(int(c), int(b), int(a)), False
    else:
        a, s1, b, s2, y = re.fullmatch(r"(\d{1,2})([/.-])(\d{1,2})([/.-])(\d{4})", m).groups()
        day = on(int(y), int(b), int(a))
        american = day is None
        day = day or on(int(y), int(a), int(b))
    if day is None:
        return m
    # spans: 120 years around now, else 400 years, fewer at both ends
    lo, hi = next((x, z) for x, z in [(1920, 2039), (1, 319), (9640, 9999), *((k, k + 399) for k in (*range(320, 1920, 400), *range(2040, 9640, 400)))] if x <= day.year <= z)
    n = {(1920, 2039): ((487, 90), (177, 150)), (1, 319): ((213, 547), (75, 941)), (9640, 9999): ((123, 1069), (417, 191))}.get((lo, hi), ((773, 189), (9833, 9)))
    base = dt.date(lo, 1, 1)
    days = (dt.date(hi, 12, 31) - base).days + 1
    assert days == n[0][0] * n[0][1]
    if american:
        late = [d for d in (base + dt.timedelta(k) for k in range(days)) if d.day > 12]
        assert len(late) == n[1][0] * n[1][1]
        out = late[feistel(late.index(day), *n[1], "late date")]
    else:
        out = base + dt.timedelta(feistel((day - base).days, *n[0], "date"))
    w = 1 if len(a) == 1 or len(b) == 1 else 2
    x, z = f"{out.day:0{w}d}", f"{out.month:0{w}d}"
    if iso:
        return f"{out.year:04d}{s1}{z}{s2}{x}"
    return f"{z if american else x}{s1}{x if american else z}{s2}{out.year:04d}"


DATES = ["1987-05-12", "12/31/2020", "05-12-1987", "5/12/1987", "12/03.2020", "1.2.1999", "31.12.2039", "1/31/1920", "13/13/2000", "30-02-2001", "2001-02-30", "02/29/2000", "2/29/2001", "09/10/1950", "0399-02-28", "9999-12-31", "0001-01-01", "12/31/9998", "12/13/0005", "2020/12/31", "1999.01.02", "2020-1.2", "01.02.0319", "0320-01-01", "1/31/9640", "9639-12-31", "0000-05-05", "1600/2/29", "12/31/2440"]
NUMBERS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111111111111112", "9807915762804490", "0000000000000001", "378282246310005", "1234567890123", "9999999999999999"]


def test_twin(spark):
    rows = [(i, x) for i, x in enumerate(DATES + NUMBERS)] + [(900, f"{DATES[1]} and {NUMBERS[3]}, {DATES[1]}"), (901, None), (902, ""), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_p", F.lit("kept"))
    got = sorted((r["doc_id"], r["text"]) for r in P.pseudonymize(df, KEY).collect() if r["text"] is not None)
    want = [(i, date(x) if i < len(DATES) else number(x)) for i, x in rows[:len(DATES + NUMBERS)]] + [(900, f"{date(DATES[1])} and {number(NUMBERS[3])}, {date(DATES[1])}"), (902, "")]
    assert got == sorted(want)
    assert {r["_p"] for r in P.pseudonymize(df, KEY).collect()} == {"kept"}


def test_kinds_stay_apart(spark):
    """Numbers with a wrong check digit never become cards; month-first dates never become day-first ones; all stay different."""
    accounts = [f"{i * 7919 + 10**15:016d}" for i in range(3000)]
    accounts = [x for x in accounts if check_digit(x[:-1]) != int(x[-1])]
    first = dt.date(1920, 1, 1)
    late = [(first + dt.timedelta(k)) for k in range(0, 43830, 7) if (first + dt.timedelta(k)).day > 12]
    df = spark.createDataFrame([(x,) for x in accounts + [d.strftime("%m/%d/%Y") for d in late]], "text string")
    out = [r["text"] for r in P.pseudonymize(df, KEY).collect()]
    assert len(set(out)) == len(out)
    assert all(check_digit(x[:-1]) != int(x[-1]) for x in out if "/" not in x) and all(int(x[3:5]) > 12 and dt.datetime.strptime(x, "%m/%d/%Y") for x in out if "/" in x)


def test_long_addresses(spark):
    rows = ["a@b.co", "x" * 300 + "@host.example", "me@" + ".".join(f"h{i}" for i in range(5000)) + ".museum", "a@b", "two a.b+c@d-e.org, z@q.travelersinsurance."]
    got = [r["text"] for r in P.pseudonymize(spark.createDataFrame([(x,) for x in rows], "text string"), KEY).collect()]
    assert all(re.fullmatch(r"u[0-9a-f]{16}@example\.invalid", x) for x in got[:3]) and got[3] == "a@b" and re.fullmatch(r"two u\w{16}@example\.invalid, u\w{16}@example\.invalid\.", got[4])


def test_query_sets_a_random_key(spark):
    spark.conf.unset("spark.gristmill.pii.key")
    d = "/root/testdata/sf0.001"
    one = [r["text"] for r in P.op4_pii(spark, d).orderBy("doc_id").collect()]
    assert len(spark.conf.get("spark.gristmill.pii.key")) == 64 and one == [r["text"] for r in P.op4_pii(spark, d).orderBy("doc_id").collect()]
