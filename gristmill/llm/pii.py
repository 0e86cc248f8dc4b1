"""Format-preserving pseudonyms for personal data by keyed Feistel permutations. DataFrame functions only.

Numbers and dates that validate are ranked inside their format, the rank is permuted by a Feistel network over
Z_a x Z_b (a * b is the size of the format, so no rank leaves it and no cycle walking is needed), and the result is
written back in the same layout. A permutation keeps equal values equal and different ones apart, so records stay
linked across documents without a table of values. Round function: SHA-256 over key, kind, round and half.

Kinds: email (local part and host become a keyed digest under example.invalid), card (13-19 digits with a right
check digit; the new number has one too), bare 16-digit account numbers whose check digit is wrong (it stays wrong), phone, ssn (valid
areas only), ip, date (must exist, years 1 to 9999): year, month, day, or day, month, year in one or two digits with /, . or -; where that is no date, month, day, year. Each of
these is permuted among its like, so a pseudonym of one kind is none of another. Separators and missing leading zeros are kept.

The key is the caller's; who has it can invert every pseudonym. What does not validate stays as it is. Null text stays null with zero
counts; an empty text stays empty. Repeated rows are treated alike, very long texts whole. Empty input gives an empty result. A column
named like a count is replaced; other columns are kept, whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import free, table, text_or_empty

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
EDGE, END = r"(?<![A-Za-z0-9.@_+-])", r"(?![A-Za-z0-9_@-])"
ISO = r"[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2}"
DMY = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
KINDS = {"email": EMAIL, "date": f"(?:{ISO}|{DMY})", "ssn": SSN, "phone": PHONE, "card": CARD, "ip": IP}
ALL = f"{EMAIL}|(?<![A-Za-z0-9@_])(?:{ISO}|{DMY}|{SSN}|{PHONE}|{CARD}|{IP})(?![A-Za-z0-9_@]|[.-][0-9])"


def feistel(rank: Column, a, b, kind: str, key: str) -> Column:
    """Permutation of 0 .. a*b-1."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def mix(r, half, m):
        d = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), a.cast("string"), r.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(d, 1, 15), 16, 10).cast("long") % m

    def step(s, r):
        even = r % 2 == 0
        return F.struct(F.when(even, (s["l"] + mix(r, s["r"], a)) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + mix(r, s["l"], b)) % b).alias("r"))

    start = F.struct(F.call_function("div", rank - rank % b, b).alias("l"), (rank % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _pour(layout: Column, digits: Column) -> Column:
    """layout with its digits replaced, in order, by ``digits``."""
    chars = F.split(layout, "")
    def step(s, c):
        d = c.rlike("[0-9]")
        return F.struct(F.concat(s["t"], F.when(d, F.substr(digits, s["i"], F.lit(1))).otherwise(c)).alias("t"), (s["i"] + d.cast("int")).alias("i"))
    return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])


def _luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string that ends with its check digit."""
    def step(s, c):
        v = c.cast("int") * F.when(s["o"], 2).otherwise(1)
        return F.struct((s["n"] + v - F.when(v > 9, 9).otherwise(0)).alias("n"), (~s["o"]).alias("o"))
    return F.aggregate(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), F.struct(F.lit(0).alias("n"), F.lit(False).alias("o")), step, lambda s: s["n"])


def _permute_digits(d: Column, kind: str, key: str) -> Column:
    """Any run of 2 to 18 digits to one of the same length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    p = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    return F.lpad(feistel(d.cast("long"), p(n - u), p(u), kind, key).cast("string"), n, "0")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    head = F.substr(d, F.lit(1), F.length(d) - 1)
    new = _permute_digits(head, "card", key)
    good = F.pmod(10 - _luhn_sum(F.concat(new, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(_luhn_sum(d) % 10 == 0, _pour(m, F.concat(new, good))).when(m.rlike("^[0-9]{16}$"), _account(d, head, key))


def _account(d: Column, head: Column, key: str) -> Column:
    """16 digits with a wrong check digit to others: 15 free digits and one of the nine wrong ones, by rank."""
    right = lambda h: F.pmod(10 - _luhn_sum(F.concat(h, F.lit("0"))) % 10, F.lit(10))
    last = F.substr(d, F.lit(16), F.lit(1)).cast("int")
    new = feistel(head.cast("long") * 9 + last - (last > right(head)).cast("int"), 10**8, 9 * 10**7, "account", key)

    def written(n):
        to = F.lpad(F.call_function("div", n, F.lit(9).cast("long")).cast("string"), 15, "0")
        wrong = (n % 9).cast("int")
        return F.concat(to, (wrong + (wrong >= right(to)).cast("int")).cast("string"))

    return _let(new, written)


def _phone(m: Column, key: str) -> Column:
    cc = F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]?)(?=[(0-9])", 1)
    rest = F.substr(m, F.length(cc) + 1)
    return F.concat(cc, _pour(rest, _permute_digits(_digits(rest), "phone", key)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.regexp_extract(m, r"^([0-9]{3})-([0-9]{2})-([0-9]{4})$", i).cast("int") for i in (1, 2, 3))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = ((area - 1 - (area > 666).cast("int")).cast("long") * 99 + group - 1) * 9999 + serial - 1
    new = feistel(rank, 29634, 29997, "ssn", key)  # 898 * 99 * 9999 = 29634 * 29997
    a = F.floor(new / (99 * 9999)).cast("int")
    a = a + 1 + (a >= 665).cast("int")
    return F.when(ok, F.format_string("%03d-%02d-%04d", a, F.floor(new / 9999).cast("int") % 99 + 1, (new % 9999).cast("int") + 1))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    new = feistel(F.aggregate(o, F.lit(0).cast("long"), lambda s, x: s * 256 + x), 65536, 65536, "ip", key)
    part = lambda k: F.pmod(F.shiftright(new, k), F.lit(256)).cast("string")
    return F.when(F.forall(o, lambda x: x < 256), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def _let(x: Column, f) -> Column:
    """f(x) with x computed once: expressions that name it many times do not grow with what it is made of."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _late(day: Column, start: Column) -> Column:
    """Rank from the first of January of ``start`` on among the days after the 12th of a month."""
    return (F.datediff(day, F.make_date(start, F.lit(1), F.lit(1))) - 12 * (12 * (F.year(day) - start) + F.month(day))).cast("long")


#: Spans of years; their days and their days after a 12th, each as a product. Spans of 400 years lie between the first and the last.
NEAR, FIRST, LAST, OTHER = (1920, 2039, 487, 90, 177, 150), (1, 319, 213, 547, 75, 941), (9640, 9999, 123, 1069, 417, 191), (0, 399, 773, 189, 9833, 9)


def _pick(x: Column, of) -> Column:
    """The value ``of`` gives for the span of years that x.start begins."""
    out = F.when(x["start"] == NEAR[0], of(NEAR)).when(x["start"] == FIRST[0], of(FIRST)).when(x["start"] == LAST[0], of(LAST))
    return out.otherwise(of(OTHER)).cast("long")


def _late_day(rank: Column, x: Column) -> Column:
    """The day of a rank of :func:`_late`, by a guess of its month."""
    start, months, late = x["start"], _pick(x, lambda v: 12 * (v[1] - v[0] + 1)), _pick(x, lambda v: v[4] * v[5])
    guess = F.floor(rank * months / late).cast("int")
    near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.add_months(F.make_date(start, F.lit(1), F.lit(1)), F.greatest(guess + k, F.lit(0))))
    firsts = F.filter(near, lambda f: _late(F.date_add(f, 12), start) <= rank)
    return _let(F.array_max(firsts), lambda f: F.date_add(f, (rank - _late(F.date_add(f, 12), start) + 12).cast("int")))


def _moved(x: Column, key: str) -> Column:
    """The pseudonym of x.day, inside its span of years; x has american and start as well."""
    base = F.make_date(x["start"], F.lit(1), F.lit(1))
    plain = F.date_add(base, feistel(F.datediff(x["day"], base).cast("long"), _pick(x, lambda v: v[2]), _pick(x, lambda v: v[3]), "date", key).cast("int"))
    late = _let(feistel(_late(x["day"], x["start"]), _pick(x, lambda v: v[4]), _pick(x, lambda v: v[5]), "late date", key), lambda r: _late_day(r, x))
    return F.when(x["american"], late).otherwise(plain)


def _date(m: Column, key: str) -> Column:
    part = lambda i: F.regexp_extract(m, r"^([0-9]{1,4})([/.-])([0-9]{1,2})([/.-])([0-9]{1,4})$", i)
    when = lambda y, mo, d: F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    def found(p):
        first = F.when(p["iso"], when(p["a"], p["b"], p["c"])).otherwise(when(p["c"], p["b"], p["a"]))
        return F.struct(F.coalesce(first, F.when(~p["iso"], when(p["c"], p["a"], p["b"]))).alias("day"), (~p["iso"] & first.isNull()).alias("american"))

    def placed(x):
        y = F.year(x["day"])
        start = (F.when(y.between(1920, 2039), 1920).when(y < 320, 1).when(y >= 9640, 9640)
                 .when(y < 1920, 1920 - 400 * (1 + F.floor((1919 - y) / 400))).otherwise(2040 + 400 * F.floor((y - 2040) / 400)).cast("int"))
        return F.struct(x["day"].alias("day"), x["american"].alias("american"), start.alias("start"))

    def written(p, x, out):
        number = lambda v, short: F.when(short, v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0"))
        y, mo, d = F.lpad(F.year(out).cast("string"), 4, "0"), F.month(out), F.dayofmonth(out)
        iso_short, short = (F.length(p["b"]) == 1) | (F.length(p["c"]) == 1), (F.length(p["a"]) == 1) | (F.length(p["b"]) == 1)
        one, two = F.when(x["american"], mo).otherwise(d), F.when(x["american"], d).otherwise(mo)
        iso = F.concat(y, p["s"], number(mo, iso_short), p["t"], number(d, iso_short))
        return F.when(x["day"].isNotNull() & (F.year(x["day"]) >= 1), F.when(p["iso"], iso).otherwise(F.concat(number(one, short), p["s"], number(two, short), p["t"], y)))

    parts = F.struct(m.rlike(f"^{ISO}$").alias("iso"), part(1).alias("a"), part(2).alias("s"), part(3).alias("b"), part(4).alias("t"), part(5).alias("c"))
    return _let(parts, lambda p: _let(_let(found(p), placed), lambda x: _let(_moved(x, key), lambda out: written(p, x, out))))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), F.lit(1), F.lit(16)), F.lit("@example.invalid"))


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, new); both null when nothing validates."""
    make = {"email": _email, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "ip": _ip}
    out = None
    for kind, rx in KINDS.items():
        v = F.struct(F.lit(kind).alias("kind"), make[kind](m, key).alias("new"))
        c = m.rlike(f"^(?:{rx})$")
        out = F.when(c, v) if out is None else out.when(c, v)
    return out


def pseudonymize(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with its text pseudonymized and n_email, n_date, n_ssn, n_phone, n_card, n_ip."""
    t = text_or_empty(text)
    found = F.regexp_extract_all(t, F.lit(ALL), F.lit(0))
    made = F.transform(found, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p")))
    (name,) = free(df, "found")
    df = df.withColumn(name, F.when(t.rlike("[0-9@]") & t.rlike(ALL), made))
    p = F.col(name)
    new = F.array_join(F.zip_with(F.split(t, ALL, -1), p, lambda g, x: F.concat(g, F.coalesce(x["p"]["new"], x["m"], F.lit("")))), "")
    count = lambda k: F.coalesce(F.size(F.filter(p, lambda x: (x["p"]["kind"] == k) & x["p"]["new"].isNotNull())), F.lit(0)).cast("long")
    counts = {f"n_{k}": F.when(p.isNull(), F.lit(0).cast("long")).otherwise(count(k)) for k in KINDS}
    return df.withColumns(counts | {text: F.when(p.isNull(), F.col(text)).otherwise(new)}).drop(name)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes its key from the session; where none is set, a random one is set for the session, so nobody can invert its pseudonyms."""
    key = spark.conf.get("spark.gristmill.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.gristmill.pii.key", key)
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
