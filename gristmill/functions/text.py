"""String, path and HTML helpers as Column expressions."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(stem: Column, marker: str = ".rf.") -> Column:
    """Text before the first marker."""
    return F.substring_index(stem, marker, 1)


def bucket100(key: Column) -> Column:
    """0..99 from an md5 prefix; the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 100).cast("int")


def split_of(key: Column) -> Column:
    b = bucket100(key)
    return F.when(b < 70, "train").when(b < 85, "val").otherwise("test")


def ascii_cut(text: Column, n: int) -> Column:
    return F.substring(F.regexp_replace(text, r"[^\x00-\x7F]", ""), 1, n)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def capture(text: Column, pattern: str) -> Column:
    """Group 1 of the first match in either case, else ''."""
    return F.coalesce(F.regexp_extract(text, f"(?i){pattern}", 1), F.lit(""))


def has_class(attribute: Column, token: str) -> Column:
    return F.array_contains(F.split(attribute, r"\s+"), token)


def size_text(w: Column, h: Column) -> Column:
    return F.format_string("%dx%d", w, h)


def quote_plus(text: Column) -> Column:
    """Form encoding of UTF-8 bytes: letters, digits and _.-~ stay, spaces become +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def average_ms(seconds: Column, batches: Column, batch: Column) -> Column:
    return F.when(batches * batch > 0, F.format_string("%.2f", 1000 * seconds / (batches * batch))).otherwise("0.00")


def unescape(text: Column) -> Column:
    """HTML character references; Spark has no such function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_html.unescape, na_action="ignore")

    return run(text)
