"""Nested HTML field extraction with the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import capture

CARD = "struct<photo_id:string,title:string,alt:string,thumbnail_url:string>"


class _Page(HTMLParser):
    """The last h1 as title, the last h3 that begins with a prefix as credit, and all text; pieces are stripped and joined by one space."""

    def __init__(self, prefix: str):
        super().__init__(convert_charrefs=True)
        self.prefix, self.open, self.title, self.credit, self.text = prefix, {}, "", "", []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h3"):
            self.open[tag] = []

    def handle_endtag(self, tag):
        if tag in self.open:
            found = " ".join(self.open.pop(tag))
            if tag == "h1":
                self.title = found
            elif found.startswith(self.prefix):
                self.credit = found

    def handle_data(self, data):
        piece = data.strip()
        if piece:
            self.text.append(piece)
            for pieces in self.open.values():
                pieces.append(piece)

    def row(self):
        return self.title, self.credit, " ".join(self.text)


class _Cards(HTMLParser):
    """<article> elements that carry a class token, with the articles nested in them.

    A card's id stands after a prefix in an id attribute of some element, whose title is the card's, or else in the image's address; cards without one are
    left out. Of several images or ids the last counts; a card without a title gets the image's text.
    """

    def __init__(self, token: str, prefix: str, in_address: re.Pattern):
        super().__init__(convert_charrefs=True)
        self.token, self.prefix, self.in_address, self.depth, self.now, self.out = token, prefix, in_address, 0, None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "article" and (not self.token or self.token in a.get("class", "").split()):
            self.now, self.depth = {"photo_id": "", "title": "", "alt": "", "thumbnail_url": ""}, 1
            return
        if self.now is None:
            return
        self.depth += tag == "article"
        if a.get("id", "").startswith(self.prefix):
            self.now["photo_id"], self.now["title"] = a["id"][len(self.prefix):], a.get("title") or self.now["title"]
        if tag == "img":
            self.now["alt"], self.now["thumbnail_url"] = a.get("alt", ""), a.get("src", "")

    def handle_endtag(self, tag):
        if tag != "article" or self.now is None:
            return
        self.depth -= 1
        if self.depth <= 0:
            m = self.in_address.search(self.now["thumbnail_url"])
            self.now["photo_id"] = self.now["photo_id"] or (m[1] if m else "")
            self.now["title"] = self.now["title"] or self.now["alt"]
            if self.now["photo_id"]:
                self.out.append(self.now)
            self.now = None


def page_fields(df: DataFrame, html: str = "html", prefix: str = "Photo by") -> DataFrame:
    """Adds title, credit and page_text; script and style text counts as text, as an untyped scan gives it."""

    @F.pandas_udf("struct<title:string,credit:string,page_text:string>")
    def parse(s: pd.Series) -> pd.DataFrame:
        def one(x):
            p = _Page(prefix)
            p.feed(x or "")
            p.close()
            return p.row()
        return pd.DataFrame([one(x) for x in s], columns=["title", "credit", "page_text"])

    return df.withColumn("_f", parse(F.col(html))).select("*", "_f.*").drop("_f")


def page_metadata(df: DataFrame, text: str = "page_text") -> DataFrame:
    """Fields by case-insensitive patterns over page text; '' where absent."""
    t = F.col(text)
    status = F.when(t.rlike(r"(?i)\bpublic domain\b"), "PUBLIC DOMAIN").otherwise("UNVERIFIED")
    # a location ends at the next label or with the text
    place = F.trim(capture(t, r"Location:\s*(.*?)(?:\s+Web Views:|\s+Downloads:|\s+Date Taken:|\s+Date Posted:|$)"))
    return df.withColumns({"date": capture(t, r"Date Taken:\s*([0-9.]+)"), "location": place, "resolution": capture(t, r"Resolution:\s*([0-9]+x[0-9]+)"), "status": status})


def cards(df: DataFrame, html: str = "html", token: str = "", id_prefix: str = "images_", id_pattern: str = r"/photos/\d+/(\d+)/") -> DataFrame:
    """One row per card that has an id."""
    rx = re.compile(id_pattern)

    @F.pandas_udf(f"array<{CARD}>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x):
            p = _Cards(token, id_prefix, rx)
            p.feed(x or "")
            p.close()
            return p.out
        return s.map(one)

    rest = [c for c in df.columns if c != html]
    return df.select(*rest, F.explode(parse(F.col(html))).alias("_c")).select(*rest, "_c.*")
