"""Main-text extraction by wrapper induction.

Every page becomes a tree of block elements (:mod:`gristmill.llm.dom`); runs of like siblings are one slot. Pages of one
host with the same slots have one shape. For each host the wrapper is induced from its ``SHAPES`` most frequent shapes
by simple tree matching; slots without a counterpart are added, so optional blocks and further templates of a host stay apart. Every
shape is then aligned with its host's wrapper; slots of rarer shapes that match nothing are known by their labels' path. So every
block of every page has a slot of its host, and all statistics are counted over all pages, not over a sample.

What decides, per host:

- constant nodes: a text that at least ``LEAST_PAGES`` different pages, and ``SHARE`` of those with the slot, repeat in one slot is template
  (``SHARE_MAIN`` of them inside an article or main element, where headings and labels that stand before varying text are kept however often
  they are repeated: they are the article's own);
- varying slots become content where the varying text of the host is: in its article or main elements, else in the
  smallest element that holds ``MASS`` of it with the headings beside it;
- slots whose text is links on all pages are menus;
- elements that say what they are by their tag, role or exact names (menus, page headers, footers, side bars, notices, adverts, forms, comments)
  are no content, unless they hold the article or nearly all text of the host. Varying adverts and reader comments cannot be told otherwise.

Distribution: pages are parsed once and written; statistics are aggregated by (host, shape, slot, text hash) before any join, so a host
with a third of all pages is no hot key. Shapes, wrappers and decisions are small and broadcast only while their counted bytes fit the
bound, else joined. The text is assembled by DataFrame functions.

Null html counts as empty; a page without content gives an empty text. Very deep, very long and malformed pages take time
linear in their length. Equal pages count once in the statistics; repeated rows give a row each, ties between shapes go by
their key. A null url is a host of its own. Only id, url and html are read, so other columns cannot clash. Empty input gives an empty result.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import xxhash

from gristmill.llm import dom
from gristmill.llm.common import BROADCAST_BYTES, table
from gristmill.sources.materialize import materialize, release

SHAPES, SALTS, LEAST_PAGES, SHARE, SHARE_MAIN, MASS, LINKS = 32, 16, 5, 0.1, 0.5, 0.6, 0.9
MAIN = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption summary".split())
SKIP_TAG = frozenset("head nav footer aside form button fieldset dialog menu search".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADER = frozenset("header masthead topbar".split())
#: Parts of names that say what an element is; a name counts if it consists of these and NEUTRAL parts only.
SKIP_PART = frozenset("nav navbar navigation menu menubar footer sidebar aside ad ads adv advert adverts advertisement banner promo promoted sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing breadcrumb breadcrumbs comment comments reply replies respond discussion disqus related recommended login search pagination pager toolbar copyright".split())
NEUTRAL = frozenset("0 list box area section wrap wrapper container block top bottom left right main primary secondary bar inner outer site page global widget widgets form links item items group row col content post posts article entry the".split())
NAME_PART = re.compile(r"[-_]+|(?<=[a-z])(?=0)|(?<=0)(?=[a-z])")


def named(tag: str, words: str) -> str:
    """'skip', 'header' or '': what an element says it is by its tag and its own class, id and role words."""
    if tag in SKIP_TAG:
        return "skip"
    out = "header" if tag == "header" else ""
    for w in words.split():
        if w.startswith("role="):
            if w[5:] in SKIP_ROLE:
                return "skip"
            continue
        parts = [x for x in NAME_PART.split(w) if x]
        if parts and all(x in SKIP_PART or x in HEADER or x in NEUTRAL for x in parts):
            if any(x in SKIP_PART for x in parts):
                return "skip"
            if any(x in HEADER for x in parts):
                out = "header"
    return out


def induce(shapes: list[tuple[list[int], list[str]]]) -> tuple[list[int], list[str]]:
    """The wrapper of some shapes: parents and labels of its slots, siblings in order."""
    parents, labels = [-1], [""]
    kids: list[list[int]] = [[]]
    for p, l in shapes:
        dom.merge(parents, labels, kids, p, l)
    order = [0]
    for k in order:  # grows while it runs
        order += kids[k]
    new = {k: i for i, k in enumerate(order)}
    return [new.get(parents[k], -1) for k in order], [labels[k] for k in order]


def locate(kids: list[list[int]], labels: list[str], shape: tuple[list[int], list[str]]) -> list[int]:
    """Slot of the host for each slot of a shape: its wrapper number, or a negative number made of the labels' path."""
    to = dom.align(kids, labels, dom.children(shape[0]), shape[1])
    for j in range(1, len(shape[1])):
        if j not in to:
            path = f"{to[shape[0][j]]}\0{shape[1][j]}".encode("utf-8", "surrogatepass")
            to[j] = -1 - (xxhash.xxh64_intdigest(path) >> 2)
    return [to[j] for j in range(len(shape[1]))]


def decide(ids: list[int], parents: list[int], labels: list[str], varying: list[int], links: list[int], pages: list[int]) -> dict[int, int]:
    """Role of each slot of a host: 0 none, 1 content of an article, 2 other content, 3 content only where a page has no other,
    4 a heading or label of an article before varying text of it, which no repetition makes template.

    varying, links: characters (in links) of the texts of a slot that are not constant; ids hold 0, the root.
    """
    at = {x: k for k, x in enumerate(ids)}
    kids: list[list[int]] = [[] for _ in ids]
    for k, x in enumerate(ids):
        if x:
            kids[at[parents[k]]].append(k)
    order = [at[0]]
    for k in order:
        order += kids[k]
    split = [x.split("|") for x in labels]
    tag = [x[0] for x in split]
    says = [named(x[0], x[1] if len(x) > 1 else "") for x in split]
    unseen = [x[-1] == "!" and len(x) > 1 for x in split]
    mass, headed = [max(0, v - n) for v, n in zip(varying, links)], [False] * len(ids)
    for k in reversed(order):
        mass[k] += sum(mass[c] for c in kids[k])
        headed[k] = any(headed[c] for c in kids[k]) or tag[k] in ("h1", "h2") and mass[k] > 0
    total = mass[at[0]]

    def walk(shut: list[bool]) -> list[bool]:
        """Whether a slot is, or is inside, an element that is no content."""
        out, inside = [False] * len(ids), [False] * len(ids)
        for k in order:
            out[k] = out[k] or unseen[k] or shut[k] and not (says[k] == "header" and inside[k])
            for c in kids[k]:
                out[c], inside[c] = out[k], inside[k] or tag[k] in MAIN
        return out

    shut = [bool(s) and t not in ("html", "body") for s, t in zip(says, tag)]
    gone = walk(shut)
    open_mass = sum(max(0, varying[k] - links[k]) for k in order if not gone[k])
    mains = [k for k in order if tag[k] in MAIN and not gone[k] and mass[k]]
    if not mains or 4 * sum(mass[k] for k in mains) < open_mass:
        # names above the host's largest article, or around nearly all its text, mean something else
        best = max((k for k in order if tag[k] in MAIN and not shut[k] and not unseen[k]), key=lambda k: mass[k], default=at[0])
        mains, above = [], []
        if ids[best] and 2 * mass[best] >= total > 0:
            mains, k = [best], best
            while ids[k]:
                k = at[parents[k]]
                above.append(k)
        else:
            k = at[0]
            while kids[k] and tag[k] != "#":
                above.append(k)
                k = max(kids[k], key=lambda c: mass[c])
                if 10 * mass[k] <= 9 * total:
                    break
        for k in above:
            shut[k] = False
        gone = walk(shut)
    alive = [0] * len(ids)
    for k in reversed(order):
        alive[k] = 0 if gone[k] else max(0, varying[k] - links[k]) + sum(alive[c] for c in kids[k])
    role = 1
    if not mains and alive[at[0]]:
        role, k = 2, at[0]
        while True:
            big = max(kids[k], key=lambda c: alive[c], default=None)
            if big is None or alive[big] < MASS * alive[k] or not any(labels[c] != "#" for c in kids[big]) or any(headed[c] and not gone[c] for c in kids[k] if c != big):
                break
            k = big
        mains = [k]
    roles, within = [3] * len(ids), [False] * len(ids)
    for k in mains:
        within[k] = True
    for k in order:
        menu = pages[k] >= LEAST_PAGES and ids[k] and tag[at[parents[k]]] in ("li", "ul", "td", "dd", "div") and links[k] >= LINKS * varying[k] > 0
        roles[k] = 0 if gone[k] or menu else role if within[k] else 3
        for c in kids[k]:
            within[c] = within[c] or within[k]
    for k in mains if role == 1 else []:
        # slots of the article in page order, backwards: siblings are numbered from left to right
        todo, page = [k], []
        while todo:
            j = todo.pop()
            page.append(j)
            todo += sorted(kids[j], key=lambda c: ids[c], reverse=True)
        later = False
        for j in reversed(page):
            up = at[parents[j]] if ids[j] else j
            if later and roles[j] == 1 and tag[j] == "#" and tag[up] in HEADING:
                roles[j] = 4
            later = later or roles[j] == 1 and tag[up] not in HEADING and varying[j] > links[j]
    return {x: r for x, r in zip(ids, roles)}


def _inline_skip(words: str) -> bool:
    return named("", words) == "skip"


def _shape(tree: str) -> tuple[list[int], list[str]]:
    return tuple(json.loads(tree))  # type: ignore[return-value]


def _parsed(pages: DataFrame) -> DataFrame:
    """host, shape, slots, texts and links of every page; tree (parents and labels of the slots) once per task and shape."""
    def run(it):
        known: set = set()
        for pdf in it:
            for lo in range(0, len(pdf), 64):
                part, rows = pdf.iloc[lo:lo + 64], []
                for host, page in zip(part["host"], part["html"]):
                    key, parents, labels, slot, texts, links = dom.slots(dom.parse(page, _inline_skip))
                    new = (host, key) not in known
                    if new:
                        if len(known) > 100_000:
                            known.clear()
                        known.add((host, key))
                    rows.append((key, json.dumps([parents, labels]) if new else None, slot, texts, links))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "url": part["url"].to_numpy(), "host": part["host"].to_numpy(), **dict(zip(("shape", "tree", "slots", "texts", "links"), zip(*rows)))})

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInPandas(run, f"id {kind}, url string, host string, shape long, tree string, slots array<int>, texts array<string>, links array<int>")


def _hinted(df: DataFrame, size) -> DataFrame:
    """A broadcast if the bytes counted by ``size`` fit the bound."""
    n = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def wrappers(shapes: DataFrame, most: int = SHAPES) -> DataFrame:
    """(host, wrapper) from rows with host, shape, n (pages) and tree."""
    def learn(pdf):
        pdf = pdf.sort_values(["n", "shape"], ascending=[False, True])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(induce([_shape(t) for t in pdf["tree"]]))]})

    first = lambda df, *keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "shape"))).filter(F.col("_r") <= most).drop("_r")
    top = first(first(shapes.withColumn("_s", F.pmod("shape", F.lit(SALTS))), "host", "_s").drop("_s"), "host")
    return top.groupBy("host").applyInPandas(learn, "host string, wrapper string")


def _located(shapes: DataFrame, known: DataFrame) -> DataFrame:
    """host, shape, n and of each slot its id, its parent's id and its label."""
    def run(it):
        held: dict = {}
        for pdf in it:
            rows = []
            for w, tree in zip(pdf["wrapper"], pdf["tree"]):
                if w not in held:
                    if len(held) > 500:
                        held.clear()
                    parents, labels = json.loads(w)
                    held[w] = dom.children(parents), labels
                shape = _shape(tree)
                ids = locate(*held[w], shape)
                rows.append((ids, [ids[p] if p >= 0 else 0 for p in shape[0]], shape[1]))
            yield pd.DataFrame({"host": pdf["host"], "shape": pdf["shape"], "n": pdf["n"], **dict(zip(("ids", "parents", "labels"), zip(*rows)))})

    j = shapes.join(_hinted(known, F.length("wrapper")), "host")
    return j.mapInPandas(run, "host string, shape long, n long, ids array<long>, parents array<long>, labels array<string>")


def extract_pages(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", shapes: int = SHAPES) -> DataFrame:
    """One row per row of ``df``: id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    pages = materialize(_parsed(df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))), "pages")
    hashed = F.transform("texts", lambda t: F.xxhash64(t))
    # different pages only: equal ones count once
    content = pages.select("host", "shape", F.transform(F.arrays_zip("slots", hashed.alias("h"), F.transform("texts", lambda t: F.length(t)).alias("len"), "links"), lambda x: x).alias("b"))
    content = content.groupBy("host", "shape", F.xxhash64("b.h").alias("page")).agg(F.any_value("b").alias("b"))
    counts = content.select("host", "shape", F.explode_outer(F.array_distinct("b")).alias("x")).groupBy("host", "shape", F.col("x.slots").alias("slot"), F.col("x.h").alias("h")).agg(F.count("*").alias("n"), F.max("x.len").alias("len"), F.max("x.links").alias("link"))
    counts = materialize(counts, "counts")
    sizes = content.groupBy("host", "shape").agg(F.count("*").alias("n"))
    trees = pages.filter("tree IS NOT NULL").groupBy("host", "shape").agg(F.any_value("tree").alias("tree"))
    known_shapes = materialize(trees.join(sizes, ["host", "shape"]), "shapes")
    located = materialize(_located(known_shapes, wrappers(known_shapes, shapes)), "located")
    release(known_shapes)
    # per slot of the host: pages, constants, characters that vary
    where = _hinted(located.select("host", "shape", "ids"), F.size("ids") * 8 + 32)
    each = counts.filter("slot IS NOT NULL").join(where, ["host", "shape"]).groupBy("host", F.get("ids", F.col("slot")).alias("id"), "h").agg(F.sum("n").alias("n"), F.max("len").alias("len"), F.max("link").alias("link"))
    nodes = located.select("host", "n", F.explode(F.arrays_zip("ids", "parents", "labels")).alias("x"), "shape").select("host", "n", "shape", "x.*")
    nodes = nodes.groupBy("host", "shape", F.col("ids").alias("id")).agg(F.any_value("n").alias("n"), F.any_value("parents").alias("parent"), F.any_value("labels").alias("label"))
    nodes = materialize(nodes.groupBy("host", "id").agg(F.sum("n").alias("pages"), F.min("parent").alias("parent"), F.min("label").alias("label")), "nodes")
    each = materialize(each.join(_hinted(nodes.select("host", "id", "pages"), F.lit(40)), ["host", "id"]), "texts")
    often = F.col("n") >= F.greatest(F.lit(LEAST_PAGES), SHARE * F.col("pages"))
    # a text as short as a slot's marker may be constant and still be counted: only varying characters decide
    own = each.filter(~often).groupBy("host", "id").agg(F.sum(F.col("n") * F.col("len")).alias("varying"), F.sum(F.col("n") * F.col("link")).alias("links"))

    def judge(pdf):
        pdf = pdf.fillna({"varying": 0, "links": 0})
        roles = decide(*(pdf[c].tolist() for c in ("id", "parent", "label")), *(pdf[c].astype("int64").tolist() for c in ("varying", "links", "pages")))
        return pd.DataFrame({"host": pdf["host"], "id": pdf["id"], "role": [roles[x] for x in pdf["id"]]})

    roles = materialize(nodes.join(own, ["host", "id"], "left").groupBy("host").applyInPandas(judge, "host string, id long, role int"), "roles")
    fixed = each.filter(often).join(_hinted(roles.filter("role > 0"), F.lit(24)), ["host", "id"]).filter((F.col("role") != 4) & ((F.col("role") != 1) | (F.col("n") >= SHARE_MAIN * F.col("pages"))))
    fixed = materialize(fixed.groupBy("host").agg(F.collect_set(F.xxhash64("id", "h")).alias("fixed")), "fixed")
    flags = located.select("host", "shape", F.posexplode("ids").alias("k", "id")).join(_hinted(roles, F.lit(24)), ["host", "id"])
    flags = flags.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("k", "id", "role"))).alias("slot_of"))
    flags = materialize(flags, "flags")
    j = pages.join(_hinted(flags, F.size("slot_of") * 16 + 32), ["host", "shape"], "left").join(_hinted(fixed, F.size("fixed") * 8 + 32), "host", "left")
    block = F.transform(F.arrays_zip("slots", "texts"), lambda x: F.struct(F.get(F.col("slot_of"), x["slots"]).alias("s"), x["texts"].alias("t")))
    j = j.select("id", "url", "fixed", block.alias("b"))
    role = lambda x: x["s"]["role"]
    some = F.exists("b", lambda x: role(x).isin(1, 2, 4))
    keep = F.filter("b", lambda x: F.when(some, role(x).isin(1, 2, 4)).otherwise(role(x) == 3) & ~F.coalesce(F.array_contains("fixed", F.xxhash64(x["s"]["id"], F.xxhash64(x["t"]))), F.lit(False)))
    out = j.select(F.col("id").alias(id_col), F.col("url").alias(url), F.coalesce(F.array_join(F.transform(keep, lambda x: x["t"]), "\n"), F.lit("")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
