"""Trees of block elements from raw HTML, their slots, and simple tree matching. All of it is iterative: no page is too deep.

The tokenizer follows the way browsers read markup (quotes only after ``=``, raw text elements, comments, tags cut off by the
end of the page are dropped) and reads each character a bounded number of times, however malformed the page.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import xxhash

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+)[\s/]*+>""")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
NAME = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(\s*+=\s*+)?")
ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?""")
BARE = re.compile(r"[^\s>]*+")
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
HIDDEN = frozenset("template svg math select object canvas audio video datalist".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol optgroup p pre search section summary table caption tbody td tfoot th thead tr ul button".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"caption"}, "tbody": {"tr", "td", "th", "thead", "tbody", "caption"}, "tfoot": {"tr", "td", "th", "tbody"}}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
DIGITS = re.compile(r"[0-9]+")
#: Trees whose sizes multiply to more are aligned by label order instead of the best matching.
MOST_PAIRS = 4_000_000


class Page:
    """Nodes in page order: parent, tag, label (tag, names and role; digits as 0; '#' for text), text and its characters in links."""

    def __init__(self):
        self.parent, self.tag, self.label, self.text, self.link = [-1], [""], [""], [None], [0]

    def add(self, parent: int, tag: str, label: str, text: str | None = None, link: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.label.append(label)
        self.text.append(text)
        self.link.append(link)
        return len(self.tag) - 1


def _slow_tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and the position after the tag; -1 if the page ends in it."""
    out: dict[str, str] = {}
    while True:
        m = NAME.match(page, at)
        if m is None:
            end = page.find(">", at)
            return out, end + 1 if end >= 0 else -1
        at, value = m.end(), ""
        if m[2]:
            q = page[at:at + 1]
            if q in ('"', "'") and q:
                end = page.find(q, at + 1)
                if end < 0:
                    return out, -1
                value, at = page[at + 1:end], end + 1
            else:
                end = BARE.match(page, at).end()
                value, at = page[at:end], end
        out.setdefault(m[1].lower(), value)


def parse(page: str | None, inline_skip=lambda words: False) -> Page:
    """The tree of block elements; text runs are leaves of their own, inline markup only delimits nothing.

    ``inline_skip`` says by its class and id words whether an inline element is no content.
    """
    page, out = page or "", Page()
    stack, open_, size = [0], Counter(), len(page)
    text: list[str] = []
    linked = total = at = 0
    hidden: list[str] = []
    in_link = False

    def flush():
        nonlocal linked, total
        if text:
            t = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if t:
                if out.tag[stack[-1]] == "head":
                    pop("head")
                out.add(stack[-1], "#", "#", t, round(len(t) * linked / total) if total else 0)
        linked = total = 0

    def pop(tag):
        while True:
            gone = out.tag[stack.pop()]
            open_[gone] -= 1
            if gone == tag:
                break

    while at < size:
        lt = page.find("<", at)
        if lt != at:
            piece = page[at:lt] if lt >= 0 else page[at:]
            if not hidden:
                text.append(piece)
                n = len(piece.strip())
                total += n
                linked += n if in_link else 0
            if lt < 0:
                break
        m = TAG.match(page, lt)
        if m is None:
            o = OPEN.match(page, lt)
            if o is None:
                nxt = page[lt + 1:lt + 2]
                if nxt in ("!", "?", "/") and nxt:
                    if page.startswith("<!--", lt):
                        end = page.find("-->", lt + 2)
                        at = size if end < 0 else end + 3
                    else:
                        end = page.find(">", lt + 2)
                        at = size if end < 0 else end + 1
                else:
                    if not hidden:
                        text.append("<")
                    at = lt + 1
                continue
            a, at = _slow_tag(page, o.end())
            if at < 0:
                break
            m = o
        else:
            at = m.end()
            a = {k.lower(): v.strip("\"'") for k, v in reversed(ATTR.findall(m[3]))} if m[3] and not m[1] else {}
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                if open_[tag] > 0:
                    flush()
                    pop(tag)
                    hidden.clear()
                    in_link = False
            elif tag == "a":
                in_link = False
                if hidden and hidden[-1] == tag:
                    hidden.pop()
            elif hidden and hidden[-1] == tag:
                hidden.pop()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            if end is None:
                at = size
            else:
                gt = page.find(">", end.end())
                at = size if gt < 0 else gt + 1
            continue
        if tag == "br":
            if not hidden:
                text.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        words = DIGITS.sub("0", " ".join(x for x in (a.get("class", ""), a.get("id", ""), f"role={a['role']}" if a.get("role") else "") if x).lower())
        unseen = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()
        if tag not in BLOCK and tag != "hr":
            if tag == "a":
                in_link = True
            if hidden or unseen or tag in HIDDEN or words and inline_skip(words):
                hidden.append(tag)
            continue
        flush()
        hidden.clear()
        if open_["p"] > 0 and out.tag[stack[-1]] == "p":
            pop("p")
        if open_["head"] > 0:
            pop("head")
        if tag == "hr":
            continue
        shut = CLOSES.get(tag)
        while shut and out.tag[stack[-1]] in shut:
            pop(out.tag[stack[-1]])
        label = f"{tag}|{words}" if words else tag
        stack.append(out.add(stack[-1], tag, f"{label}|!" if unseen else label))
        open_[tag] += 1
    flush()
    return out


def slots(page: Page) -> tuple[int, list[int], list[str], list[int], list[str], list[int]]:
    """Runs of like siblings as slots: shape key, parents and labels of the slots, and slot, text and link characters of each block.

    Elements without text below them are left out. Equal keys have equal slots.
    """
    n = len(page.tag)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):  # children come after their parents
        if page.text[i] is not None or kids[i]:
            kids[page.parent[i]].append(i)
    sig: list[int] = [0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i] is None and kids[i]:
            kids[i].reverse()
            own = [sig[k] for k in kids[i]]
            own = [x for j, x in enumerate(own) if not j or own[j - 1] != x]
            sig[i] = xxhash.xxh64_intdigest(f"{page.label[i]}\0{own}".encode("utf-8", "surrogatepass"))
    parents, labels, slot = [-1], [""], [0] * n
    todo = [(0, [0])]
    for at, members in todo:  # grows while it runs
        runs: list[list[int]] = []
        for m in members:
            k, last = -1, None
            for c in kids[m]:
                if sig[c] != last:
                    k, last = k + 1, sig[c]
                    if k == len(runs):
                        runs.append([])
                runs[k].append(c)
        for r in runs:
            s = len(labels)
            parents.append(at)
            labels.append(page.label[r[0]])
            for c in r:
                slot[c] = s
            if page.text[r[0]] is None:
                todo.append((s, r))
    blocks = [i for i in range(n) if page.text[i] is not None]
    key = sig[0] - (1 << 64) if sig[0] >= 1 << 63 else sig[0]
    return key, parents, labels, [slot[i] for i in blocks], [page.text[i] for i in blocks], [page.link[i] for i in blocks]


def children(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if i:
            out[p].append(i)
    return out


def _best(ka: list[int], kb: list[int], weight: dict) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest order-preserving matching of two child lists."""
    score = [[0] * (len(kb) + 1)]
    for i in ka:
        up, row = score[-1], [0]
        for y, j in enumerate(kb):
            w = weight.get((i, j), 0)
            row.append(max(up[y + 1], row[-1], up[y] + w if w else 0))
        score.append(row)
    pairs, x, y = [], len(ka), len(kb)
    while x and y:
        w = weight.get((ka[x - 1], kb[y - 1]), 0)
        if w and score[x][y] == score[x - 1][y - 1] + w:
            x, y = x - 1, y - 1
            pairs.append((ka[x], kb[y]))
        elif score[x][y] == score[x - 1][y]:
            x -= 1
        else:
            y -= 1
    return score[-1][-1], pairs[::-1]


def align(a_kids: list[list[int]], a_labels: list[str], b_kids: list[list[int]], b_labels: list[str], most_pairs: int = MOST_PAIRS) -> dict[int, int]:
    """Simple tree matching: nodes of b to nodes of a, roots matched, labels equal, order and parents kept, as many as possible."""
    out, greedy = {0: 0}, len(a_labels) * len(b_labels) > most_pairs
    weight: dict[tuple[int, int], int] = {}
    if not greedy:
        order = [(0, 0)]
        for x, y in order:  # grows while it runs
            order += [(i, j) for i in a_kids[x] for j in b_kids[y] if a_labels[i] == b_labels[j]]
        for x, y in reversed(order):
            weight[x, y] = 1 + (_best(a_kids[x], b_kids[y], weight)[0] if a_kids[x] and b_kids[y] else 0)
    todo = [(0, 0)]
    for x, y in todo:
        if greedy:
            where, at, pairs = defaultdict(list), -1, []
            for k, i in enumerate(a_kids[x]):
                where[a_labels[i]].append(k)
            for j in b_kids[y]:
                have = where.get(b_labels[j], [])
                k = bisect_left(have, at + 1)
                if k < len(have):
                    at = have[k]
                    pairs.append((a_kids[x][at], j))
        else:
            pairs = _best(a_kids[x], b_kids[y], weight)[1]
        for i, j in pairs:
            out[j] = i
            todo.append((i, j))
    return out


def merge(parents: list[int], labels: list[str], kids: list[list[int]], b_parents: list[int], b_labels: list[str]) -> None:
    """Adds a shape to a wrapper in place: matched slots stay, others become new ones beside the one before them."""
    b_kids = children(b_parents)
    to = align(kids, labels, b_kids, b_labels)
    for j in range(1, len(b_labels)):
        if j not in to:
            p = to[b_parents[j]]
            to[j] = len(labels)
            parents.append(p)
            labels.append(b_labels[j])
            kids.append([])
            own, beside = kids[p], b_kids[b_parents[j]]
            k = beside.index(j) if len(beside) < 1000 else 0
            before = to[beside[k - 1]] if k else -1
            own.insert(own.index(before) + 1 if before in own else len(own) if not k and len(beside) >= 1000 else 0, to[j])
