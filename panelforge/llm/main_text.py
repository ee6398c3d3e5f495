"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A tolerant parser builds the tree of block elements; the trees (boosting.py) give each the log-odds of being part of
the article, from its tag, the learned weights of its and its ancestors' attribute tokens, depth, subtree density of text and links, place among its siblings and
what its ancestors are.  Decoding is a dynamic program over the tree: a node kept or dropped, everything below a
dropped node dropped, the sum of log-odds largest; so no kept block hangs below a dropped ancestor.

The classifier is fitted on pages that this module composes itself (``SAMPLE`` pages of a seeded generator, articles
among menus, headers, footers, side bars, notices, adverts, forms and comments in varied markup), as the pages table
has no labels; it never reads the input.

Defined cases: null and empty html give the empty text, as do pages without a block judged to be article.  A tag or
comment left open at the end of the page ends there; text before it stays.  ``br`` is white space.  A quote opens a value
only after ``=``; where none closes it, the tag ends at its next ``>``.  ``</`` before anything but a letter is a comment up
to the next ``>``.  A run of text directly in the body is an implied block, scored and decoded like any other.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees

SCHEMA = "page_id long, url string, text string, n_chars long"
SAMPLE = 1_600
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|=(?!\s*[\"'])|[^=>])*)(>?)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SIGNS = re.compile(r"[a-z]+")
HEAD_END = re.compile(r"</head\b[^>]*>|(?=<(?:body|article|main|div|p|h1|header|nav)\b)", re.I)
#: Fixed values of HTML: elements without an end, elements whose content is no text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style".split())
RAW = frozenset("noscript template textarea title iframe svg canvas audio video".split())
INLINE = frozenset("math mi mn mo ms mtext mrow msup msub mfrac object a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure", "body", "button", "dl")
#: Names that authors of pages give to articles and to what surrounds them; only the training pages are made with them.
GOOD = "article main content post entry body story text page blog news detail".split()
BAD = "nav menu header footer sidebar side aside ad ads advert advertisement banner promo sponsor sponsored cookie consent notice popup modal related share social subscribe newsletter widget breadcrumb breadcrumbs comment comments reply disqus form search login pagination toolbar tags meta".split()
PLAIN = "wrap wrapper row column container inner box grid layout site theme open wide section block item left right top".split()
NAME_BITS = 12


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "items", "depth", "n", "chars", "links", "words", "marks", "blocks")

    def __init__(self, tag: str, tokens: frozenset, parent):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.items: list = []  # text pieces and child nodes in page order
        self.depth = parent.depth + 1 if parent else 0
        self.n = self.chars = self.links = self.words = self.marks = self.blocks = 0


def parse(page: str) -> list[Node]:
    """The block elements in page order; the first is the root.  Text pieces carry whether they are link text."""
    root = Node("body", frozenset(), None)
    nodes, stack, at, size, link = [root], [root], 0, len(page), 0
    bare = None  # the implied block of the present run of text directly in the body
    held: list[int] = []  # places in the stack of open p and of elements that a p does not reach out of

    opened: dict[str, int] = {}  # open elements by tag

    def cut(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]
        while held and held[-1] >= i:
            held.pop()

    def text(a: int, b: int) -> None:
        nonlocal bare
        if b > a:
            raw = page[a:b]
            top = stack[-1]
            if top is root:
                if bare is None:
                    if not raw.strip():
                        return
                    bare = Node("#text", frozenset(), root)
                    root.children.append(bare)
                    root.items.append(bare)
                    nodes.append(bare)
                top = bare
            top.items.append(html.unescape(raw) if "&" in raw else raw)
            if link:
                top.links += len(raw.strip())

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text(at, size)
            break
        m = TOKEN.match(page, begin)
        if m is None:
            if page.startswith("</", begin):  # no letter follows: a comment up to the next ">"
                text(at, begin)
                at = page.find(">", begin) + 1 or size
            else:
                text(at, begin + 1)
                at = begin + 1
            continue
        text(at, begin)
        at = m.end()
        if m[2] is None:
            continue
        signs = m[3]
        if not m[4]:  # a value whose quote is never closed: the tag ends at its next ">"
            at = page.find(">", m.end()) + 1
            if not at:  # cut off inside the tag
                break
            signs = page[m.start(3) : at - 1]
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            if tag in INLINE:
                continue
            if not opened.get(tag):  # nothing to close
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    link = 0
                    break
            continue
        if tag == "head":
            end = HEAD_END.search(page, at)
            at = end.end() if end else at
            continue
        if tag in CODE or tag in RAW:
            if not signs.endswith("/"):
                end = re.compile(f"</{tag}\\b[^>]*>|<{tag}\\b" if tag in RAW else f"</{tag}\\b[^>]*>", re.I).search(page, at)
                if end and end[0][1] == "/":
                    at = end.end()
                elif tag in CODE:  # code up to the end of the page
                    at = size
            continue  # never closed, or opened again first: the tag alone
        if tag == "a":
            link = 1
        if tag in INLINE:
            if tag == "br" and (len(stack) > 1 or bare):
                (stack[-1] if len(stack) > 1 else bare).items.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            stack[-1].items.append(None)  # ends a block of text
            bare = bare if len(stack) > 1 else None
            continue
        if tag in CLOSES_P:
            if held and stack[held[-1]].tag == "p":
                cut(held[-1])
        if tag in IMPLIED:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPE[tag]:
                    break
                if stack[i].tag in IMPLIED[tag]:
                    cut(i)
                    break
        tokens = frozenset()
        if signs:
            tokens = frozenset(t for name, value in ATTRIBUTE.findall(signs) if name.lower() in ("class", "id", "role", "itemprop") for t in SIGNS.findall(value.lower()))
        bare = None
        node = Node(tag, tokens, stack[-1])
        stack[-1].children.append(node)
        stack[-1].items.append(node)
        nodes.append(node)
        if tag in ("p", "td", "th", "li", "button"):
            held.append(len(stack))
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(node)
    return nodes


def slots(name: str) -> set[int]:
    """Slots of an attribute token: itself and its first four letters."""
    return {crc32(part.encode()) & ((1 << NAME_BITS) - 1) for part in (name, name[:4] + "*")}


def name_weights(tokens: list[frozenset], own: np.ndarray) -> np.ndarray:
    """Log-odds of the article for each slot of attribute tokens, from labelled nodes; 0 for slots never met."""
    count = np.zeros((2, 1 << NAME_BITS))
    for names, y in zip(tokens, own.astype(int).tolist()):
        for slot in {x for t in names for x in slots(t)}:
            count[y, slot] += 1
    total = count.sum(axis=1, keepdims=True) + 1
    return np.where(count.sum(axis=0) > 1, np.log((count[1] + 0.5) / total[1]) - np.log((count[0] + 0.5) / total[0]), 0.0)


def measure(nodes: list[Node], names: np.ndarray) -> np.ndarray:
    """A row of features for each node; ``names``: what attribute tokens weigh."""
    for x in reversed(nodes):
        own = "".join(i for i in x.items if isinstance(i, str))
        x.chars += len(own)
        x.words += own.count(" ") + 1 if own.strip() else 0
        x.marks += own.count(".") + own.count(",")
        x.n += 1
        x.blocks += bool(own.strip())
        if x.parent:
            p = x.parent
            p.chars += x.chars
            p.links += x.links
            p.words += x.words
            p.marks += x.marks
            p.n += x.n
            p.blocks += x.blocks
    total = max(1, nodes[0].chars)
    place: dict[int, tuple] = {}
    for x in nodes:
        k = len(x.children)
        tags: dict[str, int] = {}
        for c in x.children:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        for i, c in enumerate(x.children):
            place[id(c)] = ((i + 0.5) / k, tags[c.tag] / k, k)
    above: dict[int, tuple] = {}
    rows = np.zeros((len(nodes), 23 + len(TAGS)))
    for r, x in enumerate(nodes):
        told = [names[k] for t in x.tokens for k in slots(t)]
        good, bad = max(told, default=0.0), min(told, default=0.0)
        up = above.get(id(x.parent), (0, 0.0, 0.0, 0))
        mine = (up[0] or x.tag in ("article", "main"), max(up[1], good), min(up[2], bad), up[3] or x.tag in ("nav", "header", "footer", "aside", "form"))
        above[id(x)] = mine
        spot = place.get(id(x), (0.5, 1.0, 1))
        density = x.links / max(1, x.chars)
        parent = x.parent or x
        rows[r, :23] = (x.depth, log1p(x.chars), log1p(x.words), density, x.marks / max(1, x.words), x.n, x.chars / x.n, x.blocks, x.chars / total, len(x.children), *spot, good, bad, *map(float, mine), parent.links / max(1, parent.chars), log1p(parent.chars), x.chars / max(1, x.words), x.chars / max(1, parent.chars))
        if x.tag in TAGS:
            rows[r, 23 + TAGS.index(x.tag)] = 1
    return rows


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Keep or drop each node, nothing kept below a dropped one, with the largest sum of log-odds of kept nodes."""
    gain = {id(x): float(o) for x, o in zip(nodes, odds)}
    best: dict[int, float] = {}
    for x in reversed(nodes):
        best[id(x)] = max(0.0, (gain[id(x)] if x.parent else 0.0) + sum(best[id(c)] for c in x.children))
    kept: dict[int, bool] = {}
    for x in nodes:
        kept[id(x)] = not x.parent or (kept[id(x.parent)] and best[id(x)] > 0)
    return [kept[id(x)] for x in nodes]


def blocks(nodes: list[Node], kept: dict[int, bool], root_text: bool = False) -> list[str]:
    out: list[str] = []

    def flush(held: list[str]) -> None:
        line = " ".join("".join(held).split())
        if line:
            out.append(line)
        held.clear()

    work: list = [(nodes[0], 0, [])]
    while work:
        node, i, held = work.pop()
        while i < len(node.items):
            item = node.items[i]
            i += 1
            if isinstance(item, str):
                if node.parent or root_text:
                    held.append(item)
            else:
                flush(held)
                if item is not None and kept[id(item)]:
                    work.append((node, i, held))
                    node, i, held = item, 0, []
        flush(held)
    return out


# ---- training pages ------------------------------------------------------------------------------------------


def compose(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the ids of its article's elements, marked by the attribute ``data-own``."""
    number = [0]

    def prose(lo: int, hi: int) -> str:
        n = rng.randint(lo, hi)
        out = []
        for i in range(n):
            w = "".join(rng.choice("aeioubcdfglmnprstvé") for _ in range(rng.randint(1, 9)))
            out.append(w + (rng.choice([".", ",", "."]) if rng.random() < 0.12 else ""))
        return " ".join(out) + rng.choice([".", ""])

    def mark(own: bool) -> str:
        number[0] += 1
        return f' data-own="{int(own)}"'

    def compound(*kinds) -> str:
        """A token, or two in one name, of the kinds given."""
        return rng.choice(["", "", "no-", "has-", "with-"]) + "-".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([1, 1, 2])))

    def named(words) -> str:
        """Names of a node: mostly of its own kind, and at a fair rate of the other, of any, or none."""
        if rng.random() < 0.25:
            return ""
        tokens = [compound(words) if rng.random() < 0.6 else compound(GOOD, BAD, PLAIN) for _ in range(rng.choice([1, 1, 2, 3]))]
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(tokens)}"'

    lorem = lambda lo, hi, own, tag="p": f"<{tag}{mark(own)}>{prose(lo, hi)}</{tag}>"
    links = lambda n, own=False: f"<ul{mark(own)}>" + "".join(f'<li{mark(own)}><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def junk() -> str:
        kind = rng.randint(0, 8)
        if kind == 0:
            return f"<nav{mark(False)}>{links(rng.randint(3, 9))}</nav>"
        if kind == 1:
            return f"<div{mark(False)}{named(BAD)}>{prose(3, 30)}</div>"
        if kind == 2:
            return f"<aside{mark(False)}{named(BAD)}>{lorem(4, 40, False)}{links(3) if rng.random() < 0.5 else ''}</aside>"
        if kind == 3:
            return f"<div{mark(False)}{named(BAD)}>{lorem(5, 40, False)}<button{mark(False)}>ok</button></div>"
        if kind == 4:
            return f"<form{mark(False)} action=\"/s\"><label>{prose(1, 3)}</label><input name=q>{lorem(1, 8, False)}</form>"
        if kind == 5:
            return f"<div{mark(False)}{named(BAD)}>{links(rng.randint(2, 5)) if rng.random() < 0.6 else prose(2, 20)}</div>"
        if kind == 6:
            tag, each = rng.choice(["section", "div"]), rng.choice(["comment", "comment", "reply", "response", "user-note"])
            head = f"<{tag}{mark(False)} {rng.choice(['id', 'class'])}=\"{each}s{rng.choice(['', ' list', ' thread-body'])}\">"
            return head + "".join(f"<div{mark(False)} class=\"{each}\">{lorem(5, 60, False)}</div>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind == 7:
            return f"<div{mark(False)}{named(BAD)}>{links(4)}{lorem(3, 20, False)}</div>"
        return f"<p{mark(False)}{named(BAD) or ' class=meta'}>{prose(2, 12)}</p>"

    def article() -> str:
        parts = [f"<h1{mark(True)}>{prose(2, 12)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            roll = rng.random()
            if roll < 0.68:
                text = prose(1, 120)
                parts.append(f"<p{mark(True)}>" + (f"<b>{text}<br>" if rng.random() < 0.15 else f'{text} <a href="/x">{prose(1, 3)}</a> {prose(1, 9)}</p>' if rng.random() < 0.2 else f"{text}</p>"))
            elif roll < 0.78:
                parts.append(lorem(1, 8, True, rng.choice(["h2", "h3"])))
            elif roll < 0.85:
                parts.append(f"<ul{mark(True)}>" + "".join(f"<li{mark(True)}>{prose(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif roll < 0.91:
                parts.append(f"<blockquote{mark(True)}>{lorem(4, 40, True)}</blockquote>")
            elif roll < 0.94:
                parts.append(f"<table{mark(True)}><tr{mark(True)}><td{mark(True)}>{prose(1, 4)}</td><td{mark(True)}>{prose(1, 4)}</td></tr></table>")
            else:
                parts.append(junk())
        return "".join(parts)

    tag = rng.choice(["article", "article", "main", "div", "section"])
    name = "" if tag in ("article", "main") and rng.random() < 0.5 else named(GOOD)
    body = f"<{tag}{mark(True)}{name}>{article()}</{tag}>" if rng.random() > 0.02 else ""
    if rng.random() < 0.4:
        body = f"<div{mark(True)}{named(GOOD + PLAIN)}>{junk() if rng.random() < 0.3 else ''}{body}{junk() if rng.random() < 0.5 else ''}</div>"
    if rng.random() < 0.2:  # an old page, or one whose article ends too early
        loose = "<hr>".join(f'<!--{mark(True)}-->' + rng.choice(["<br><br>", "<br>", " "]).join(prose(4, 120) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
        body = body + "</div>" * 3 + "<hr>" + loose + "<hr>" if rng.random() < 0.3 else "<hr>" + loose + "<hr>"
    if rng.random() < 0.2:
        loose = " | ".join(f'<a href="/{i}">{prose(1, 3)}</a>' for i in range(rng.randint(2, 7))) if rng.random() < 0.6 else f"&copy; {prose(1, 6)}"
        body = f"<hr><!--{mark(False)}-->{loose}<hr>{body}" if rng.random() < 0.5 else f"{body}<hr><!--{mark(False)}-->{loose}<hr>"
    head = f"<header{mark(False)}>{lorem(1, 5, False, 'p')}<nav{mark(False)}>{links(4)}</nav></header>" if rng.random() < 0.4 else f"<nav{mark(False)}>{links(rng.randint(3, 8))}</nav>" if rng.random() < 0.8 else ""
    before = "".join(junk() for _ in range(rng.randint(0, 2)))
    after = "".join(junk() for _ in range(rng.randint(0, 3)))
    foot = f"<footer{mark(False)}>{rng.choice(['&copy; ', ''])}{prose(2, 25)}{links(3) if rng.random() < 0.3 else ''}</footer>" if rng.random() < 0.8 else f"<div{mark(False)} class=\"footer\">{prose(2, 25)}</div>"
    inside = f"{head}{before}{body}{after}{foot}"
    while "<hr>" not in inside and rng.random() < 0.25:  # around the whole page, unless text stands in its body
        tag = rng.choice(["div", "form", "form", "main", "section"])
        inside = f"<{tag}{mark(True)}{named(GOOD + PLAIN)}>{inside}</{tag}>"
    return f"<html><head><title>t</title></head><body>{inside}</body></html>", set()


class Model:
    """Attribute tokens' weights and the trees."""

    def __init__(self, names: np.ndarray, trees: Trees):
        self.names, self.trees = names, trees

    def odds(self, pages: list[list[Node]]) -> np.ndarray:
        rows = [measure(nodes, self.names) for nodes in pages if nodes]
        return self.trees.score(np.concatenate(rows)) if rows else np.zeros(0)


@lru_cache(maxsize=1)
def fitted(sample: int = SAMPLE, seed: int = 5) -> Model:
    """The classifier of this module; the same for every run.  Names are weighed on one half of the pages, trees are fitted on the other with names so weighed."""
    rng = random.Random(seed)
    pages, own = [], []
    for _ in range(sample):
        page, _ = compose(rng)
        own.append(np.array([int(x) for x in re.findall(r'data-own="(\d)"', page)], float))
        pages.append(parse(page))
    half = sample // 2
    names = name_weights([x.tokens for nodes in pages[:half] for x in nodes[1:]], np.concatenate(own[:half]))
    rows = [measure(nodes, names)[1:] for nodes in pages[half:]]
    return Model(names, Trees().fit(np.concatenate(rows), np.concatenate(own[half:])))


def extract_all(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page; nodes of all pages are scored together."""
    parsed = [parse(p) if p else [] for p in pages]
    parsed = [nodes if len(nodes) > 1 else [] for nodes in parsed]
    odds, out, at = model.odds(parsed), [], 0
    for nodes in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(blocks(nodes, {id(x): k for x, k in zip(nodes, kept)})) if nodes else "")
    return out


def extract(page: str | None, model: Model) -> str:
    return extract_all([page], model)[0]


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    held = pages.sparkSession.sparkContext.broadcast(fitted())

    def run(batches):
        for batch in batches:
            texts = [t for i in range(0, len(batch), 64) for t in extract_all(batch.column(2)[i : i + 64].to_pylist(), held.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)
