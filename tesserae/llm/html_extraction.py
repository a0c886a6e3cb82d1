"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. Each block's features are its word count
and link density, those of its neighbours, and what its ancestors say of it; a
decision tree, grown on the labelled table below, keeps or drops it.

Counts cannot tell a reader's comment from a paragraph, so names have a say: a class
or id that names comments, adverts, menus and the like drops a block. Such a name
does not count where it says the opposite (``no-comments``, ``has-sidebar``), nor on an
element that is an article or named as content; an article inside a wrapper keeps at
most a vote of the wrapper's name, which length and neighbours outweigh.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title iframe object svg math canvas audio video textarea select option head".split())
RAW = frozenset("script style title textarea iframe noscript template svg math".split())
APART = frozenset("nav footer aside form menu dialog button fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of class and id names that mark what is not the article.
APART_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar
    footer copyright legal disclaimer masthead topbar comment comments commentlist reply replies disqus share sharing
    pagination pager tagcloud outbrain taboola hidden""".split()
)
#: Parts that may as well name what an article is about, or what a page is: a vote, no more.
VOTE_NAMES = frozenset("search social related recommended recommendations widget widgets respond toolbar skip".split())
COMMENT_NAMES = frozenset("comment comments commentlist reply replies".split())
CONTENT_NAMES = frozenset("article content main story entry post articlebody maincontent".split())
#: First parts of names that say what else the page has or lacks.
ASIDES = frozenset("has have no not with without show hide".split())

FEATURES = ("apart", "named", "content", "header", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")
#: Labelled blocks: the features in order (named: 1 for a vote, 2 for a name that decides), then 1 for a block of the article.
LABELLED = (
    # paragraphs, headings, lists, quotations and tables of an article
    (0, 0, 1, 0, 0, 42, 0.0, 38, 0.0, 51, 0.0, 1), (0, 0, 1, 0, 0, 3, 0.0, 60, 0.0, 44, 0.0, 1), (0, 0, 1, 0, 0, 1, 0.0, 20, 0.0, 9, 0.0, 1),
    (0, 0, 1, 0, 1, 7, 0.0, 2, 1.0, 33, 0.0, 1), (0, 0, 1, 0, 1, 3, 0.0, 90, 0.0, 70, 0.0, 1), (0, 0, 1, 0, 1, 1, 0.0, 12, 0.0, 5, 0.0, 1),
    (0, 0, 1, 0, 0, 25, 0.2, 40, 0.0, 31, 0.1, 1), (0, 0, 1, 0, 0, 6, 1.0, 35, 0.0, 28, 0.0, 1), (0, 0, 1, 0, 0, 1, 1.0, 15, 0.0, 17, 0.1, 1),
    (0, 0, 1, 0, 0, 110, 0.02, 80, 0.0, 0, 0.0, 1), (0, 0, 1, 0, 0, 12, 0.0, 9, 0.0, 6, 0.0, 1), (0, 0, 1, 0, 0, 8, 0.5, 14, 0.5, 11, 0.4, 1),
    (0, 0, 1, 0, 1, 11, 1.0, 1, 1.0, 55, 0.0, 1), (0, 0, 1, 1, 1, 9, 0.0, 2, 1.0, 6, 0.2, 1), (0, 0, 1, 1, 1, 4, 0.0, 0, 0.0, 40, 0.0, 1),
    (0, 0, 1, 1, 1, 14, 0.0, 10, 0.0, 70, 0.0, 1), (0, 0, 1, 0, 0, 300, 0.0, 250, 0.0, 12, 0.0, 1), (0, 0, 1, 0, 0, 17, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 1, 0, 1, 3, 0.0, 1, 1.0, 3, 0.0, 1), (0, 0, 1, 0, 1, 2, 0.0, 6, 1.0, 9, 0.0, 1), (0, 0, 1, 0, 0, 4, 0.0, 1, 1.0, 2, 0.0, 1),
    # text of pages that name no article
    (0, 0, 0, 0, 0, 55, 0.0, 61, 0.0, 47, 0.0, 1), (0, 0, 0, 0, 0, 30, 0.1, 25, 0.0, 40, 0.05, 1), (0, 0, 0, 0, 0, 18, 0.0, 45, 0.0, 52, 0.0, 1),
    (0, 0, 0, 0, 0, 6, 0.0, 48, 0.0, 39, 0.0, 1), (0, 0, 0, 0, 0, 3, 0.0, 30, 0.0, 25, 0.0, 1), (0, 0, 0, 0, 1, 5, 0.0, 2, 1.0, 64, 0.0, 1),
    (0, 0, 0, 0, 1, 8, 0.0, 41, 0.0, 36, 0.0, 1), (0, 0, 0, 0, 1, 2, 0.0, 22, 0.0, 19, 0.0, 1), (0, 0, 0, 0, 0, 90, 0.1, 3, 1.0, 2, 1.0, 1),
    (0, 0, 0, 0, 0, 12, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 0, 26, 0.0, 0, 0.0, 3, 1.0, 1), (0, 0, 0, 0, 0, 16, 0.0, 2, 1.0, 35, 0.0, 1),
    (0, 0, 0, 0, 1, 6, 0.0, 1, 1.0, 14, 0.0, 1), (0, 0, 0, 0, 0, 4, 0.0, 6, 0.0, 20, 0.0, 1), (0, 0, 0, 0, 0, 9, 0.0, 31, 0.0, 4, 0.0, 1),
    (0, 0, 0, 0, 0, 6, 0.0, 120, 0.0, 80, 0.0, 1), (0, 0, 0, 0, 0, 3, 0.0, 64, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 1, 4, 0.0, 210, 0.0, 5, 0.0, 1),
    # menus, link lists and bylines of pages that name no article
    (0, 0, 0, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 0, 0, 0, 0, 2, 1.0, 1, 1.0, 3, 1.0, 0), (0, 0, 0, 0, 0, 4, 1.0, 2, 1.0, 60, 0.0, 0),
    (0, 0, 0, 0, 0, 6, 0.8, 5, 1.0, 4, 0.9, 0), (0, 0, 0, 0, 0, 12, 0.9, 10, 1.0, 14, 0.9, 0), (0, 0, 0, 0, 0, 25, 0.95, 3, 1.0, 2, 1.0, 0),
    (0, 0, 0, 0, 1, 3, 1.0, 2, 1.0, 6, 1.0, 0), (0, 0, 0, 0, 0, 3, 1.0, 30, 0.0, 4, 1.0, 0), (0, 0, 0, 0, 0, 7, 0.7, 50, 0.0, 2, 1.0, 0),
    (0, 0, 0, 0, 0, 9, 1.0, 8, 0.6, 0, 0.0, 0), (0, 0, 0, 0, 0, 5, 0.6, 40, 0.1, 33, 0.0, 0), (0, 0, 0, 0, 0, 1, 1.0, 42, 0.0, 37, 0.0, 0),
    # heads of pages, bylines within an article's header
    (0, 0, 0, 1, 0, 3, 0.0, 0, 0.0, 1, 1.0, 0), (0, 0, 0, 1, 1, 2, 1.0, 0, 0.0, 1, 1.0, 0), (0, 0, 0, 1, 0, 12, 0.0, 2, 1.0, 40, 0.0, 0),
    (0, 0, 0, 1, 1, 5, 0.0, 0, 0.0, 9, 0.0, 0), (0, 0, 0, 1, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 0, 1, 1, 0, 5, 0.2, 8, 0.0, 40, 0.0, 0),
    (0, 0, 1, 1, 0, 3, 0.0, 11, 0.0, 3, 0.5, 0), (0, 0, 1, 1, 0, 16, 0.0, 9, 0.0, 52, 0.0, 0), (0, 0, 0, 1, 0, 33, 0.0, 0, 0.0, 50, 0.0, 0),
    # navigation, footers, asides and forms, by element or role
    (1, 0, 0, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 0, 0, 0, 0, 12, 0.0, 40, 0.0, 0, 0.0, 0), (1, 0, 0, 0, 0, 60, 0.0, 50, 0.0, 45, 0.0, 0),
    (1, 0, 1, 0, 0, 30, 0.0, 44, 0.0, 52, 0.0, 0), (1, 0, 1, 0, 1, 3, 0.0, 40, 0.0, 6, 1.0, 0), (1, 0, 0, 0, 1, 2, 0.0, 80, 0.0, 3, 1.0, 0),
    (1, 0, 1, 0, 0, 5, 1.0, 4, 1.0, 6, 1.0, 0), (1, 0, 0, 1, 0, 2, 1.0, 1, 1.0, 2, 1.0, 0), (1, 0, 0, 0, 0, 8, 0.1, 55, 0.0, 0, 0.0, 0),
    (1, 1, 0, 0, 0, 20, 0.1, 30, 0.0, 25, 0.0, 0), (1, 1, 1, 0, 0, 44, 0.0, 61, 0.0, 31, 0.0, 0), (1, 0, 1, 1, 1, 6, 0.0, 3, 0.0, 30, 0.0, 0),
    # adverts, notices, shares, related links and comments, by name
    (0, 2, 0, 0, 0, 9, 0.0, 1, 1.0, 7, 0.0, 0), (0, 2, 0, 0, 0, 14, 0.0, 1, 1.0, 60, 0.0, 0), (0, 2, 0, 0, 0, 50, 0.0, 48, 0.0, 39, 0.0, 0),
    (0, 2, 1, 0, 0, 33, 0.0, 44, 0.0, 52, 0.0, 0), (0, 2, 1, 0, 0, 6, 0.0, 40, 0.0, 45, 0.0, 0), (0, 2, 1, 0, 1, 2, 0.0, 70, 0.0, 20, 0.0, 0),
    (0, 2, 0, 0, 1, 4, 0.0, 30, 0.0, 6, 1.0, 0), (0, 2, 0, 0, 0, 3, 1.0, 2, 1.0, 3, 1.0, 0), (0, 2, 1, 0, 0, 110, 0.0, 90, 0.0, 80, 0.0, 0),
    (0, 2, 0, 1, 0, 7, 0.0, 0, 0.0, 4, 1.0, 0), (0, 2, 1, 1, 1, 5, 0.0, 10, 0.0, 30, 0.0, 0), (0, 2, 1, 0, 0, 1, 1.0, 30, 0.0, 1, 1.0, 0),
    # blocks whose ancestors' names are no more than a vote: text stays, short and linked ones go
    (0, 1, 0, 0, 0, 48, 0.0, 0, 0.0, 0, 0.0, 1), (0, 1, 1, 0, 0, 48, 0.0, 0, 0.0, 0, 0.0, 1), (0, 1, 1, 0, 0, 40, 0.05, 38, 0.0, 51, 0.0, 1),
    (0, 1, 0, 0, 0, 60, 0.1, 45, 0.0, 30, 0.0, 1), (0, 1, 1, 0, 1, 5, 0.0, 0, 0.0, 48, 0.0, 1), (0, 1, 1, 0, 1, 3, 0.0, 60, 0.0, 40, 0.0, 1),
    (0, 1, 0, 0, 0, 25, 0.0, 40, 0.0, 30, 0.0, 1), (0, 1, 1, 0, 0, 9, 0.0, 40, 0.0, 55, 0.0, 1), (0, 1, 1, 0, 0, 7, 0.0, 48, 0.0, 36, 0.0, 1),
    (0, 1, 0, 0, 0, 9, 0.0, 1, 1.0, 7, 0.0, 0), (0, 1, 0, 0, 0, 4, 0.5, 30, 0.0, 3, 1.0, 0), (0, 1, 1, 0, 0, 6, 0.0, 44, 0.0, 2, 1.0, 0),
    (0, 1, 0, 0, 0, 12, 0.0, 35, 0.0, 3, 1.0, 0), (0, 1, 0, 0, 0, 14, 0.9, 3, 1.0, 9, 1.0, 0), (0, 1, 0, 0, 1, 2, 0.0, 35, 0.0, 6, 1.0, 0),
    (0, 1, 0, 0, 1, 4, 0.0, 35, 0.0, 5, 0.0, 0), (0, 1, 1, 0, 0, 1, 1.0, 30, 0.0, 1, 1.0, 0), (0, 1, 1, 0, 0, 20, 0.8, 45, 0.0, 9, 0.9, 0),
    (0, 1, 0, 0, 1, 2, 0.0, 1, 1.0, 48, 0.0, 1), (0, 1, 0, 0, 1, 6, 0.0, 3, 1.0, 60, 0.0, 1), (0, 1, 1, 0, 1, 2, 0.0, 1, 1.0, 48, 0.0, 1),
    (0, 1, 1, 0, 0, 1, 1.0, 2, 0.0, 0, 0.0, 0), (0, 1, 1, 0, 0, 3, 1.0, 12, 0.0, 0, 0.0, 0), (0, 1, 1, 0, 0, 2, 0.0, 40, 0.0, 1, 1.0, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 10):
    """A decision tree by Gini impurity: (feature, threshold, low branch, high branch) or a share of ones."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < t
            cost = sum(m.sum() * labels[m].mean() * (1 - labels[m].mean()) for m in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return share
    _, f, t, low = best
    return f, t, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


#: Neighbours (words, link density) that any block may have.
NEIGHBOURS = ((0, 0.0), (2, 1.0), (30, 0.0), (45, 0.8))


def trained_tree(table=LABELLED):
    def settled(r) -> bool:
        """By the block and its ancestors: neighbours decide on short text that nothing names the article, and under a vote."""
        return bool(r[0] or r[1] > 1 or r[3] or r[2] and not r[1] or r[-1] and r[5] >= 16 and r[6] < 0.3)

    rows = [(*r[:7], *a, *b, r[-1]) if settled(r) else r for r in table for a in NEIGHBOURS for b in NEIGHBOURS]
    data = np.array(rows, float)
    return grow(data[:, :-1], data[:, -1])


def kept_by(tree, row) -> bool:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] < t else high
    return tree >= 0.5


def _names(value: str) -> tuple[int, bool, bool, bool]:
    """Of a class or id attribute: 2 for a name that marks what is apart or 1 for a vote, whether it names comments, content, a header."""
    named, comments, content, header = 0, False, False, False
    for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = PART.findall(token)
        if not parts or parts[0] in ASIDES:
            continue
        apart = bool(APART_NAMES.intersection(parts))
        named = max(named, 2 if apart else int(bool(VOTE_NAMES.intersection(parts))))
        comments |= parts[0] in COMMENT_NAMES
        content |= not apart and bool(CONTENT_NAMES.intersection(parts))
        header |= "header" in parts
    return named, comments, content, header


def _flags(tag: str, attributes: str, above: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """What an element and those ``above`` it say: apart, named, content, header."""
    if tag in ("html", "body"):
        return above
    apart, named, content, header, hidden = int(tag in APART), 0, tag in ("article", "main"), int(tag == "header"), False
    comments = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role":
            apart |= value.lower() in ROLES
            content |= value.lower() in ("main", "article")
        elif name == "itemprop":
            content |= value.lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "id"):
            n, k, x, h = _names(value)
            named, comments, content, header = max(named, n), comments or k, content or x, header | h
    if hidden or comments:
        named, content = 2, False
    elif content:
        named = 0
        if tag in ("article", "main"):  # what is around an article names the page, or is a list of articles
            above = (above[0], min(above[1], 1) if above[1] == 2 else 0, *above[2:])
    return max(above[0], int(apart)), max(above[1], named), max(above[2], int(content)), max(above[3], header)


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Flat text blocks in page order with their own features: flags, heading, words, link density."""
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, tuple[int, int, int, int]]] = []
    open_: Counter[str] = Counter()  # a tag that is not open is not looked for
    texts: list[str] = []
    linked: list[str] = []
    links = silent = 0
    flags, heading = (0, 0, 0, 0), 0

    def close() -> None:
        text = " ".join("".join(texts).split())
        if text:
            n = len(text.split())
            out.append((text, [*flags, heading, n, min(1.0, len(" ".join(linked).split()) / n)]))
        texts.clear()
        linked.clear()

    def pop(to: int) -> None:
        nonlocal links, silent
        for tag, _ in stack[to:]:
            open_[tag] -= 1
            links -= tag == "a"
            silent -= tag in SILENT
        del stack[to:]

    def say(text: str) -> None:
        if text and not silent:
            text = html.unescape(text)
            texts.append(text)
            if links:
                linked.append(text)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            texts.append(" ")
            continue
        if tag not in INLINE:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
        elif tag in RAW:
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = done.end() if done else end
        elif tag not in VOID:
            if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                ends = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,) if tag in ("li", "tr", "option") else ("p",)
                stop = ("ul", "ol", "dl", "table", "tr") if ends != ("p",) else ("button", "td", "th", "table", "object")
                for i in range(len(stack) - 1, -1, -1) if any(open_[e] for e in ends) else ():
                    if stack[i][0] in ends:
                        pop(i)
                        break
                    if stack[i][0] in stop and stack[i][0] != tag:
                        break
            if tag == "body":  # whatever the head left open
                pop(0)
            above = stack[-1][1] if stack else (0, 0, 0, 0)
            stack.append((tag, _flags(tag, m[3], above)))
            open_[tag] += 1
            links += tag == "a"
            silent += tag in SILENT
        if tag not in INLINE:
            flags = stack[-1][1] if stack else (0, 0, 0, 0)
            heading = int(any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, _ in stack[-4:]))
    close()
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    out = []
    for i, (text, own) in enumerate(found):
        before = found[i - 1][1][5:] if i else [0, 0.0]
        after = found[i + 1][1][5:] if i + 1 < len(found) else [0, 0.0]
        if kept_by(tree, [*own, *before, *after]):
            out.append(text)
    return "\n".join(out)


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(p or "", tree) for p in batch.column("html").to_pylist()]
            kept = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*kept, "text", "n_chars"]
            )

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """Main text of every page: the other columns of ``pages`` but text and n_chars, then text and n_chars.

    One row per row of ``pages``, repeated ones too; null and empty pages give an empty
    text, an empty table an empty result. Columns may have any names and types. Nothing
    is shuffled.
    """
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), "html")
    schema = StructType([*(f for f in rows.schema if f.name != "html"), StructField("text", StringType()), StructField("n_chars", LongType())])
    out = rows.mapInArrow(_extract(trained_tree()), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
