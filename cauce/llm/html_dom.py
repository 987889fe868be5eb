"""A tolerant DOM of block elements for text extraction, and features of its nodes.

Inline elements are not nodes: their text belongs to the block around them
(link text is counted).  Unclosed and misnested tags are taken as browsers
do for the common cases (a new ``p`` or ``li`` ends the open one, an end tag closes
up to its element or is ignored).  Text in controls, drawings and fallbacks
(``HIDDEN``) is not text of the page, if they have an end tag of their own;
where it is missing the start tag is ignored and what follows is kept.

A ``>`` in a quoted attribute value does not end its tag.  From a tag on whose
quotes leave no ``>`` in the rest of the page, every tag ends at its first ``>``.
Time is linear in the length of the page, whatever its tags are.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

# FIXED VALUES: names of HTML elements by role.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q
    rp rt ruby s samp small span strike strong sub sup time tt u var wbr object math annotation annotation-xml maction
    menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt
    mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("noscript iframe template svg select button".split())
CLOSES = {"li": ("ul", "ol", "menu"), "p": None, "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table"), "option": ("select",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
ENDS_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hr li main menu nav ol p pre section table ul""".split())
CONTROLS = frozenset("input button select textarea".split())

# FIXED VALUES: words in class, id and role attributes that hint at boilerplate or content.
BOILERPLATE_WORDS = frozenset("""ad ads advert advertisement adverts alert author banner bio breadcrumb breadcrumbs byline
    comment comments consent contact cookie cookies copyright cta dialog discussion disclaimer disqus dropdown feedback
    foot footer form gdpr head header legal links login masthead menu meta modal nav navbar navigation newsletter notice
    notification overlay pager pagination popup print promo promotion recommended related reply replies respond reviews
    rss search share sharing sidebar side signup site skip social sponsor sponsored subscribe tag tags toolbar topbar
    trending warning widget widgets""".split())
CONTENT_WORDS = frozenset("article articlebody body content entry hentry main maincontent page post story text".split())

KINDS = ["#text", "p", "heading", "item", "list", "box", "cell", "table", "content", "aside", "nav", "page", "other"]
_KIND = {"p": 1, "pre": 1, "blockquote": 1, "li": 3, "dt": 3, "dd": 3, "ul": 4, "ol": 4, "dl": 4, "menu": 4, "div": 5,
         "section": 5, "center": 5, "td": 6, "th": 6, "table": 7, "tr": 7, "tbody": 7, "thead": 7, "article": 8, "main": 8,
         "aside": 9, "footer": 9, "header": 9, "form": 9, "fieldset": 9, "dialog": 9, "nav": 10, "html": 11, "body": 11,
         **{f"h{i}": 2 for i in range(1, 7)}}
ATTR_BUCKETS = 24

_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
# possessive throughout: a tag is read once and never again
_TOKEN = re.compile(rf"""{_OTHER}|{_NAME}((?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""", re.S)
_PLAIN_TOKEN = re.compile(rf"{_OTHER}|{_NAME}([^>]*+)>", re.S)
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
_HIDDEN_START = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN))})", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_OPENING = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Node:
    """A block element or a run of text among block children."""

    __slots__ = ("tag", "parent", "children", "depth", "tokens", "parts", "link", "links", "controls", "text")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...] = ()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.depth = 0 if parent is None else parent.depth + 1
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.link = self.links = self.controls = 0
        self.text = ""
        if parent is not None:
            parent.children.append(self)


def _tokens(attributes: str) -> tuple[str, ...]:
    found = []
    for _, value in _ATTR.findall(attributes):
        found += [w.lower() for w in _WORD.findall(value)]
    return tuple(found)


class _Tags:
    """Tags, comments and declarations of a page, by their position."""

    def __init__(self, page: str):
        self.page, self.token = page, _TOKEN

    def at(self, start: int) -> re.Match[str] | None:
        found = self.token.match(self.page, start)
        if found is None and self.token is _TOKEN and _PLAIN_TOKEN.match(self.page, start):
            self.token = _PLAIN_TOKEN  # its quotes hide every ">" up to the end of the page
            found = self.token.match(self.page, start)
        return found


class _Open:
    """The stack of open elements, with the places of each tag in it."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """Place of the innermost open element with one of ``tags``; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


def _hidden_ends(page: str) -> dict[int, int]:
    """Of each ``HIDDEN`` element with an end tag of its own: end of its start tag -> end of its end tag.

    An end tag closes the last open element of its name and all that were opened in it.
    """
    ends: dict[int, int] = {}
    if not _HIDDEN_START.search(page):
        return ends
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    tags = _Tags(page)
    pos, last = 0, page.rfind(">")
    while 0 <= (start := page.find("<", pos)) <= last:
        m = tags.at(start)
        if m is None:
            pos = start + 1
            continue
        pos = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            while count.get(name):
                top, at = stack.pop()
                count[top] -= 1
                if top == name:
                    if name in HIDDEN:
                        ends[at] = pos
                    break
        elif name in RAW:
            end = _RAW_END[name].search(page, pos)
            if end is None:
                break
            pos = end.end()
        elif name not in VOID and name not in INLINE and not (name == "svg" and m.group(3).endswith("/")):
            stack.append((name, pos))
            count[name] = count.get(name, 0) + 1
    return ends


def parse(page: str) -> list[Node]:
    """All nodes in document order; the first is the root.  Text sits in leaves only."""
    root = Node("#root", None)
    open_ = _Open(root)
    stack = open_.stack
    run: Node | None = None
    in_link = False
    head_end = True
    pos, size = 0, len(page)
    hidden_ends = _hidden_ends(page)
    tags = _Tags(page)

    def text_node() -> Node:
        nonlocal run
        if run is None:
            run = Node("#text", stack[-1])
        return run

    def close_to(place: int) -> None:
        nonlocal run, in_link
        open_.close_to(place)
        run, in_link = None, False

    last = page.rfind(">")
    while pos < size:
        start = page.find("<", pos)
        if start < 0:
            start = size
        elif start > last:  # no tag can end: a tag or comment cut off, or plain text
            size = next((i for i in range(start, size) if page[i] == "<" and _OPENING.match(page, i)), size)
            start = size
        if start > pos:
            piece = page[pos:start]
            if run is not None or not piece.isspace():
                node = text_node()
                node.parts.append(piece)
                if in_link:
                    node.link += len(piece.strip())
        if start == size:
            break
        m = tags.at(start)
        if m is None:  # a lone "<"
            text_node().parts.append("<")
            pos = start + 1
            continue
        pos = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in INLINE:
                in_link = in_link and name != "a"
            else:
                place = open_.last((name,))
                if place:
                    close_to(place)
                else:
                    run = None
            continue
        if name in RAW:  # its content is not text of the page
            end = _RAW_END[name].search(page, pos)
            if name in CONTROLS:
                stack[-1].controls += 1
            pos = end.end() if end else size
            continue
        if name in HIDDEN:
            if name in CONTROLS:
                stack[-1].controls += 1
            pos = hidden_ends.get(pos, pos)
            continue
        if name in VOID:
            if name == "br":
                if run is not None:
                    run.parts.append(" ")
            elif name == "hr":
                run = None
            elif name in CONTROLS:
                stack[-1].controls += 1
            continue
        if name in INLINE:
            if name == "a":
                in_link = True
                text_node().links += 1
            continue
        if name in ("html", "body") and open_.last((name,)):
            continue
        if name in ENDS_P and stack[-1].tag == "p":
            close_to(len(stack) - 1)
        limit = CLOSES.get(name)
        if limit:
            place = open_.last(SAME.get(name, (name,)))
            if place and place >= open_.last(limit):
                close_to(place)
        attributes = m.group(3)
        run, in_link = None, False
        node = Node(name, stack[-1], _tokens(attributes) if attributes else ())
        if name == "head":  # nothing in it is text of the page
            head_end = head_end and _HEAD_END.search(page, pos)
            if head_end:
                pos = head_end.end() if head_end.group().startswith("</") else head_end.start()
            node.parent.children.pop()
        else:
            open_.push(node)

    nodes: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.children) == 1 and node.children[0].tag == "#text":  # a block of text is one node
            leaf = node.children.pop()
            node.parts, node.link, node.links = leaf.parts, leaf.link, leaf.links
        if node.parts:
            node.text = " ".join(html.unescape("".join(node.parts)).split())
        nodes.append(node)
        todo.extend(reversed(node.children))
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features per node (see FEATURE_NAMES)."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([index[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    length = np.array([len(x.text) for x in nodes], float)
    words = np.array([x.text.count(" ") + 1 if x.text else 0 for x in nodes], float)
    marks = np.array([len(_PUNCTUATION.findall(x.text)) for x in nodes], float)
    link = np.array([min(x.link, len(x.text)) for x in nodes], float)
    links = np.array([x.links for x in nodes], float)
    controls = np.array([x.controls for x in nodes], float)
    kind = np.array([0 if x.tag == "#text" else _KIND.get(x.tag, 12) for x in nodes])
    paragraphs = (kind == 1).astype(float)
    depth = np.array([x.depth for x in nodes], float)
    children = np.array([len(x.children) for x in nodes], float)
    bad = np.array([sum(t in BOILERPLATE_WORDS for t in x.tokens) for x in nodes], float)
    good = np.array([sum(t in CONTENT_WORDS for t in x.tokens) for x in nodes], float)
    size = np.ones(n)
    before = np.cumsum(length) - length
    own = length.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        for a in (length, words, marks, link, links, controls, paragraphs, size):
            a[p] += a[i]
    above_bad, above_good, above_aside = np.zeros(n), np.zeros(n), np.zeros(n)
    rank, siblings, same, sibling_text = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n)
    left, right = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        if i:
            p = parent[i]
            above_bad[i] = above_bad[p] + bad[p]
            above_good[i] = above_good[p] + good[p]
            above_aside[i] = above_aside[p] + (kind[p] in (9, 10))
        if node.children:
            at = [index[id(c)] for c in node.children]
            text = length[at]
            total = text.sum()
            tags = kind[at]
            counts = np.bincount(tags, minlength=len(KINDS))
            rank[at] = np.arange(len(at)) / len(at)
            siblings[at] = len(at)
            same[at] = counts[tags]
            sibling_text[at] = (total - text) / max(1, len(at) - 1)
            left[at[1:]] = text[:-1]
            right[at[:-1]] = text[1:]
    whole = max(1.0, length[0])
    parent_kind = np.where(parent >= 0, kind[np.maximum(parent, 0)], 12)
    dense = np.stack([
        depth, np.log1p(children), np.log1p(size), np.log1p(length), np.log1p(own), np.log1p(words), length / whole,
        before / whole, link / np.maximum(1, length), np.log1p(links), marks / np.maximum(1, words), length / size,
        np.log1p(controls), np.log1p(paragraphs), words / size, rank, np.log1p(siblings), np.log1p(same),
        np.log1p(sibling_text), np.log1p(left), np.log1p(right), bad, good, above_bad, above_good, above_aside,
        length / np.maximum(1, words)], 1)
    kinds = np.zeros((n, len(KINDS)))
    kinds[np.arange(n), kind] = 1
    parents = np.zeros((n, len(KINDS)))
    parents[np.arange(n), parent_kind] = 1
    attributes = np.zeros((n, ATTR_BUCKETS))
    for i, node in enumerate(nodes):
        for t in node.tokens:
            attributes[i, zlib.crc32(t.encode()) % ATTR_BUCKETS] = 1
    return np.concatenate([dense, kinds, parents, attributes], 1).astype(np.float32)


FEATURE_NAMES = (["depth", "children", "subtree nodes", "subtree text", "own text", "words", "share of text", "position",
                  "link density", "links", "punctuation", "text density", "controls", "paragraphs", "words per node", "rank",
                  "siblings", "siblings alike", "text of siblings", "text before", "text after", "boilerplate words",
                  "content words", "boilerplate words above", "content words above", "aside above", "word length"]
                 + [f"kind {k}" for k in KINDS] + [f"parent {k}" for k in KINDS]
                 + [f"attribute bucket {i}" for i in range(ATTR_BUCKETS)])


def decode(nodes: list[Node], probability: np.ndarray) -> list[str]:
    """Texts of the kept leaves, in page order.

    Keeps a set of nodes that contains the parent of each of its members, so a dropped ancestor never
    has a kept descendant, and has the largest likelihood among such sets: bottom-up, a subtree is
    either dropped whole or its top is kept and each child's subtree decided for the best.
    """
    p = np.clip(probability.astype(float), 1e-6, 1 - 1e-6)
    index = {id(x): i for i, x in enumerate(nodes)}
    drop, keep = np.log1p(-p), np.log(p)
    for i in range(len(nodes) - 1, 0, -1):
        j = index[id(nodes[i].parent)]
        keep[j] += max(keep[i], drop[i])
        drop[j] += drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    out = []
    for i, node in enumerate(nodes):
        if i:
            kept[i] = kept[index[id(node.parent)]] and keep[i] > drop[i]
        if kept[i] and node.text:
            out.append(node.text)
    return out
