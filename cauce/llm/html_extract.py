"""Main-text extraction with gradient-boosted trees over DOM nodes.

Every block element (and run of text between blocks) of a page is a node with
features of its subtree (text and link density, paragraphs, controls), its
attribute tokens, its depth and its siblings.  Boosted trees, trained in numpy,
give the probability that a node holds main text; a hierarchical decoding then
picks the most likely set of nodes in which no kept node has a dropped
ancestor.

Training data: generated pages of many layouts whose main blocks are known,
plus a bounded sample of the given pages that mark their main text by a single
``article`` element.

Defined cases: null and empty html give an empty text; a page whose nodes are
all dropped gives an empty text; repeated rows get equal results; columns
named like the added ones are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.common import ship
from cauce.llm.html_dom import Node, decode, features, parse
from cauce.llm.textnum import blocks, parts_of, release, utf8

#: Generated pages, and the most given pages, that the trees are trained on.
GENERATED_PAGES, SAMPLE_PAGES = 800, 400
#: Weight of a node of a given page, against 1 of a generated one.
GIVEN_WEIGHT = 2.0
TREES, DEPTH, RATE, BINS, MIN_LEAF = 60, 5, 0.2, 24, 8
#: Page bytes whose nodes are scored at once.
BATCH_BYTES = 1 << 20


# ------------------------------------------------------------ boosted trees
@dataclass
class Trees:
    """Complete binary trees: per inner node a feature and a threshold (go right if above), per leaf a value."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += leaf[at - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with Newton leaves on binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    usable = [j for j, e in enumerate(edges) if len(e)]
    mean = float((weight * y).sum() / weight.sum())
    base = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (10.0 if mean else -10.0)
    z = np.full(len(y), base)
    inner = 2 ** DEPTH - 1
    features_, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = 2 ** level - 1, 2 ** level
            local = at - first
            gain = np.zeros(count)
            total_g = np.bincount(local, g, count)
            total_h = np.bincount(local, h, count)
            for j in usable:
                key = local * (BINS + 1) + binned[:, j]
                shape = (count, BINS + 1)
                left_g = np.bincount(key, g, count * (BINS + 1)).reshape(shape).cumsum(1)[:, :-1]
                left_h = np.bincount(key, h, count * (BINS + 1)).reshape(shape).cumsum(1)[:, :-1]
                left_n = np.bincount(key, minlength=count * (BINS + 1)).reshape(shape).cumsum(1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                score = (left_g ** 2 / (left_h + 1) + right_g ** 2 / (right_h + 1)
                         - (total_g ** 2 / (total_h + 1))[:, None])
                score[(left_n[:, :-1] < MIN_LEAF) | (left_n[:, -1:] - left_n[:, :-1] < MIN_LEAF)] = 0
                best = score.argmax(1)
                value = score[np.arange(count), best]
                better = (value > gain + 1e-9) & (best < len(edges[j]))
                gain[better] = value[better]
                feature[first + np.flatnonzero(better)] = j
                threshold[first + np.flatnonzero(better)] = edges[j][best[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf_at = at - inner
        leaf = RATE * np.bincount(leaf_at, g, 2 ** DEPTH) / (np.bincount(leaf_at, h, 2 ** DEPTH) + 1)
        z += leaf[leaf_at]
        features_.append(feature)
        thresholds.append(threshold.astype(np.float32))
        leaves.append(leaf)
    return Trees(np.stack(features_), np.stack(thresholds), np.stack(leaves), base)


# ------------------------------------------------------------ training pages
_MARK = ""  # begins every main block of a generated page


def _words(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgké", k=rng.randint(1, 11))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        w = w.capitalize() if i == 0 or out[-1].endswith(".") else w
        out.append(w + (rng.choice([".", ",", ".", "!", "?"]) if rng.random() < 0.14 else ""))
    return " ".join(out)


def _attributes(rng: random.Random, names: list[str], bare: bool) -> str:
    name = rng.choice(names)
    filler = rng.choice(["wrap", "box", "row", "col-md-8", "clearfix", "c12", "block", "inner", "x-1", "section"])
    style = rng.random()
    if bare and style < 0.3:
        return ""
    if style < 0.45:
        return f' id="{name}"'
    return f' class="{name}{" " + filler if rng.random() < 0.3 else ""}"'


def generated_page(rng: random.Random) -> str:
    """A page of a random layout; blocks of its main text begin with _MARK."""
    def element(tags: list[str], names: list[str], inside: str) -> str:
        tag = rng.choice(tags)
        # only elements that name their role go without attributes
        bare = tag in ("nav", "header", "footer", "aside", "form", "article", "main", "li", "ol")
        return f"<{tag}{_attributes(rng, names, bare)}>{inside}</{tag}>"

    def link_list(n: int) -> str:
        items = [f'<a href="/{i}">{_words(rng, rng.randint(1, 5))}</a>' for i in range(n)]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" | ", " ", " &middot; "]).join(items)

    def prose(mark: bool, n: int, short: bool = False) -> str:
        out = []
        for _ in range(n):
            text = (_MARK if mark else "") + _words(rng, rng.randint(1, 12) if short or rng.random() < 0.25 else rng.randint(15, 120))
            if rng.random() < 0.15:
                text = text.replace(" ", f' <a href="/z">{_words(rng, 2)}</a> ', 1)
            form = rng.random()
            if form < 0.12:
                out.append(f"<p><b>{text}<br>")
            elif form < 0.2:
                out.append(f"<p>{text}")
            elif form < 0.27:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<p>{text}</p>")
        return "".join(out)

    def comments() -> str:
        def one() -> str:
            head = f'<div class="{rng.choice(["author", "meta", "user"])}">{_words(rng, 2)} {rng.randint(1, 30)} May</div>'
            return element(["li", "div", "article"], ["comment", "reply", "comment-body", "response"],
                           (head if rng.random() < 0.7 else "") + prose(False, rng.randint(1, 3)))
        title = f"<h3>{rng.choice(['Comments', 'Discussion', '3 replies', _words(rng, 2)])}</h3>"
        return element(["section", "div", "ol", "aside"], ["comments", "comment-list", "disqus_thread", "discussion", "respond"],
                       title * (rng.random() < 0.6) + "".join(one() for _ in range(rng.randint(1, 6))))

    def noise(kind: str) -> str:
        if kind == "nav":
            return element(["nav", "nav", "div", "ul"], ["menu", "nav", "navbar", "main-nav", "navigation", "breadcrumbs"],
                           link_list(rng.randint(2, 10)))
        if kind == "header":
            return element(["header", "div"], ["header", "masthead", "site-header", "topbar"],
                           f"<h1>{_words(rng, 3)}</h1>" * (rng.random() < 0.4) + f"<p>{_words(rng, rng.randint(2, 9))}</p>"
                           + link_list(4) * (rng.random() < 0.5))
        if kind == "footer":
            return element(["footer", "footer", "div"], ["footer", "site-footer", "copyright", "legal"],
                           f"&copy; {_words(rng, 2)} &middot; {_words(rng, rng.randint(2, 20))}" + link_list(3) * (rng.random() < 0.4))
        if kind == "side":
            return element(["aside", "aside", "div"], ["sidebar", "side", "widget", "related", "recommended", "trending"],
                           f"<h3>{_words(rng, 2)}</h3>" * (rng.random() < 0.7)
                           + (link_list(rng.randint(3, 9)) if rng.random() < 0.6 else prose(False, rng.randint(1, 3))))
        if kind == "notice":
            return element(["div", "div", "section", "p"], ["cookie-notice", "notice", "alert", "consent", "gdpr", "banner", "popup"],
                           _words(rng, rng.randint(5, 40)) + " <button>OK</button>" * (rng.random() < 0.5))
        if kind == "ad":
            return f"<!-- ad {rng.randint(0, 99)} -->" + element(
                ["div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement"],
                _words(rng, rng.randint(3, 40)))
        if kind == "form":
            return element(["form", "form", "div"], ["newsletter", "search", "login", "subscribe", "contact-form"],
                           f"<label>{_words(rng, 2)}</label><input type='text'> {_words(rng, rng.randint(1, 15))} <button>Go</button>")
        if kind == "share":
            return element(["div", "ul", "p"], ["share", "social", "tags", "byline", "author-bio", "meta"],
                           link_list(rng.randint(2, 5)) if rng.random() < 0.6 else _words(rng, rng.randint(2, 25)))
        return comments()

    inside = [f"<h{rng.choice([1, 1, 2])}>{_MARK}{_words(rng, rng.randint(1, 12))}</h1>" if rng.random() < 0.8 else ""]
    for _ in range(rng.randint(1, 6)):
        form = rng.random()
        if form < 0.72:
            inside.append(prose(True, rng.randint(1, 4), short=rng.random() < 0.2))
        elif form < 0.8:
            inside.append(f"<h2>{_MARK}{_words(rng, rng.randint(1, 7))}</h2>")
        elif form < 0.87:
            inside.append("<ul>" + "".join(f"<li>{_MARK}{_words(rng, rng.randint(2, 25))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif form < 0.91:
            inside.append(f"<blockquote>{_MARK}{_words(rng, rng.randint(8, 40))}</blockquote>")
        elif form < 0.94:
            inside.append("<table>" + "".join(f"<tr><td>{_MARK}{_words(rng, 2)}</td><td>{_MARK}{_words(rng, 4)}</td></tr>"
                                              for _ in range(2)) + "</table>")
        else:
            inside.append(noise(rng.choice(["ad", "share", "form", "notice", "side"])))
    if rng.random() < 0.12:
        inside.append(comments())
    body = "".join(inside)
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        body = element(["div", "section"], ["wrap", "inner", "entry-content", "text", "body"], body)
    main = element(["article", "article", "article", "main", "div", "div", "section", "td"],
                   ["content", "post", "article", "entry", "story", "main-content", "page", "article-body"], body)
    before = "".join(noise(k) for k in ("header", "nav", "notice", "ad", "form", "side") if rng.random() < 0.4)
    after = "".join(noise(k) for k in ("share", "side", "comments", "ad", "form", "nav", "notice") if rng.random() < 0.3)
    page = before + main + after
    if rng.random() < 0.25:
        page = element(["div"], ["container", "wrapper", "site", "page"], page)
    page += noise("footer") if rng.random() < 0.8 else ""
    return (f"<!DOCTYPE html><html lang='en'><head><title>{_words(rng, 4)}</title><style>p{{margin:0}}</style></head><body>"
            f"<script>var t=\"</p>\";</script>{page}" + "</body></html>" * (rng.random() < 0.8))


def _labels(nodes: list[Node], main: list[bool]) -> np.ndarray:
    """1 for nodes with main text inside, from flags of the leaves."""
    index = {id(x): i for i, x in enumerate(nodes)}
    y = np.array(main, float)
    for i in range(len(nodes) - 1, 0, -1):
        j = index[id(nodes[i].parent)]
        y[j] = max(y[j], y[i])
    return y


def _marked(page: str) -> tuple[np.ndarray, np.ndarray]:
    nodes = parse(page)
    main = [x.text.startswith(_MARK) for x in nodes]
    for x in nodes:
        x.text = x.text.removeprefix(_MARK)
    return features(nodes), _labels(nodes, main)


def _by_article(page: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and labels of a page with one article element around all its main text."""
    nodes = parse(page)
    articles = [x for x in nodes if x.tag == "article"]
    if len(articles) != 1:
        return None
    inside = {id(articles[0])}
    main = []
    for x in nodes:
        if id(x.parent) in inside:
            inside.add(id(x))
        main.append(id(x) in inside and bool(x.text))
    return features(nodes), _labels(nodes, main)


def train(pages: list[str], seed: int = 5, generated: int = GENERATED_PAGES) -> Trees:
    """Trees from generated pages and those of ``pages`` that mark their main text."""
    rng = random.Random(seed)
    data = [(*_marked(generated_page(rng)), 1.0) for _ in range(generated)]
    data += [(*d, GIVEN_WEIGHT) for d in map(_by_article, pages) if d is not None]
    x, y = np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data])
    return fit(x, y, np.concatenate([np.full(len(d[1]), d[2]) for d in data]))


# ----------------------------------------------------------------- extraction
def extract_texts(pages: list[str], trees: Trees) -> list[str]:
    """Main text of each page; the nodes of all pages are scored together."""
    doms = [parse(p) for p in pages]
    rows = [features(d) for d in doms]
    probability = trees.probability(np.concatenate(rows)) if rows else np.zeros(0)
    ends = np.cumsum([0, *map(len, rows)])
    return ["\n".join(decode(d, probability[a:b])) for d, a, b in zip(doms, ends[:-1], ends[1:], strict=True)]


def sample_pages(pages: DataFrame, rows: int = SAMPLE_PAGES) -> list[str]:
    """At most ``rows`` pages, those with the smallest hashes of id and url (the hashes are ranked
    first, so that no task sends pages that are not chosen)."""
    hashed = pages.where("html IS NOT NULL").select("html", F.xxhash64("page_id", "url", F.lit("html")).alias("h"))
    smallest = [r["h"] for r in hashed.select("h").orderBy("h").limit(rows).collect()]
    if not smallest:
        return []
    return sorted(r["html"] for r in hashed.where(F.col("h") <= smallest[-1]).limit(rows).collect())


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) added."""
    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    source, at = pages.select(*keep), keep.index("html")
    schema = T.StructType([*source.schema.fields, T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = utf8(batch.column(at))
            for i, j in blocks(column, BATCH_BYTES):
                texts = extract_texts([b.decode("utf-8", "replace") for b in column[i:j]], trees)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns, pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

        release()
    return source.mapInArrow(run, schema)


def extract_main(pages: DataFrame) -> DataFrame:
    """Train on generated and sampled pages, extract every page."""
    return extract(pages, train(sample_pages(pages)))
