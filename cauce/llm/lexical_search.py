"""Ranked lexical search of an item table against all documents by dual trees.

A document's score for an item sums, over the item's terms with repeats, the term's
weight times its saturated frequency in the document, all in whole numbers (see
:func:`term_weights` and :func:`saturated`).  So items and documents are vectors of
numbers that are never negative, and a score is their product.

* Hierarchies.  Items: leaves of ``ITEM_LEAF`` items with like heaviest terms, groups
  of ``ITEM_GROUP``, the root.  Documents: every task orders its documents by their
  bound against the item root and builds leaves of ``DOC_LEAF``, nodes of ``DOC_NODE``
  and batches of ``DOC_BATCH`` over that order.  A node holds the coordinate maxima
  of its members, so the product of two nodes' maxima bounds every score below them.
* Pruning.  A pair of nodes is dropped if its bound is below the weakest kth score
  among the items of its item node (a bound equal to it is followed, since ties go to
  the smaller doc_id).  Pairs of leaves that are left are scored exactly.  As batches
  come in the order of falling bounds, the first one that the root cannot use ends
  the others.
* Starting scores.  Any k documents' scores bound an item's kth score from below, so
  a first search over the documents of one hash value in ``SEEDS`` gives all tasks their
  first thresholds.  They change no result: the search itself covers every document.
* Texts are read once: a task stores, for each document, its number of terms and the
  terms that items have, with their frequencies; document frequencies, the search for
  first thresholds and the search read that table.  Tasks return at most k documents
  an item, and their best k are taken by rank.
* Items go to the tasks in blocks of at most about ``BLOCK_BYTES`` bytes of text (an
  item's own text at least), whatever the size of the item table.

Defined cases: null texts have no terms; an item without terms that documents hold has
no rows; each row of ``items`` is an item of its own, so rows that repeat an item_id
have a ranking each; rows that repeat a document are documents of their own and tie, as
do equal texts; a null doc_id comes last among ties; empty tables give an empty result.
Only ``item_id``, ``doc_id`` and ``text`` are read; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cauce.llm.common import materialise, ship
from cauce.llm.textnum import Block, blocks, mix64, parts_of, release, utf8

TOP = 20
#: Terms: runs of ASCII letters and digits and of all characters beyond ASCII; A-Z is lowered.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Sizes of the nodes of both hierarchies.
ITEM_LEAF, ITEM_GROUP = 8, 64
DOC_LEAF, DOC_NODE, DOC_BATCH, DOC_SORT = 8, 64, 512, 4096
#: Bytes of item text that tasks hold at a time; hash values of documents, one of which gives the first thresholds.
BLOCK_BYTES, SEEDS = 1 << 20, 32
_LATE = np.iinfo(np.int64).max  # a null doc_id among ties

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ----------------------------------------------------------------- vocabulary
def _edges(block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last eight bytes of every span as numbers; a span of up to 16 bytes is known by them and its length."""
    padded = np.concatenate([block.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    size = end - start
    bits = (np.minimum(size, 8) * 8).astype(np.uint64)
    mask = np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
    return eight[start] & mask, eight[np.maximum(end - 8, 0)] * (size > 8)


class Vocabulary:
    """The distinct terms of a block of items, and exact look-up of spans of bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.index = {t: i for i, t in enumerate(terms)}
        block = Block(terms)
        key, self.first, self.last = self._keys(block, block.lo, block.hi)
        self.size = block.hi - block.lo
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.twins = set(self.key[1:][self.key[1:] == self.key[:-1]].tolist())

    @staticmethod
    def _keys(block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two = _edges(block, start, end)
        return mix64(mix64(one) * np.uint64(3) + two + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), one, two

    def find(self, block: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Term number of every span, -1 where it is no term."""
        if not len(self.key) or not len(start):
            return np.full(len(start), -1)
        key, one, two = self._keys(block, start, end)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        term = self.order[at]
        same = (self.key[at] == key) & (self.size[term] == end - start) & (self.first[term] == one) & (self.last[term] == two)
        term = np.where(same, term, -1)
        doubtful = np.flatnonzero(same & (end - start > 16))  # their middles are compared too
        if self.twins:
            doubtful = np.union1d(doubtful, np.flatnonzero(np.isin(key, np.array(list(self.twins), np.uint64))))
        for i in doubtful:
            term[i] = self.index.get(block.data[start[i]:end[i]].tobytes(), -1)
        return term


def term_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every term, and the first term index of each document (n + 1 values)."""
    inside = _IS_TERM[block.data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    return start, end, np.append(np.searchsorted(start, block.lo), len(start))


# --------------------------------------------------------------------- scores
def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L of documents of n terms."""
    if not len(n) or not n_terms:
        return np.zeros(len(n), np.int64)
    if 25 * int(n.max()) * n_docs < 1 << 63:
        return 75 + 25 * n * np.int64(n_docs) // np.int64(n_terms)
    return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m)."""
    return np.int64(1_000_000_000) * tf // (1000 * tf + 12 * m)


# ------------------------------------------------------------------ item tree
@dataclass
class ItemTree:
    """Items as sparse rows in the order of the tree, and the maxima of its nodes."""

    number: np.ndarray                     # item of each row
    group_cols: list[np.ndarray]           # terms of each group, ascending
    group_rows: list[np.ndarray]           # its items over those terms
    group_leaves: list[np.ndarray]         # maxima of its leaves over those terms
    root: np.ndarray                       # maxima over all items, by term
    kind: type = np.float64                # float64 where all sums are exact in it, else int64
    kth: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def build(cls, counts: list[tuple[int, dict[int, int]]], weight: np.ndarray, kth: dict[int, int]) -> ItemTree:
        """counts: (item, {term: repeats}); items without a weighted term are left out."""
        rows = []
        for number, terms in counts:
            value = {t: q * int(weight[t]) for t, q in terms.items() if weight[t] > 0}
            if value:
                rows.append((max(value, key=lambda t: (value[t], t)), number, value))
        rows.sort(key=lambda r: r[:2])
        most = max((sum(v.values()) for _, _, v in rows), default=0)
        kind = np.float64 if most * 1_000_000 < 1 << 53 else np.int64
        root = np.zeros(len(weight), kind)
        tree = cls(np.array([r[1] for r in rows], np.int64), [], [], [], root, kind)
        for at in range(0, len(rows), ITEM_GROUP):
            group = [r[2] for r in rows[at:at + ITEM_GROUP]]
            cols = np.array(sorted(set().union(*group)), np.int64)
            dense = np.zeros((len(group), len(cols)), kind)
            for i, value in enumerate(group):
                dense[i, np.searchsorted(cols, list(value))] = list(value.values())
            tree.group_cols.append(cols)
            tree.group_rows.append(dense)
            tree.group_leaves.append(np.maximum.reduceat(dense, np.arange(0, len(group), ITEM_LEAF), axis=0))
            root[cols] = np.maximum(root[cols], dense.max(axis=0))
        tree.kth = np.array([kth.get(int(n), 0) for n in tree.number], np.int64)
        return tree


class Best:
    """The k best documents of every item so far: by score, then doc_id."""

    def __init__(self, kth: np.ndarray, k: int):
        self.k, self.least = k, kth.copy()  # least: a score that a new document must reach
        self.score = [np.zeros(0, np.int64) for _ in kth]
        self.doc = [np.zeros(0, np.int64) for _ in kth]

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        use = (score >= max(1, self.least[item]))
        if len(self.score[item]) == self.k:
            use &= (score > self.score[item][-1]) | (doc < self.doc[item][-1])
        if not use.any():
            return
        score, doc = np.append(self.score[item], score[use]), np.append(self.doc[item], doc[use])
        order = np.lexsort((doc, -score))[:self.k]
        self.score[item], self.doc[item] = score[order], doc[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], score[order[-1]])


# ----------------------------------------------------------------- the search
def _node_maxima(node: np.ndarray, term: np.ndarray, u: np.ndarray, n_nodes: int, width: int, kind: type) -> np.ndarray:
    """Maxima of u by (node, term) as a dense matrix."""
    out = np.zeros(n_nodes * width, kind)
    key = node * width + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    out[key[first]] = np.maximum.reduceat(u[order], first) if len(first) else 0
    return out.reshape(n_nodes, width)


def _visit(tree: ItemTree, best: Best, doc: np.ndarray, start: np.ndarray, term: np.ndarray, u: np.ndarray) -> None:
    """Descend both trees over one batch of documents (rows ``start[i]:start[i+1]`` of term and u)."""
    size = np.diff(start)
    row = np.repeat(np.arange(len(doc)), size)
    n_nodes = -(-len(doc) // DOC_NODE)
    maxima = _node_maxima(row // DOC_NODE, term, u, n_nodes, len(tree.root), tree.kind)
    place = np.full(len(tree.root), -1)
    for g, cols in enumerate(tree.group_cols):
        first = g * ITEM_GROUP
        mine = slice(first, first + len(tree.group_rows[g]))
        bound = maxima[:, cols] @ tree.group_leaves[g].max(axis=0)
        nodes = np.flatnonzero((bound >= best.least[mine].min()) & (bound > 0))
        if not len(nodes):
            continue
        in_node = np.zeros(n_nodes, bool)
        in_node[nodes] = True
        docs = np.flatnonzero(in_node[np.arange(len(doc)) // DOC_NODE])
        place[cols] = np.arange(len(cols))
        use = in_node[row // DOC_NODE] & (place[term] >= 0)
        dense = np.zeros((len(docs), len(cols)), tree.kind)
        dense[np.searchsorted(docs, row[use]), place[term[use]]] = u[use]
        place[cols] = -1
        leaves = np.maximum.reduceat(dense, np.arange(0, len(docs), DOC_LEAF), axis=0)
        bounds = tree.group_leaves[g] @ leaves.T
        for leaf in range(len(bounds)):
            items = np.arange(first + leaf * ITEM_LEAF, min(first + (leaf + 1) * ITEM_LEAF, mine.stop))
            alive = (bounds[leaf] >= best.least[items].min()) & (bounds[leaf] > 0)
            if not alive.any():
                continue
            rows = np.flatnonzero(np.repeat(alive, DOC_LEAF)[:len(docs)])
            scores = (tree.group_rows[g][items - first] @ dense[rows].T).astype(np.int64)
            for i, item in enumerate(items):
                best.add(item, scores[i], doc[docs[rows]])


def search_batch(tree: ItemTree, best: Best, doc: np.ndarray, n: np.ndarray, start: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 n_docs: int, n_terms: int) -> None:
    """Search documents given as sparse rows: the item root first, then batch by batch in the order of falling bounds."""
    size = np.diff(start)
    u = saturated(tf, np.repeat(length_norm(n, n_docs, n_terms), size)).astype(tree.kind)
    bound = np.zeros(len(doc), tree.kind)
    some = np.flatnonzero(size)
    if len(some):
        bound[some] = np.add.reduceat(u * tree.root[term], start[some])
    order = np.argsort(-bound, kind="stable")
    for at in range(0, len(order), DOC_BATCH):
        chosen = order[at:at + DOC_BATCH]
        if bound[chosen[0]] <= 0 or bound[chosen[0]] < best.least.min():
            break  # so are all that follow
        chosen = chosen[bound[chosen] > 0]
        ends = np.cumsum(size[chosen])
        take = np.repeat(start[chosen] - (ends - size[chosen]), size[chosen]) + np.arange(ends[-1])
        _visit(tree, best, doc[chosen], np.append(0, ends), term[take], u[take])


# --------------------------------------------------------------------- stages
def _vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: number of terms, and frequencies of the vocabulary's."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch)):
            texts = utf8(part.column(1))
            for i, j in blocks(texts):
                block = Block(texts[i:j], lower=True)
                start, end, first = term_spans(block)
                n = np.diff(first)
                found = vocabulary.find(block, start, end)
                held = found >= 0
                key, tf = np.unique(np.repeat(np.arange(j - i), n)[held] * len(vocabulary.terms) + found[held], return_counts=True)
                width = max(1, len(vocabulary.terms))
                ends = pa.array(np.searchsorted(key // width, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(ends, pa.array((key % width).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))
        release()

    return source.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _frequencies(vectors: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1] += int(np.asarray(batch.column(0)).sum())
            total[2:] += np.bincount(np.asarray(batch.column(1).flatten()), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    out = [0] * (n_terms + 2)
    for r in vectors.select("n", "terms").mapInArrow(run, "at bigint, v bigint").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]  # a block's vocabulary at most
    return out[0], out[1], np.array(out[2:], np.int64)


def _search(vectors: DataFrame, tree: ItemTree, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, rank): the best k of every item of the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(tree.kth, k)
        for part in (p for batch in batches for p in parts_of(batch, DOC_SORT)):
            doc = part.column(0).fill_null(_LATE).to_numpy(zero_copy_only=False)
            size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
            search_batch(tree, best, doc, part.column(1).to_numpy(), np.append(0, np.cumsum(size)).astype(np.int64),
                         part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.int64),
                         n_docs, n_terms)
        items = np.repeat(tree.number, [len(s) for s in best.score])
        score = np.concatenate(best.score) if len(best.score) else np.zeros(0, np.int64)
        doc = np.concatenate(best.doc) if len(best.doc) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(doc, mask=doc == _LATE), pa.array(score)],
                                         names=["item", "doc_id", "score"])
        release()

    found = vectors.where("size(terms) > 0").mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    counted = [(number, Counter(TERM.findall(text.lower()))) for number, text in items]
    vocabulary = Vocabulary(sorted(set().union(*(c for _, c in counted))))
    counts = [(number, {vocabulary.index[t]: q for t, q in c.items()}) for number, c in counted]
    vectors = materialise(_vectors(docs, vocabulary), "term-vectors")
    n_docs, n_terms, df = _frequencies(vectors, len(vocabulary.terms))
    weight = term_weights(df, n_docs)
    weight[df == 0] = 0  # no document to score
    seeds = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEEDS)) == 0)
    first = _search(seeds, ItemTree.build(counts, weight, {}), n_docs, n_terms, k)
    kth = {r["item"]: r["score"] for r in first.where(F.col("rank") == k).select("item", "score").collect()}  # one row an item of the block
    return _search(vectors, ItemTree.build(counts, weight, kth), n_docs, n_terms, k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of every item: item_id, rank (int, from 1), doc_id, score; only scores above 0, ties by doc_id."""
    spark = docs.sparkSession
    ship(spark)
    numbered = materialise(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.coalesce("text", F.lit("")).alias("text")),
                           "items")
    total = numbered.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // BLOCK_BYTES))
    found = None
    for b in range(n_blocks):
        block = numbered.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).select("item", F.col("text").cast("binary").alias("text"))
        ranked = _search_block(docs, [(r["item"], bytes(r["text"])) for r in block.collect()], k)
        found = ranked if found is None else found.unionByName(ranked)
    return (found.join(numbered.select("item", "item_id"), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
