import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cauce.llm import lexical_search as L
from cauce.llm.textnum import Block

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    """[(item position, rank, doc_id, score)] by the formula, over plain dictionaries."""
    bags = [(i, Counter(PATTERN.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    total = sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for at, text in enumerate(items):
        scored = []
        for i, c in bags:
            m = 75 + 25 * sum(c.values()) * len(bags) // total
            s = sum(q * math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in Counter(PATTERN.findall((text or "").translate(LOWER))).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(at, r, None if void else i, -s) for r, (s, void, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Éa", "a-b", "X1", "日本", "long" * 9, "long" * 8 + "lone", "x" * 16, "x" * 17]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += [(n, None), (None, "w1 w2 w50"), (n + 1, ""), (n + 2, " .,;\n")] + [(n + 10 + i, "w90 w91 W92") for i in range(40)]
    items = [" ".join(rng.choices(words, k=rng.choice([1, 4, 30]))) for _ in range(30)] + ["w90 w91 w91", "", None, "absent", "w1 w2 w50 w1"]
    return docs, items


@pytest.mark.parametrize("sizes", [(8, 64, 8, 64, 512, 4096), (2, 4, 2, 4, 16, 64), (1, 1, 1, 1, 1, 3)])
def test_search_equals_scoring_all(spark, monkeypatch, sizes):
    names = ["ITEM_LEAF", "ITEM_GROUP", "DOC_LEAF", "DOC_NODE", "DOC_BATCH", "DOC_SORT"]
    docs, items = corpus(400, 3)
    tree_docs = [(i, t) for i, t in docs]
    for name, value in zip(names, sizes, strict=True):
        monkeypatch.setattr(L, name, value)
    # the trees themselves, without Spark: closures in workers would not see the patched sizes
    counted = [(at, Counter(L.TERM.findall((t or "").lower().encode()))) for at, t in enumerate(items)]
    counted = [(at, Counter(L.TERM.findall((t or "").translate(LOWER).encode()))) for at, t in enumerate(items)]
    vocabulary = L.Vocabulary(sorted(set().union(*(c for _, c in counted))))
    block = Block([(t or "").encode() for _, t in tree_docs], lower=True)
    start, end, first = L.term_spans(block)
    n, found = np.diff(first), vocabulary.find(block, start, end)
    bags = [Counter(found[a:b][found[a:b] >= 0].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    live = [i for i in range(len(docs)) if n[i]]
    df = np.zeros(len(vocabulary.terms), np.int64)
    for b in bags:
        df[list(b)] += 1
    weight = L.term_weights(df, len(live))
    weight[df == 0] = 0
    tree = L.ItemTree.build([(at, {vocabulary.index[t]: q for t, q in c.items()}) for at, c in counted], weight, {})
    best = L.Best(tree.kth, 20)
    doc = np.array([L._LATE if docs[i][0] is None else docs[i][0] for i in live])
    sizes_of = [len(bags[i]) for i in live]
    for lo in range(0, len(live), L.DOC_SORT):
        part = slice(lo, lo + L.DOC_SORT)
        L.search_batch(tree, best, doc[part], n[live][part], np.append(0, np.cumsum(sizes_of[part])),
                       np.array([t for i in live[part] for t in bags[i]], np.int64), np.array([q for i in live[part] for q in bags[i].values()], np.int64),
                       len(live), int(n.sum()))
    got = sorted((int(tree.number[i]), r, None if d == L._LATE else int(d), int(s))
                 for i in range(len(tree.number)) for r, (s, d) in enumerate(zip(best.score[i], best.doc[i], strict=True), 1))
    assert got == sorted(brute(docs, items, 20))


@pytest.mark.parametrize("parts", [1, 7])
def test_operator_equals_brute_force(spark, parts):
    docs, items = corpus(300, 5)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, score string").repartition(parts)
    q = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, rank int")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in L.search(d, q).collect())
    assert got == sorted(brute(docs, items, 20))


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = corpus(120, 8)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    monkeypatch.setattr(L, "BLOCK_BYTES", 900)
    got = sorted(map(tuple, L.search(d, q, 5).collect()), key=lambda r: r[:2])
    assert [(a, r, i, s) for a, r, i, s in got] == sorted(brute(docs, items, 5), key=lambda r: r[:2])


def test_empty_tables_repeated_items_and_hostile_terms(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "Alpha")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "beta"), (7, "beta"), (None, "alpha")], "item_id bigint, text string")
    assert L.search(none, q).count() == 0
    assert L.search(d, q.limit(0)).count() == 0
    rows = L.search(d, q).collect()
    assert sorted((r["rank"], r.doc_id) for r in rows if r.item_id == 7) == [(1, 1), (1, 1), (2, 1), (2, 1)]
    vocabulary = L.Vocabulary([b"a" * 17, b"a" * 8 + b"b" + b"a" * 8, b"ab"])
    block = Block([b"a" * 8 + b"c" + b"a" * 8 + b" " + b"a" * 17 + b" ab a"])
    start, end, _ = L.term_spans(block)
    assert vocabulary.find(block, start, end).tolist() == [-1, 0, 2, -1]


def test_sums_beyond_doubles_are_integers():
    tree = L.ItemTree.build([(0, {0: 10**9}), (1, {0: 1})], np.array([12_000]), {})
    assert tree.kind is np.int64
    best = L.Best(tree.kth, 2)
    L.search_batch(tree, best, np.array([5]), np.array([3]), np.array([0, 1]), np.array([0]), np.array([1]), 1, 3)
    u = 10**9 // (1000 + 12 * 100)
    assert sorted(int(s[0]) for s in best.score) == [12_000 * u, 10**9 * 12_000 * u]
