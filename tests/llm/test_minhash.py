import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cauce.llm import minhash
from cauce.llm.components import components


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [], [("a", "a")], [("a", "b"), ("b", "c"), ("d", "e")], [(f"{i:03}", f"{i + 1:03}") for i in range(60)],
    [("hub", f"n{i}") for i in range(200)] + [("n5", "z"), ("z", "y")]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges + [(None, "q")], "a string, b string")
    assert {r["node"]: r["root"] for r in components(frame).collect()} == roots(edges)


def shingles(text):
    words = text.lower().split()
    n = len(words)
    return collections.Counter(tuple(words[i:i + 5]) for i in range(n - 4)) if n >= 5 else collections.Counter([tuple(words)] if words else [])


def weighted_jaccard(a, b):
    x, y = shingles(a), shingles(b)
    lo, hi = sum((x & y).values()), sum((x | y).values())
    return lo / hi if hi else 0.0


def make(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))


def edit(rng, text, k):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = "".join(rng.choices("klmnop", k=5))
    return " ".join(words)


PLAIN = minhash.Idf(np.zeros(0, np.int64), np.zeros(0))


def test_similarities_and_blocks_equal_counting():
    rng = random.Random(5)
    base = [make(rng, 60) for _ in range(4)]
    texts = base + [edit(rng, t, k) for t in base for k in (1, 2, 4)] + ["", "a b", "a b", "x y z w v x y z w v x y z w v", "A B"]
    pairs = [(a, b) for a in texts for b in texts]
    got = minhash.similarities([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], PLAIN)
    assert np.allclose(got, [weighted_jaccard(a, b) for a, b in pairs])
    links = minhash.block_links([t.encode() for t in texts], [t.encode() for t in texts], PLAIN, 0.5)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if weighted_jaccard(a, b) >= 0.5}
    assert {(i, j) for i, j, _ in links} == want
    assert all(abs(s - weighted_jaccard(texts[i], texts[j])) < 1e-5 for i, j, s in links)


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = random.Random(2)
    agree, sims = [], []
    draws = minhash._draws()
    for _ in range(60):
        a = make(rng, 120)
        b = edit(rng, a, 6)
        s = minhash.signatures([a.encode(), b.encode()], PLAIN, draws)
        agree.append((s[0] == s[1]).mean())
        sims.append(weighted_jaccard(a, b) ** minhash.ROWS)
    assert abs(np.mean(agree) - np.mean(sims)) < 0.06


def truth(rows, threshold):
    """Classes of rows by brute force, with plain weights."""
    texts = sorted({t or "" for _, t in rows})
    edges = [(a, b) for i, a in enumerate(texts) for b in texts[i:] if a == b or weighted_jaccard(a, b) >= threshold]
    root = roots(edges)
    first = {}
    for doc_id, t in rows:
        first[root[t or ""]] = min(first.get(root[t or ""], doc_id), doc_id)
    return {doc_id: first[root[t or ""]] for doc_id, t in rows}


def corpus():
    rng = random.Random(9)
    rows = [(i, make(rng, rng.randint(30, 120))) for i in range(400)]
    shared = make(rng, 60)
    rows += [(1000 + i, make(rng, 100) + " " + shared) for i in range(80)]  # a passage that many documents share
    for k in range(25):
        base = make(rng, 100)
        rows += [(2000 + 10 * k, base), (2001 + 10 * k, edit(rng, base, 1)), (2002 + 10 * k, base), (2003 + 10 * k, edit(rng, base, 2))]
    hot = make(rng, 150)
    rows += [(5000 + i, edit(rng, hot, rng.choice([0, 1, 1, 2, 3, 5, 9]))) for i in range(150)]  # a family with loose members
    rows += [(9000, None), (9001, ""), (9002, "two words"), (9003, "two words"), (9004, "Two Words"), (9005, " \n")]
    return rows


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COMMON", 1.0)  # plain weights
    monkeypatch.setattr(minhash, "FLOOR", 1.0)
    rows = corpus()
    want = truth(rows, 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == want
    size = collections.Counter(want.values())
    assert all(r["class_size"] == size[r["class_id"]] and r["kept"] == (k == r["class_id"]) for k, r in got.items())


def test_rest_of_a_bucket_is_compared_exactly(spark, monkeypatch):
    """Stars find nothing here: links between other members of a bucket must come from the blocks."""
    monkeypatch.setattr(minhash, "verify", lambda pairs, idf, t: pairs.select("a", "b", F.lit(1.0).alias("sim")).where("false"))
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 4)
    rng = random.Random(3)
    base = make(rng, 100)
    rows = [(i, edit(rng, base, 1)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == truth(rows, 0.8)


def test_production_weights_find_what_all_pairs_find(spark):
    """Links of all pairs, weighted (document frequencies of the table) or plain, against the operator's classes."""
    rows = [r for r in corpus() if r[0] < 9000]
    texts = sorted({t for _, t in rows})
    idf = minhash.document_frequencies(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"))
    assert len(idf.bucket)  # the large family makes its shingles frequent
    left = [t.encode() for t in texts]
    links = [(texts[i], texts[j]) for i, j, _ in minhash.block_links(left, left, idf, 0.8) if i < j]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = {t: got[i] for i, t in rows}
    assert len(links) > 500 and np.mean([of[a] == of[b] for a, b in links]) >= 0.99
    root = roots(links)
    assert all(root[a] == root[b] for a in root for b in root if of[a] == of[b])  # nothing else is joined


def test_classes_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[0] >= 1060], "doc_id long, text string")
    found = [sorted(map(str, minhash.near_duplicates(docs.repartition(n)).collect())) for n in (1, 50)]
    assert found[0] == found[1]


def test_a_block_returns_fewer_links_than_members():
    found = [(i, j, 1.0) for i in range(40) for j in range(40)]
    classes = np.array([f"{i:02}" for i in range(40)], object)
    tree = minhash._forest(found, classes, classes)
    assert len(tree) == 39 and set(roots(tree).values()) == {"00"}


def test_drop_and_edges(spark):
    rows = [(1, "a b c d e f g h", "k"), (1, "a b c d e f g h", "k"), (2, "a b c d e f g h", None), (None, "other text of words", "z"),
            (3, None, "n"), (4, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node string")
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["_node"]) for r in kept.collect()) == [("1", "k"), ("3", "n"), ("None", "z")]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_boilerplate_weighs_less(spark):
    rng = random.Random(4)
    shared = make(rng, 30)
    docs = spark.createDataFrame([(f"{shared} {make(rng, 10)}",) for _ in range(4000)], "text string")
    idf = minhash.document_frequencies(docs.select(F.col("text").cast("binary")))
    assert 20 <= len(idf.bucket) < 40 and np.allclose(idf.weight, minhash.FLOOR)


def test_large_family_holds_together(spark):
    """Near copies that make up a third of the table, with production parameters: all are linked by their original."""
    rng = random.Random(12)
    base = make(rng, 110)
    family = [base, *(edit(rng, base, 2) for _ in range(1199))]
    assert min(weighted_jaccard(base, t) for t in family) >= 0.8 > weighted_jaccard(family[1], family[2])
    rows = list(enumerate(family + [make(rng, 60) for _ in range(2400)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: 0 if i < len(family) else i for i, _ in rows}
    assert minhash.drop_near_duplicates(docs).count() == 2401
