import hashlib

import pytest
from pyspark.sql import functions as F

from cauce.llm import exact_dedup
from cauce.llm.common import salted_lookup

WS = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in WS), []).append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        done = False
        for doc_id, text in members:
            best = doc_id == keep and not done and len(text) == max(len(t) for _, t in members)
            done = done or best
            out.append((doc_id, keep, len(members), best, digest))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb\n"), (5, None), (6, ""), (7, " \n"), (None, "ab"), (8, "x" * 100_000),
        (9, "x" * 100_000), (10, "é x"), (11, "éx"), (-12, "q"), (12, "q"), (13, "A B"), (2**62, "big"), (-2**62, "big")]


@pytest.mark.parametrize("salts", [1, 32])
def test_matches_brute_force(spark, salts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = [tuple(r) for r in exact_dedup.exact_groups(docs, salts).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_hot_group_and_repeated_rows(spark):
    rows = [(i % 300, "same  text") for i in range(600)] + [(1000 + i, f"t{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_groups(docs).toPandas()
    assert len(got) == 700 and got.kept.sum() == 101
    assert set(got[got.group_size > 1].keep_id) == {0}
    assert exact_dedup.drop_copies(docs).count() == 101


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    docs = spark.createDataFrame([(1, "a", "k", True), (2, "a ", None, None)],
                                 "doc_id long, text string, keep_id string, kept boolean")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "a ", None, None)]


def test_colliding_digests_compare_content(spark):
    """With the digest replaced by a constant, all texts collide and content alone decides."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "b")], "doc_id long, text string")
    real = exact_dedup._keyed
    try:
        exact_dedup._keyed = lambda d, s: real(d, s).withColumn("_digest", F.lit("0")).withColumn("_bucket", F.lit(0))
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
        kept = {r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()}
    finally:
        exact_dedup._keyed = real
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 2, True), 4: (2, 2, False)}
    assert kept == {2, 3}


def test_salted_lookup_is_a_join(spark):
    facts = spark.createDataFrame([(k % 5, k, k % 3) for k in range(50)], "k int, v int, s int")
    dims = spark.createDataFrame([(0, "a"), (3, "b"), (9, "c")], "k int, d string")
    assert sorted(map(tuple, salted_lookup(facts, dims, ["k"], "s").select("k", "v", "d").collect()), key=str) == sorted(
        map(tuple, facts.join(dims, "k", "left").select("k", "v", "d").collect()), key=str)
