import collections

import pytest

from cauce.llm import mixing


def documents(spark, sizes, extra="1"):
    rows = [(1000 * k + i, name) for k, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string")


def simulate(shares):
    """Earliest deadline first over one period, by hand."""
    period, done, out = sum(shares.values()), collections.Counter(), []
    for t in range(period):
        ready = [((((done[s] + 1) * period + k - 1) // k), s) for s, k in shares.items() if done[s] * period // k <= t]
        _, s = min(ready)
        done[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 50, "b": 1, "c": 1, "d": 13}, {"x": 7, "y": 7}])
def test_schedule(spark, shares):
    frame = spark.createDataFrame(list(shares.items()), "source string, share long")
    slots = {t: r["source"] for r in mixing.pfair_slots(frame).collect() for t in r["slots"]}
    assert [slots[t] for t in range(sum(shares.values()))] == simulate(shares)


def test_deviation_windows_and_completeness(spark):
    docs = documents(spark, {"hot": 900, "b": 200, "c": 100, "d": 7})
    rows = mixing.mix(docs, {"hot": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, block_docs=4, parts=100).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    for source in ("hot", "b", "c", "d"):
        mine = sorted(r["source_rank"] for r in rows if r["source"] == source)
        assert mine == list(range(1, len(mine) + 1))
    owner = {}
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        assert owner.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    weight = {"hot": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    last = {s: max(r["slot"] for r in rows if r["source"] == s) for s in weight}
    taken = collections.Counter()
    for t in range(min(last.values()) + 1):  # until the first source runs out
        taken[owner[t][0]] += 1
        assert all(abs(taken[s] - w * (t + 1)) < 1 for s, w in weight.items())


def test_edges(spark):
    schema = "doc_id long, source string, share int, slot string, period int"
    rows = [(1, None, 1, "s", 2), (1, None, 1, "s", 2), (None, "a", None, None, 3), (2, "", 5, "t", None)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "source", "share", "period", *mixing.ADDED]
    assert got.count() == 4 and {r["source_rank"] for r in got.where("source IS NULL OR source = ''").collect()} == {1, 2, 3}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.interleave(docs).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0})


def test_interleave_follows_slots(spark):
    docs = documents(spark, {"a": 60, "b": 30})
    order = [r["doc_id"] for r in mixing.interleave(docs, block_docs=2).collect()]
    want = [r["doc_id"] for r in mixing.mix(docs, block_docs=2).orderBy("slot", "source_rank").collect()]
    assert order == want and len(order) == 90
