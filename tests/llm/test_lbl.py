import collections
import math
import re
import zlib

import numpy as np
import pytest

from cauce.llm import lbl

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, lbl.score(docs).collect()), key=str)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = collections.Counter(t for i, text in rows if not held[i] for t in tokens_of(text))
    n, v = sum(count.values()), len(count)
    want = []
    for i, text in rows:
        toks = tokens_of(text)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in toks)
        want.append((i, held[i], len(toks), sum(count[t] > 0 for t in toks), n, base))
    want.sort(key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] < 0 or n == 0
    return got


def test_counts_and_baseline(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()][:120]
    check(spark, rows + [(-1, None), (-2, ""), (None, "The the THE"), (-3, "é É\x0bx"), (-3, "é É\x0bx"), (-4, "word " * 20_000)])


def test_rare_words_come_from_the_join(spark, monkeypatch):
    monkeypatch.setattr(lbl, "TABLE", 4)
    check(spark, [(i, f"a b c rare{i % 7} only{i}") for i in range(60)])


def test_nothing_to_learn_from(spark):
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = check(spark, [(i, "some words") for i in only])
    assert all(r[4] == 0 and r[5] == pytest.approx(0) for r in rows)
    assert lbl.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    vocab = lbl.Vocabulary(10, 3, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(lbl.TAILS),
                           np.zeros(lbl.TAILS), rng.integers(0, 50, lbl.CLASSES).astype(float))
    table = lbl.initial(vocab).log_probs()
    assert table.shape == ((lbl.CLASSES + 1) ** 2, lbl.CLASSES)
    assert np.allclose((10.0 ** table[::997]).sum(1), 1, atol=1e-4)


def test_model_beats_the_baseline_on_held_out_text(spark, sf_small):
    docs = spark.read.parquet(sf_small.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    rows = lbl.score(docs).where("held_out").toPandas()
    assert rows.score.sum() / rows.n_tokens.sum() > rows.base_score.sum() / rows.n_tokens.sum() + 0.05


def test_scores_do_not_depend_on_partitions(spark, sf_small, monkeypatch):
    monkeypatch.setattr(lbl, "SHARD_TOKENS", 1 << 12)  # many shards
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").limit(150)
    got = [lbl.score(docs.repartition(n)).toPandas().sort_values("doc_id").score.to_numpy() for n in (1, 6, 50)]
    assert np.abs(got[0] - got[1]).max() < 1e-6 and np.abs(got[0] - got[2]).max() < 1e-6


def test_score_by_brute_force(spark, monkeypatch):
    """Sum over a text's tokens of log10 P(class | two before) * P(token | class), token by token."""
    monkeypatch.setattr(lbl, "TABLE", 250)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 900)) for i in range(80)] + [(-1, None), (-2, "unseen Words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lbl.count_tokens(docs)
    vocab = lbl.vocabulary(counts)
    model = lbl.train(docs, vocab)
    count = {r["hash"] % 2 ** 64: r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in lbl.score(docs).collect()}
    own = {int(h): int(c) for h, c in zip(vocab.hashes, vocab.own, strict=True) if c >= 0}
    for i, text in rows:
        hashes, tail, _ = lbl.tokens([(text or "").encode()])
        one = two = lbl.START
        total = 0.0
        for h, t in zip(hashes.tolist(), tail.tolist(), strict=True):
            cls = own.get(h, lbl.OWN + t)
            z = (model.context[one] @ model.near + model.context[two] @ model.far) @ model.output.T + model.bias
            total += (z[cls] - math.log(np.exp(z.astype(float)).sum())) / math.log(10)
            if h not in own:
                total += math.log10((count.get(h, 0) + 1) / (vocab.tail_total[t] + vocab.tail_distinct[t] + 1))
            one, two = cls, one
        assert got[i] == pytest.approx(total, abs=1e-4 + 1e-5 * len(hashes))


def test_chunks_do_not_depend_on_the_calls():
    rng = np.random.default_rng(2)
    cls = rng.integers(0, lbl.CLASSES, 150_000).astype(np.int16)
    total = np.bincount(cls, minlength=lbl.CLASSES).astype(float)
    vocab = lbl.Vocabulary(len(cls), 30, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                           np.zeros(lbl.TAILS), np.zeros(lbl.TAILS), total)
    ends = np.arange(0, len(cls) + 1, 500)
    results = []
    for calls in (1, 7, 300):
        trainer = lbl.NceTrainer(lbl.initial(vocab), total, 1)
        for part in np.array_split(np.arange(300), calls):
            trainer.add(cls[ends[part[0]]:ends[part[-1] + 1]], ends[part[0]:part[-1] + 2] - ends[part[0]])
        trainer.finish()
        assert trainer.seen == len(cls)
        results.append(trainer.m.flat())
    assert all(np.array_equal(results[0], r) for r in results)


def test_training_learns_a_pattern():
    """Class 2 always follows class 1: its probability there grows far above its frequency."""
    rng = np.random.default_rng(1)
    cls = rng.integers(3, 30, 40_000)
    cls[::4], cls[1::4] = 1, 2
    total = np.bincount(cls, minlength=lbl.CLASSES).astype(float)
    vocab = lbl.Vocabulary(len(cls), 30, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                           np.zeros(lbl.TAILS), np.zeros(lbl.TAILS), total)
    one, two = lbl._contexts(cls, np.array([0, len(cls)]))
    trainer = lbl.NceTrainer(lbl.initial(vocab), total, 1)
    for _ in range(30):
        for at in range(0, len(cls), 4096):
            trainer.step(cls[at:at + 4096], one[at:at + 4096], two[at:at + 4096])
    table = trainer.m.log_probs().reshape(lbl.CLASSES + 1, lbl.CLASSES + 1, lbl.CLASSES)
    assert 10 ** table[10, 1, 2] > 0.6 > 0.25
