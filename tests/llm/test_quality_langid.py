import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from cauce.llm import langid, quality
from cauce.llm.textnum import Block, blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in (x for x in text.split("\n") if WORD.search(x)):
        dup += line in seen
        seen.add(line)
    count = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {k for i in range(len(words) - 7) if count[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


EDGE = ["", "   ", "a", " a b c\n\na b c\n \n", "x " * 30, "é ü\x0b日本  x", "a\x0bb\na\x0bb\r\n", "\n\n", "  # * [ ]", "w" * 50_000,
        "\n".join(["one two three four five six seven eight"] * 3), "a b c d e f g h a b c d e f g h"]


def test_base_counts(spark, sf_small):
    texts = EDGE + [r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    data = [t.encode() for t in texts]
    got = []
    for i, j in blocks(data, 5000):
        counts, _, _ = quality._counts(Block(data[i:j]))
        got += zip(*(counts[c].tolist() for c in quality._ADDED), strict=True)
    assert got == [brute(t) for t in texts]


def test_quality_rules(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "x " * 40)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    out = quality.apply_rules(both, labels).toPandas()
    assert len(out) == both.count()
    words = out.n_words
    assert ((words < 20) | (100 * out.n_repeat_words > 30 * words)).equals(out.base_failed)
    assert not (out.kept & out.base_failed).any()
    judged = out.merge(labels.toPandas(), on="doc_id")
    judged = judged[judged.quality.isin([0, 1])]
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert good.kept.mean() > 0.97
    assert 1 - judged[judged.quality == 0].kept.mean() > 0.85


def test_quality_without_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 40, 3.0), (2, "b " * 3, None)], "doc_id long, text string, kept double")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.apply_rules(docs, labels).collect()}
    assert out[2]["base_failed"] and not out[2]["kept"] and out[1]["quality_prob"] is None
    assert out[1]["base_failed"]  # the same 8 words again and again
    assert quality.apply_rules(docs.limit(0), labels).count() == 0


def test_calibration_orders_and_bounds():
    rng = np.random.default_rng(0)
    margin = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * margin + 1)))).astype(float)
    a, b = quality._platt(margin, y)
    assert abs(a - 0.5) < 0.08 and abs(b - 1) < 0.15


def test_language_accuracy_on_held_out_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = langid.identify(docs).withColumn("held", langid.held_out()).toPandas()
    assert (out.held == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, "the and of thing " * 9, "en") for i in range(40)] + [(100 + i, "ción ñado está " * 9, "es") for i in range(40)]
    edge = [(1000, None, None), (1001, "", None), (1002, "123 !?", "en"), (1003, "the and of", None), (None, "ción ñado", None),
            (1004, "ción " * 30_000, None), (1004, "ción " * 30_000, None)]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string").withColumn("score", langid.held_out())
    out = langid.identify(docs)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r["doc_id"]: r["lang_pred"] for r in out.where("doc_id >= 1000 OR doc_id IS NULL").collect()}
    assert got == {1000: "und", 1001: "und", 1002: "und", 1003: "en", None: "es", 1004: "es"}
    assert out.where("doc_id = 1004").count() == 2
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_pair_tables_equal_plain_convolution():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(12)]
    model = langid.train(texts, ["a", "b"] * 6, steps=5)
    windows = np.concatenate([langid.windows_of(t) for t in texts])
    pooled = []
    for taps, bias in zip(model.taps, model.bias, strict=True):
        w = len(taps)
        h = sum(taps[j][windows[:, j:langid.WINDOW - w + 1 + j]] for j in range(w))
        pooled.append(np.maximum(h.max(1) + bias, 0))
    z = np.concatenate(pooled, 1) @ model.out + model.out_bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(model.log_probs(windows, model.tables()), want, atol=1e-4)


def test_ngrams_end_with_their_text():
    """A text's n-grams, and so its probability, are the same whatever stands beside it in a block."""
    texts = ["short words of a text", "", "abc", "é ü ñ\nß four", "abcd", "another one"]
    none = np.zeros(0, np.uint64)
    _, grams, first = quality._features([t.encode() for t in texts], none)
    assert list(np.diff(first)) == [max(0, len(t) - quality.NGRAM + 1) for t in texts] and first[-1] == len(grams)
    for i, t in enumerate(texts):
        _, alone, _ = quality._features([t.encode()], none)
        assert np.array_equal(grams[first[i]:first[i + 1]], alone)


def test_more_labels_than_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    rows = [(i, f"alpha beta {i}", "aa") for i in range(40)] + [(100 + i, f"gamma delta {i}", "bb") for i in range(30)]
    rows += [(200 + i, f"zeta {i}", f"z{i % 9}") for i in range(27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.labelled_sample(docs)[1]) == {"aa", "bb"}
