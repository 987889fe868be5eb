"""Quality rules: base counts and a calibrated logistic regression on hashed n-grams.

Every whole text is scored in Arrow batches by array passes over blocks of
documents.  The base rules (too few words, too many words in repeated 8-word
windows) reject outright; the other texts are judged by a logistic regression
over hashed words and character 4-grams, trained in numpy on a bounded sample
of labelled rows and calibrated (Platt) on a part of the sample that the fit
did not see.  The verdict is a fixed threshold on the calibrated probability.

Words are runs of other characters than [\x20\x09-\x0D].

Defined cases: null and empty texts have no words and fail the base rules; a
text whose ``doc_id`` is null is scored like any other; without labelled rows
of both classes only the base rules decide and ``quality_prob`` is null;
repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.common import ship
from cauce.llm.textnum import Block, blocks, doc_of, keyed, parts_of, release, sequence_hashes, utf8, windows_inside

#: Base rules.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "[#*$%&|<>]"
#: Verdict: the calibrated probability of good quality that a text must reach.
MIN_PROBABILITY = 0.5
#: Hash space of each of the two feature kinds, and the character n-gram length.
BITS, NGRAM = 18, 4
#: Largest number of labelled rows fitted on, and the share of them kept for calibration.
SAMPLE_ROWS, CALIBRATION_SHARE = 3000, 0.25
STEPS, RATE, L2 = 150, 1.0, 1e-6

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_SIZE = 1 << BITS


def _counts(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base counts of each document, and the word hashes with the first word of each document."""
    start, end, first = block.words()
    head = (block.data & 0xC0) != 0x80  # first bytes of code points
    points = np.zeros(len(head) + 1, np.int64)
    np.cumsum(head, out=points[1:])
    chars = np.append(0, np.cumsum(points[end] - points[start]))
    word = block.hashes(start, end)
    doc = doc_of(first)

    # lines with a word that equal an earlier line of their document
    newline = np.flatnonzero(block.data == 10)
    line_lo, line_hi = np.append(0, newline[:-1] + 1), newline
    has_word = np.searchsorted(start, line_hi) > np.searchsorted(start, line_lo)
    line_lo, line_hi = line_lo[has_word], line_hi[has_word]
    line_doc = np.searchsorted(block.lo, line_lo, "right") - 1
    line_key = keyed(line_doc, block.hashes(line_lo, line_hi))
    _, at = np.unique(line_key, return_index=True)
    lines = np.bincount(line_doc, minlength=block.n)
    distinct = np.bincount(line_doc[at], minlength=block.n)

    # words of 8-word windows that the document holds at least twice
    inside = np.flatnonzero(windows_inside(first, REPEAT_WINDOW))
    window = keyed(doc[inside], sequence_hashes(word, REPEAT_WINDOW)[inside])
    order = np.argsort(window)
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    twice = inside[order[np.append(same, False) | np.append(False, same)]] if len(order) else inside
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    repeated = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))

    counts = {
        "n_words": np.diff(first),
        "word_chars": chars[first[1:]] - chars[first[:-1]],
        "n_symbols": block.per_doc(_SYMBOL[block.data]),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]],
    }
    return counts, word, first


def _features(texts: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word features, hashed character n-gram features, first n-gram of each document; none runs past its text."""
    points = np.frombuffer("\n".join([t.decode("utf-8", "replace") for t in texts]).encode("utf-32-le"), np.uint32)
    gram = points[:max(0, len(points) - NGRAM + 1)].copy()
    for j in range(1, NGRAM):
        gram *= np.uint32(0x9E3779B1)
        gram += points[j:len(gram) + j]
    gram *= np.uint32(0x85EBCA77)
    size = np.fromiter((len(t.decode("utf-8", "replace")) + 1 for t in texts), np.int64, len(texts))
    inside = np.arange(NGRAM, len(gram) + NGRAM) < np.repeat(np.cumsum(size), size)[:len(gram)]
    gram = gram[inside]
    first = np.append(0, np.cumsum(np.maximum(0, size - NGRAM)))
    return (word >> np.uint64(64 - BITS)).astype(np.int64), (gram >> np.uint32(32 - BITS)).astype(np.int64), first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[first[1:]] - total[first[:-1]]


@dataclass
class QualityModel:
    """Weights of words and of character n-grams, bias, and the calibration (slope, offset)."""

    words: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, word_ids: np.ndarray, word_first: np.ndarray, gram_ids: np.ndarray,
               gram_first: np.ndarray) -> np.ndarray:
        """Mean weight of the words plus mean weight of the n-grams plus the bias."""
        return (_sums(self.words[word_ids], word_first) / np.maximum(1, np.diff(word_first))
                + _sums(self.grams[gram_ids], gram_first) / np.maximum(1, np.diff(gram_first)) + self.bias)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log-odds (Newton's method, smoothed targets)."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * (a - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.linalg.solve(h, g)
    return max(float(a[0]), 1e-3), float(a[1])


def train(texts: list[bytes], labels: list[int]) -> QualityModel | None:
    """Fit on all but every fourth text, calibrate on those; None unless both classes are there."""
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        return None
    held = np.arange(len(y)) % max(2, round(1 / CALIBRATION_SHARE)) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    kinds: list[list[tuple]] = [[], []]  # words, n-grams: (document, feature, share), by document
    for i, j in blocks(texts):
        block = Block(texts[i:j])
        start, end, first = block.words()
        word, gram, gram_first = _features(texts[i:j], block.hashes(start, end))
        for kind, (ids, at) in enumerate(((word, first), (gram, gram_first))):
            doc = doc_of(at)
            key, n = np.unique(doc * _SIZE + ids[:len(doc)], return_counts=True)
            doc, ids = key // _SIZE, key % _SIZE
            kinds[kind].append(((doc + i).astype(np.int32), ids.astype(np.int32), (n / np.diff(at)[doc]).astype(np.float32)))
    rows = [tuple(np.concatenate([p[k] for p in parts]) for k in range(3)) for parts in kinds]
    del kinds
    firsts = [np.searchsorted(doc, np.arange(len(y) + 1)) for doc, _, _ in rows]
    weight = np.where(held, 0.0, np.where(y > 0, 0.5 / y[~held].sum(), 0.5 / (1 - y[~held]).sum()))
    w, bias = [np.zeros(_SIZE), np.zeros(_SIZE)], 0.0
    square, square_bias = [np.full(_SIZE, 1e-8), np.full(_SIZE, 1e-8)], 1e-8

    def margins() -> np.ndarray:
        return sum(_sums(w[k][ids] * value, firsts[k]) for k, (_, ids, value) in enumerate(rows)) + bias

    for _ in range(STEPS):  # full-batch Adagrad
        slope = weight * (1 / (1 + np.exp(-np.clip(margins(), -50, 50))) - y)
        for k, (doc, ids, value) in enumerate(rows):
            grad = np.bincount(ids, weights=slope[doc] * value, minlength=_SIZE) + L2 * w[k]
            square[k] += grad * grad
            w[k] -= RATE * grad / np.sqrt(square[k])
        square_bias += slope.sum() ** 2
        bias -= 0.1 * RATE * slope.sum() / np.sqrt(square_bias)
    margin = margins()
    fit = held if held.any() else ~held
    return QualityModel(w[0].astype(np.float32), w[1].astype(np.float32), float(bias),
                        *_platt(margin[fit], y[fit]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` texts with a quality label of 0 or 1, chosen by a hash of the id, half of each class if possible."""
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = good.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = [marks.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(rows // 2)
             for c in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])  # at most `rows` rows
    found = (docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
             .orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id").limit(rows).toPandas())
    return [t.encode() for t in found["text"]], [int(q) for q in found["quality"]]


_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(docs: DataFrame, model: QualityModel | None, threshold: float = MIN_PROBABILITY) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``quality_prob`` and ``kept`` (replaced if present)."""
    added = [*_ADDED, "base_failed", "quality_prob", "kept"]
    keep = [c for c in docs.columns if c not in added]
    ship(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two tables of 2^BITS floats
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(c, T.LongType()) for c in _ADDED],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("quality_prob", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])
    source, at = docs.select(*keep), keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = utf8(batch.column(at))
            for i, j in blocks(column):
                texts = column[i:j]
                counts, word, first = _counts(Block(texts))
                n = counts["n_words"]
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                if fitted is None:
                    prob = pa.nulls(j - i, pa.float64())
                    kept = ~failed
                else:
                    words, grams, gram_first = _features(texts, word)
                    p = fitted.probability(fitted.margin(words, first, grams, gram_first))
                    prob, kept = pa.array(p), ~failed & (p >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns, *[pa.array(counts[c].astype(np.int64)) for c in _ADDED],
                     pa.array(failed), prob, pa.array(kept)], names=[*keep, *added])

        release()
    return source.mapInArrow(run, schema)


def apply_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = MIN_PROBABILITY) -> DataFrame:
    """Train on the labelled rows and score every document."""
    return score(docs, train(*labelled_sample(docs, labels, rows)), threshold)
