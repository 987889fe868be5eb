"""Language identification by a small byte-level convolutional network.

The network reads windows of ``WINDOW`` UTF-8 bytes: filters of widths 2, 3
and 4 over byte embeddings, a maximum over the window for each filter, a ReLU
and a softmax layer.  It is trained in numpy (Adam) on a bounded sample of
labelled texts and applied to *all* windows of every text in Arrow batches;
the window log-probabilities are averaged, weighted by their bytes.

For scoring, the embeddings of two neighbouring bytes are added up once into
tables over byte pairs, so a filter of width 4 costs two table rows a position.

Defined cases: a null text, or one without a Unicode letter, is ``und`` with
score 0; so is everything if no row is labelled; a text shorter than a window
is padded with zero bytes; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.common import ship
from cauce.llm.textnum import blocks, parts_of, release, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
#: Bounds of the training sample: documents and windows per language, and languages.
DOCS_PER_LANG, WINDOWS_PER_LANG, MAX_LANGS = 400, 4000, 500
STEPS, BATCH, RATE = 500, 96, 0.02
UNKNOWN = "und"
_CHUNK = 1024  # windows scored at once


@dataclass
class ByteCnn:
    """Parameters: per width the taps (width, 256, FILTERS) and biases; the softmax layer; the labels."""

    taps: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    labels: list[str]

    def tables(self) -> list[list[np.ndarray]]:
        """Per width the byte-pair (or byte) tables whose rows add up to the filter outputs."""
        found = []
        for taps in self.taps:
            pairs = [(taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(65536, -1)
                     for j in range(0, len(taps) - 1, 2)]
            found.append(pairs + ([taps[-1]] if len(taps) % 2 else []))
        return found

    def log_probs(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Log-probabilities (windows x labels)."""
        rows = []
        for at in range(0, len(windows), _CHUNK):
            w = windows[at:at + _CHUNK]
            pair = (w[:, :-1].astype(np.int32) << 8) | w[:, 1:]
            pooled = []
            for width, table, bias in zip(WIDTHS, tables, self.bias, strict=True):
                n = w.shape[1] - width + 1
                h = table[0][pair[:, :n]]
                for k, more in enumerate(table[1:], 1):
                    h += more[(pair if len(more) == 65536 else w)[:, 2 * k:2 * k + n]]
                while h.shape[1] > 1:  # maximum over positions, by halves
                    half = (h.shape[1] + 1) // 2
                    h = np.maximum(h[:, :half], h[:, -half:])
                pooled.append(np.maximum(h[:, 0] + bias, 0))
            z = np.concatenate(pooled, 1) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            rows.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(rows)


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(texts: list[bytes], labels: list[str], seed: int = 1, steps: int = STEPS) -> ByteCnn | None:
    """Fit the network; classes are weighted alike.  None without labelled texts."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    pools = []
    for name in names:
        mine = np.concatenate([windows_of(t) for t, x in zip(texts, labels, strict=True) if x == name])
        pools.append(mine[rng.permutation(len(mine))[:WINDOWS_PER_LANG]])
    k = len(names)
    taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), k)).astype(np.float32)
    params = [*taps, *bias, out, np.zeros(k, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = np.arange(BATCH)
    for step in range(1, steps + 1):
        y = rng.integers(0, k, BATCH)
        x = np.stack([pools[c][rng.integers(len(pools[c]))] for c in y])
        # half of the windows are shortened, as short texts are
        cut = np.where(rng.random(BATCH) < 0.5, rng.integers(16, WINDOW + 1, BATCH), WINDOW)
        x = np.where(np.arange(WINDOW) < cut[:, None], x, 0)
        pooled, best = [], []
        for w in range(len(WIDTHS)):
            n = WINDOW - WIDTHS[w] + 1
            h = sum(params[w][j][x[:, j:j + n]] for j in range(WIDTHS[w]))
            at = h.argmax(1)
            best.append(at)
            pooled.append(np.take_along_axis(h, at[:, None, :], 1)[:, 0] + params[len(WIDTHS) + w])
        m = np.concatenate(pooled, 1)
        a = np.maximum(m, 0)
        z = a @ params[-2] + params[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[rows, y] -= 1
        p /= BATCH
        da = (p @ params[-2].T) * (m > 0)
        grads = [np.zeros_like(q) for q in params]
        grads[-2], grads[-1] = a.T @ p, p.sum(0)
        for w in range(len(WIDTHS)):
            d = da[:, w * FILTERS:(w + 1) * FILTERS]
            grads[len(WIDTHS) + w] = d.sum(0)
            for j in range(WIDTHS[w]):
                np.add.at(grads[w][j], (x[rows[:, None], best[w] + j], np.arange(FILTERS)[None]), d)
        lr = RATE * (1 - 0.9 * step / steps)
        for i, g in enumerate(grads):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            params[i] -= lr * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    n = len(WIDTHS)
    return ByteCnn(params[:n], params[n:2 * n], params[-2], params[-1], names)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text falls into the part that is never learnt from (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def labelled_sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> tuple[list[bytes], list[str]]:
    """About ``per_lang`` labelled texts of each language (chosen by a hash of the id), never held-out ones.

    Of more than ``MAX_LANGS`` labels the most frequent are learnt (the first by name on ties).
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    per = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    counts = {r["lang"]: r["n"] for r in per.collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = usable.where(draw < share[F.col("lang")]).select("text", "lang", draw.alias("u")).toPandas()
    rows = rows.sort_values("u", kind="stable").groupby("lang").head(per_lang)
    return [t.encode() for t in rows["text"]], list(rows["lang"])


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced)."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    ship(docs.sparkSession)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source, at = docs.select(*keep, has_letter.alias("_letter")), keep.index("text")
    names = np.array(model.labels, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in (part for whole in batches for part in parts_of(whole)):
            texts = utf8(batch.column(at))
            letter = np.array(batch.column(len(keep)).to_pylist(), bool)
            for i, j in blocks(texts):
                parts = [windows_of(t) for t in texts[i:j]]
                logs = model.log_probs(np.concatenate(parts), tables)
                first = np.cumsum([0, *map(len, parts)])
                weight = np.concatenate([np.append(np.full(len(p) - 1, 1.0), max(1, len(t) - (len(p) - 1) * WINDOW) / WINDOW)
                                         for p, t in zip(parts, texts[i:j], strict=True)])
                total = np.add.reduceat(logs * weight[:, None], first[:-1], axis=0)
                mean = total / np.add.reduceat(weight, first[:-1])[:, None]
                prob = np.exp(mean - mean.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                best = prob.argmax(1)
                known = letter[i:j]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
                     pa.array(np.where(known, prob[np.arange(j - i), best], 0.0))],
                    names=[*keep, "lang_pred", "score"])

        release()
    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, per_lang: int = DOCS_PER_LANG, seed: int = 1) -> DataFrame:
    """Train on the labelled rows of ``docs`` outside the held-out part, predict every row."""
    return predict(docs, train(*labelled_sample(docs, per_lang), seed=seed))
