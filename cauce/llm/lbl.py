"""Language-model scores from a log-bilinear model over word classes.

Tokens are words (runs of other characters than [\x20\x09-\x0D], A-Z lowered)
and one end per text.  All tokens of all training texts are counted with Spark;
the counts give the add-one unigram baseline and, inside a class, the
probability of a word.

Model: P(token | text before) = P(class | two classes before) * P(token | class).
The ``OWN`` most frequent tokens are classes of their own, the others fall into
``TAILS`` classes by their last two bytes, which also places unseen words.  The
class model is log-bilinear: a context vector, the sum of the two embeddings
each through its position's matrix, is multiplied with the output embeddings.
It is trained in numpy by noise-contrastive estimation, one pass over all
training texts at every size: a hash deals them into shards of about
``SHARD_TOKENS`` tokens and the shards into ``ROUNDS`` rounds.  In a round each
shard's texts train a copy of the parameters in the order of their hashes; Spark
averages the copies, weighted by tokens, as whole numbers, and the next round
starts from the mean.  Nothing of this depends on how the table is partitioned.
Scoring normalises
exactly: one batched matrix product and a softmax give the log-probabilities
of all classes after all pairs of classes.

Counts of words too rare for the broadcast table (at most ``TABLE`` words) come
from a join on the word's 64-bit hash.

Defined cases: null counts as empty, an empty text is one end token; a null
``doc_id`` belongs to the training part; without training texts every token is
unseen and the classes are uniform; repeated rows count, and are scored, each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.common import drop_tables, materialise, ship
from cauce.llm.langid import held_out
from cauce.llm.textnum import Block, blocks, doc_of, parts_of, release

OWN, TAILS, DIM, NOISE, BATCH = 192, 64, 16, 24, 1024
CLASSES = OWN + TAILS  # at most 256: a class is written as one byte
START = CLASSES  # context before the first token
#: Words whose counts are broadcast at most.
TABLE = 1 << 16
RATE = 0.1
#: Partial counts that a task holds before it merges them.
MERGE_TOKENS = 600_000
#: Tokens that train one copy of the parameters, rounds of averaging, tokens that are shuffled together.
SHARD_TOKENS, ROUNDS, CHUNK = 1 << 18, 4, 1 << 16
#: Parameters are averaged in units of this.
UNIT = 2.0 ** -30
#: Tasks of a round at most.
TASKS = 1 << 13
END = 1  # the end token's hash
#: Part of the rows that is never learnt from: crc32 of the id's text mod 7 is 2.
PARTS, HELD = 7, 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class (0 .. TAILS-1) of every token, and the first token of each text (n + 1 values)."""
    block = Block(texts, lower=True)
    start, end, first = block.words()
    n = len(texts)
    doc = doc_of(first)
    total = len(start) + n
    hashes, tail = np.empty(total, np.uint64), np.zeros(total, np.int64)
    at = np.arange(len(start)) + doc
    hashes[at] = block.hashes(start, end)
    last = block.data[end - 1].astype(np.int64)
    before = np.where(end - start > 1, block.data[end - 2], 0).astype(np.int64) if len(start) else last
    tail[at] = ((last * 31 + before * 7) ^ (before >> 3)) % TAILS
    first = first + np.arange(n + 1)
    hashes[first[1:] - 1] = END
    return hashes, tail, first


def _contexts(cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before each token."""
    one, two = np.empty_like(cls), np.empty_like(cls)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    heads = first[:-1]
    one[heads] = START
    two[heads] = START
    second = heads + 1
    two[second[second < first[1:]]] = START
    return one, two


@dataclass
class Vocabulary:
    """Training totals, the classes' own tokens, the broadcast counts and the tail classes' totals."""

    total: int
    distinct: int
    hashes: np.ndarray  # sorted hashes of the most frequent tokens
    counts: np.ndarray
    own: np.ndarray  # their class, or -1
    tail_total: np.ndarray
    tail_distinct: np.ndarray
    class_total: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in the table of each token and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def classes(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        at, hit = self.find(hashes)
        own = np.where(hit, self.own[at], -1) if len(self.own) else np.full(len(hashes), -1)
        return np.where(own >= 0, own, OWN + tail)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(hash, tail, c) of all tokens of the training texts; written to the shared folder."""

    def merged(parts: list[tuple]) -> tuple:
        h, t, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, t, c = h[order], t[order], c[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[head], t[head], np.add.reduceat(c, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2])],
                                              names=["hash", "tail", "c"])
        parts: list[tuple] = []
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = batch.column(0).to_pylist()
            for i, j in blocks(column):
                h, t, _ = tokens(column[i:j])
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                parts.append((u, t[at], c))
                if sum(len(p[0]) for p in parts) > MERGE_TOKENS:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > MERGE_TOKENS // 2:
                        yield out(parts.pop())
        if parts:
            yield out(merged(parts))
        release()

    rows = docs.where(~held_out(parts=PARTS, part=HELD)).select(F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    counted = rows.mapInArrow(run, "hash bigint, tail bigint, c bigint")
    return materialise(counted.groupBy("hash").agg(F.max("tail").alias("tail"), F.sum("c").alias("c")), "token-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the most frequent tokens: whole levels of frequency, from the top, that fit the table
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()),
                    reverse=True)  # a row for each eighth of a power of two
    room, lowest = TABLE, None
    for one, n in levels:
        if n > room:
            break
        room, lowest = room - n, one
    frequent = (counts.where(level >= lowest).toPandas() if lowest is not None
                else counts.limit(0).toPandas())  # at most TABLE rows
    frequent = frequent.sort_values(["c", "hash"], ascending=[False, True], kind="stable")
    own = np.where(np.arange(len(frequent)) < OWN, np.arange(len(frequent)), -1)
    hashes = frequent["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    top = frequent["hash"].head(OWN).tolist()  # at most OWN values
    tails = counts.where(~F.col("hash").isin(top)) if top else counts
    found = {r["tail"]: (r["s"], r["n"]) for r in tails.groupBy("tail").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect()}
    tail_total = np.array([found.get(k, (0, 0))[0] for k in range(TAILS)], float)
    class_total = np.zeros(CLASSES)
    class_total[:min(OWN, len(frequent))] = frequent["c"].to_numpy(float)[:OWN]
    class_total[OWN:] = tail_total
    return Vocabulary(int(total), int(distinct), hashes[order], frequent["c"].to_numpy(np.int64)[order], own[order],
                      tail_total, np.array([found.get(k, (0, 0))[1] for k in range(TAILS)], float), class_total)


# --------------------------------------------------------------------- model
@dataclass
class LogBilinear:
    """Context embeddings (CLASSES + 1), output embeddings and biases, one matrix per position."""

    context: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.context, self.output, self.bias, self.near, self.far

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(float)

    @staticmethod
    def of(flat: np.ndarray) -> LogBilinear:
        shapes = [(CLASSES + 1, DIM), (CLASSES, DIM), (CLASSES,), (DIM, DIM), (DIM, DIM)]
        ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        return LogBilinear(*(flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True)))

    def log_probs(self) -> np.ndarray:
        """log10 P(class | two before, one before), (CLASSES + 1)^2 x CLASSES, by batched matrix products."""
        one, two = self.context @ self.near, self.context @ self.far
        out = np.empty((CLASSES + 1, CLASSES + 1, CLASSES), np.float32)
        for i in range(CLASSES + 1):  # i: the class two before
            z = (one + two[i]) @ self.output.T + self.bias
            z -= z.max(1, keepdims=True)
            out[i] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / np.log(10)
        return out.reshape(-1, CLASSES)


def initial(vocab: Vocabulary, seed: int = 3) -> LogBilinear:
    rng = np.random.default_rng(seed)
    share = (vocab.class_total + 1) / (vocab.class_total.sum() + CLASSES)
    return LogBilinear(rng.normal(0, 0.1, (CLASSES + 1, DIM)).astype(np.float32), rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32),
                       np.log(share).astype(np.float32), np.eye(DIM, dtype=np.float32), 0.5 * np.eye(DIM, dtype=np.float32))


class NceTrainer:
    """Noise-contrastive estimation by Adagrad; the noise is the classes' frequency."""

    def __init__(self, model: LogBilinear, class_total: np.ndarray, seed: int, squares: LogBilinear | None = None):
        self.m = LogBilinear(*(a.copy() for a in model.arrays()))
        share = (class_total + 1) / (class_total.sum() + CLASSES)
        self.cumulative = np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.squares = LogBilinear(*((np.full_like(a, 1e-4) for a in model.arrays()) if squares is None
                                     else (a.copy() for a in squares.arrays())))
        self.seen, self.held, self.waiting = 0, 0, []

    def add(self, cls: np.ndarray, first: np.ndarray) -> None:
        """Train on the texts, ``CHUNK`` tokens at a time whatever the size of the calls."""
        self.waiting.append((cls, *_contexts(cls, first)))
        self.held += len(cls)
        if self.held >= CHUNK:
            data = [np.concatenate(x) for x in zip(*self.waiting, strict=True)]
            whole = self.held - self.held % CHUNK
            for at in range(0, whole, CHUNK):
                self._chunk([x[at:at + CHUNK] for x in data])
            self.waiting, self.held = [tuple(x[whole:].copy() for x in data)], self.held - whole

    def finish(self) -> None:
        if self.held:
            self._chunk([np.concatenate(x) for x in zip(*self.waiting, strict=True)])
        self.waiting, self.held = [], 0

    def _chunk(self, data: list[np.ndarray]) -> None:
        order = self.rng.permutation(len(data[0]))
        for at in range(0, len(order), BATCH):
            self.step(*(x[order[at:at + BATCH]] for x in data))
        self.seen += len(order)

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), CLASSES - 1)
        x1, x2 = m.context[one], m.context[two]
        h = x1 @ m.near + x2 @ m.far
        q = m.output[word]
        right = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, q) + m.bias[word] - self.log_noise[word]))
        wrong = -1 / (1 + np.exp(-(h @ m.output[noise].T + m.bias[noise] - self.log_noise[noise])))
        dh = right[:, None] * q + wrong @ m.output[noise]
        n = len(word)
        # sums by class as products with a one-hot layout: sorted once, then added up in runs
        d_out = _sum_by(word, right[:, None] * h, CLASSES)
        np.add.at(d_out, noise, wrong.T @ h)
        d_bias = np.bincount(word, right, CLASSES)
        np.add.at(d_bias, noise, wrong.sum(0))
        d_context = _sum_by(one, dh @ m.near.T, CLASSES + 1) + _sum_by(two, dh @ m.far.T, CLASSES + 1)
        grads = [d_context, d_out, d_bias, x1.T @ dh, x2.T @ dh]
        for a, g, s in zip(m.arrays(), grads, self.squares.arrays(), strict=True):
            g = (g / n).astype(np.float32)
            s += g * g
            a += RATE * g / np.sqrt(s)


def _sum_by(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    order = np.argsort(index, kind="stable")
    index = index[order]
    head = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[index[head]] = np.add.reduceat(rows[order], head)
    return out


def class_codes(docs: DataFrame, vocab: Vocabulary, shards: int) -> DataFrame:
    """(shard, key, codes) of every training text, a byte for the class of each token; written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = batch.column(2).to_pylist()
            for i, j in blocks(column):
                h, t, first = tokens(column[i:j])
                codes = voc.classes(h, t).astype(np.uint8)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.Array.from_buffers(pa.binary(), j - i, [
                        None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(codes)])], names=["shard", "key", "codes"])
        release()

    # copies of a text differ in doc_id, so they are dealt to many shards
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = (docs.where(~held_out(parts=PARTS, part=HELD))
            .select(F.pmod(key, F.lit(shards)).cast("bigint").alias("shard"), key.alias("key"),
                    F.coalesce("text", F.lit("")).cast("binary").alias("b")))
    codes = materialise(rows.mapInArrow(run, "shard bigint, key bigint, codes binary"), "class-codes")
    shared.unpersist()
    return codes


def train(docs: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """One pass over all training texts, in ``ROUNDS`` rounds that each average their shards' parameters."""
    model, squares = initial(vocab), None
    spark = docs.sparkSession
    each = -(-vocab.total // (ROUNDS * SHARD_TOKENS))  # shards of a round
    if not each:
        return model
    codes = class_codes(docs, vocab, ROUNDS * each)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, squares, vocab.class_total))
        mine = (codes.where(F.col("shard") % ROUNDS == turn).repartition(min(each, TASKS), "shard")
                .sortWithinPartitions("shard", "key", "codes"))
        fitted = mine.mapInArrow(_fit(shared), "i int, v bigint, w bigint")
        mean = (fitted.groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)") * F.col("w").cast("decimal(18,0)")).alias("v"),
                                        F.sum("w").alias("w"))
                .select("i", (F.col("v").cast("double") / F.col("w") * F.lit(UNIT)).alias("v"))
                .toPandas().sort_values("i")["v"].to_numpy())  # two rows per parameter
        shared.unpersist()
        if len(mean):
            half = len(mean) // 2
            model, squares = LogBilinear.of(mean[:half]), LogBilinear.of(mean[half:])
    drop_tables(codes)
    return model


def _fit(shared):
    """Rows of shards, in order -> index, value in ``UNIT``s and tokens for each parameter and Adagrad sum of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, squares, class_total = shared.value
        trainer, current = None, None

        def result() -> pa.RecordBatch:
            trainer.finish()
            flat = np.rint(np.concatenate([trainer.m.flat(), trainer.squares.flat()]) / UNIT).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat),
                                               pa.array(np.full(len(flat), trainer.seen))], names=["i", "v", "w"])

        for batch in (part for whole in batches for part in parts_of(whole)):
            shard, texts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shard[a] != current:
                    if trainer is not None:
                        yield result()
                    current = shard[a]
                    trainer = NceTrainer(model, class_total, int(current), squares)
                cls = np.frombuffer(b"".join(texts[a:b]), np.uint8).astype(np.int16)
                trainer.add(cls, np.cumsum([0, *map(len, texts[a:b])]))
        if trainer is not None:
            yield result()
        release()

    return run


# ------------------------------------------------------------------- scoring
def _partial_scores(docs: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """Per row what the broadcast table decides, and the hashes of the tokens that it lacks."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))
    schema = T.StructType([*docs.select("doc_id").schema.fields, T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()),
                           T.StructField("rare", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, fitted = shared.value
        table = fitted.log_probs()
        log_count = np.append(np.log10(voc.counts + 1.0), 0.0)
        log_tail = np.log10(voc.tail_total + voc.tail_distinct + 1)
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = batch.column(2).to_pylist()
            for i, j in blocks(column):
                h, t, first = tokens(column[i:j])
                at, hit = voc.find(h)
                own = np.where(hit, voc.own[at], -1) if len(voc.own) else np.full(len(h), -1)
                cls = np.where(own >= 0, own, OWN + t)
                one, two = _contexts(cls, first)
                seen = np.where(hit, log_count[at], 0.0)
                model_part = table[two * (CLASSES + 1) + one, cls] + np.where(own >= 0, 0.0, seen - log_tail[t])
                rare = np.flatnonzero(~hit)
                heads = first[:-1]
                ends = np.searchsorted(rare, first).astype(np.int32)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(np.diff(first)), pa.array(np.add.reduceat(hit.astype(np.int64), heads)),
                     pa.array(np.add.reduceat(seen, heads)), pa.array(np.add.reduceat(model_part.astype(float), heads)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(h[rare].view(np.int64)))], names=schema.names)
        del table
        release()

    source = docs.select("doc_id", held_out(parts=PARTS, part=HELD).alias("held_out"),
                         F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return source.mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    ship(docs.sparkSession)
    counts = count_tokens(docs)
    vocab = vocabulary(counts)
    model = train(docs, vocab)
    partial = materialise(_partial_scores(docs, vocab, model).withColumn("row", F.monotonically_increasing_id()), "scores")
    found = (partial.select("row", F.explode("rare").alias("hash")).join(counts.select("hash", "c"), "hash")
             .groupBy("row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("_log")))
    floor = float(np.log10(vocab.total + vocab.distinct + 1))
    more, log = F.coalesce("_known", F.lit(0)), F.coalesce("_log", F.lit(0.0))
    return (partial.drop("rare").join(found, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"),
                    F.lit(vocab.total).cast("bigint").alias("train_tokens"),
                    (F.col("base") + log - F.col("n_tokens") * floor).alias("base_score"),
                    (F.col("model") + log).alias("score")))
