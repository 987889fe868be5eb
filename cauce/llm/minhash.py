"""Near-duplicate detection: consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of five words (A-Z lowered; a text
of one to four words is a single shingle): weight = term frequency times an
inverse document frequency that is 1 up to ``COMMON`` of the texts and falls
to ``FLOOR`` for shingles of all texts, so boilerplate counts less.  Document
frequencies count every distinct text once, in a table of hash buckets that is
``BUCKETS_PER_SHINGLE`` times as long as a text has shingles on average.  Near
copies make each other's shingles frequent, so a pair also counts when its
similarity without these weights reaches the threshold.

* Texts: rows are reduced to distinct texts first.  A text of one row stays where
  it is; only rows in a broadcast set of hash buckets, those of repeated texts, move.
* Signatures: improved consistent weighted sampling (Ioffe 2010), ``BANDS`` x
  ``ROWS`` samples; a band is a hash of its samples.  A text that loses more
  than ``MAX_LOSS`` of its weight to the document frequencies has the bands of
  plain weights too, in the same buckets.
* Candidates: texts that share a band form a bucket.  Each member is paired
  with the bucket's leader (another one in each band), pairs are verified by
  the exact Jaccard similarity, weighted or plain, and links are joined to
  classes.
* More leaders: in a bucket that still holds more than one class, the members
  outside its largest class are compared with a member of that class, again (with
  another one) as long as that links a fair part of them.
* Rest: what is left of a bucket is finished exactly: the members outside its
  largest class are compared with all others in blocks, and a block returns one
  spanning forest of the links between its classes, fewer links than members.  So
  any two texts that share a band and reach the threshold end in one class, and no
  bucket is capped.  Bands are finished in ``PHASES`` one after the other, since
  what one band links need not be compared in the next.

Equal texts are one node from the start; copies never multiply pairs.  Classes
depend on the texts alone, not on how rows are dealt to tasks.

Defined cases: null and empty texts are equal texts and link to nothing else,
as do texts without words; a class is named by its smallest ``doc_id`` (null
only if all are null); an empty table gives an empty result.  Only ``doc_id`` and
``text`` are read; where rows are returned, their other columns keep any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.common import drop_tables, materialise, salt_of, salted_lookup, ship
from cauce.llm.components import components
from cauce.llm.textnum import Block, blocks, doc_of, keyed, mix64, parts_of, release, sequence_hashes, utf8, windows_inside

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Share of texts up to which a shingle has full weight; weight of a shingle of every text.
COMMON, FLOOR = 0.1, 0.05
#: Share of a text's weight that document frequencies may take before it gets plain bands as well.
MAX_LOSS = 0.05
#: Buckets of the document-frequency table: per shingle of a mean text (at least 2^MIN_BITS, at most 2^MAX_BITS).
BUCKETS_PER_SHINGLE, MIN_BITS, MAX_BITS = 256, 18, 24
#: Hash buckets of the broadcast filters of texts.
FILTER_BUCKETS = 1 << 18
#: Share of its pairs that a round of further leaders must link to be repeated.
FAIR = 0.25
#: Members and bytes of a block in the exact comparison of a bucket's rest; the bands of each phase.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 32 << 20
PHASES = (range(0, 2), range(2, BANDS))
_DRAW_BITS = 16


# ------------------------------------------------------------------- weights
@dataclass
class Idf:
    """Weights of the document-frequency buckets that are below 1."""

    bucket: np.ndarray
    weight: np.ndarray
    bits: int = MIN_BITS

    def of(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.bucket):
            return np.ones(len(shingle))
        key = (shingle >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.bucket, key), len(self.bucket) - 1)
        return np.where(self.bucket[at] == key, self.weight[at], 1.0)


#: All weights 1.
PLAIN = Idf(np.zeros(0, np.int64), np.zeros(0))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, term frequency), ordered by document; every shingle once per document."""
    block = Block(texts, lower=True)
    start, end, first = block.words()
    word = block.hashes(start, end)
    at = np.flatnonzero(windows_inside(first, SHINGLE))
    doc, shingle = doc_of(first)[at], sequence_hashes(word, SHINGLE)[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = [sequence_hashes(word[first[i]:first[i + 1]], count[i])[0] + np.uint64(count[i]) for i in short]
        doc, shingle = np.append(doc, short), np.append(shingle, np.array(whole, np.uint64))
    _, index, tf = np.unique(keyed(doc, shingle), return_index=True, return_counts=True)
    order = np.argsort(doc[index], kind="stable")
    return doc[index][order], shingle[index][order], tf[order]


def document_frequencies(texts: DataFrame, mean_bytes: float = 0.0) -> Idf:
    """Inverse document frequencies over the ``text`` values, which are distinct; mean_bytes sizes the table.

    A bucket holds less than a 1 / ``BUCKETS_PER_SHINGLE`` part of the texts by chance, up to ``MAX_BITS``.
    """
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(1 + BUCKETS_PER_SHINGLE * mean_bytes / 6)))))
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = utf8(batch.column(0))
            for i, j in blocks(column):
                doc, shingle, _ = features(column[i:j])
                key = np.unique(doc.astype(np.int64) * size + (shingle >> np.uint64(64 - bits)).astype(np.int64))
                total += np.bincount(key % size, minlength=size)  # a text counts once in a bucket
                n += j - i
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])
        release()

    counts = materialise(texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")), "df")
    n = counts.where("bucket = -1").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # shares above COMMON belong to less than (shingles of a mean text) / COMMON buckets, whatever the number of texts
    frequent = counts.where(F.col("bucket") >= 0).where(F.col("n") > COMMON * n).orderBy("bucket").toPandas()
    share = frequent["n"].to_numpy(float) / max(n, 1)
    return Idf(frequent["bucket"].to_numpy(np.int64), np.maximum(FLOOR, np.log(1 / share) / np.log(1 / COMMON)), bits)


# ---------------------------------------------------------------- signatures
def _draws() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(11)
    n = 1 << _DRAW_BITS
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    return r, np.log(c), beta, rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: list[bytes], idf: Idf, draws: tuple[np.ndarray, ...]) -> np.ndarray:
    """Band hashes (texts x BANDS, int64); a text without words has the band hash 0 throughout."""
    r, log_c, beta, odd = draws
    doc, shingle, tf = features(texts)
    out = np.zeros((len(texts), BANDS), np.uint64)
    if not len(doc):
        return out.view(np.int64)
    weight = tf * idf.of(shingle)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(first, len(doc)))
    unit = (log_c + r * beta - r).astype(np.float32)  # of weight 1, where t is 0
    other = np.flatnonzero(weight != 1)
    log_w = np.log(weight[other])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(BANDS * ROWS):
        draw = (shingle * odd[k]) >> np.uint64(64 - _DRAW_BITS)
        draw = draw.astype(np.int64)
        a, name = unit[draw], shingle
        if len(other):
            d = draw[other]
            t = np.floor(log_w / r[d] + beta[d])
            a[other] = log_c[d] - r[d] * (t - beta[d] + 1)
            name = shingle.copy()
            name[other] += t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        least = np.repeat(np.minimum.reduceat(a, first), size)
        sample = np.minimum.reduceat(np.where(a == least, name, top), first)
        band = k // ROWS
        rows = doc[first]
        out[rows, band] = mix64(out[rows, band] * np.uint64(0xD6E8FEB86659FD93) + sample + np.uint64(band + 1))
    return out.view(np.int64)


def all_bands(texts: list[bytes], idf: Idf, draws: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Band hashes of each text: ``BANDS`` weighted ones, and as many plain ones if it loses more than ``MAX_LOSS``."""
    out = list(signatures(texts, idf, draws))
    if not len(idf.bucket):
        return out
    doc, shingle, tf = features(texts)
    full = np.bincount(doc, weights=tf, minlength=len(texts))
    left = np.bincount(doc, weights=tf * idf.of(shingle), minlength=len(texts))
    light = np.flatnonzero(left < (1 - MAX_LOSS) * full)
    if len(light):
        for at, plain in zip(light, signatures([texts[i] for i in light], PLAIN, draws), strict=True):
            out[at] = np.append(out[at], plain)
    return out


def sign(texts: DataFrame, idf: Idf) -> DataFrame:
    """(node, bands) of distinct (node, text) rows: the text's band hashes (see :func:`all_bands`)."""
    source = texts.select("node", F.col("text").cast("binary").alias("b"))
    draws = _draws()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = batch.column(1).to_pylist()
            for i, j in blocks(column):
                bands = all_bands(column[i:j], idf, draws)
                ends = pa.array(np.append(0, np.cumsum([len(b) for b in bands])).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bands)))], names=["node", "bands"])
        release()

    return source.mapInArrow(run, "node string, bands array<bigint>")


def _node() -> Column:
    return F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)


# -------------------------------------------------------------- verification
def similarities(left: list[bytes], right: list[bytes], idf: Idf) -> np.ndarray:
    """Exact Jaccard similarity of the texts at equal positions: the larger of the weighted and the plain one."""
    (doc_left, shingle_left, tf_left), (doc_right, shingle_right, tf_right) = features(left), features(right)
    _, x, y = np.intersect1d(keyed(doc_left, shingle_left), keyed(doc_right, shingle_right), assume_unique=True, return_indices=True)
    best = np.zeros(len(left))
    for weights in (idf, PLAIN) if len(idf.bucket) else (PLAIN,):
        one, two = tf_left * weights.of(shingle_left), tf_right * weights.of(shingle_right)
        total = np.bincount(doc_left, weights=one, minlength=len(left)) + np.bincount(doc_right, weights=two, minlength=len(left))
        common = np.bincount(doc_left[x], weights=np.minimum(one[x], two[y]), minlength=len(left))
        union = total - common
        best = np.maximum(best, np.divide(common, union, out=np.zeros(len(left)), where=union > 0))
    return best


def verify(pairs: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Of pairs (a, b, text_a, text_b) those whose similarity reaches the threshold: a, b, sim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j in blocks([x + y for x, y in zip(one, two, strict=True)]):
                sim = similarities(one[i:j], two[i:j], idf)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sim)], names=["a", "b", "sim"]).filter(
                    pa.array(sim >= threshold - 1e-9))
        release()

    cols = [F.col("a"), F.col("b"), F.col("text_a").cast("binary"), F.col("text_b").cast("binary")]
    return pairs.select(*cols).mapInArrow(run, "a string, b string, sim double")


def block_links(left: list[bytes], right: list[bytes], idf: Idf, threshold: float) -> list[tuple[int, int, float]]:
    """All (i, j, sim) with similarity of left[i] and right[j], weighted or plain, at the threshold or above, exactly.

    A weighted set with frequencies is a plain set of (shingle, occurrence) whose members weigh the
    shingle's idf, so the sum of minima is a matrix product.  Members that occur once among both sides
    cannot be shared; a text whose other members weigh too little for the threshold has no partner.
    """
    doc, shingle, tf = features(left + right)
    member_doc, member = np.repeat(doc, tf), np.repeat(shingle, tf)
    nth = np.arange(len(member)) - np.repeat(np.append(0, np.cumsum(tf)[:-1]), tf)
    weight, key = idf.of(member), keyed(nth, member)
    found = _links_of(member_doc, key, np.ones(len(member)), len(left), len(right), threshold)
    if (weight != 1).any():
        for pair, sim in _links_of(member_doc, key, weight, len(left), len(right), threshold).items():
            found[pair] = max(sim, found.get(pair, 0.0))
    return [(i, j, sim) for (i, j), sim in sorted(found.items())]


def _links_of(member_doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_left: int, n_right: int,
              threshold: float) -> dict[tuple[int, int], float]:
    """Similarity by (i, j) of the pairs of :func:`block_links`, for one weight of each member."""
    total = np.bincount(member_doc, weights=weight, minlength=n_left + n_right)
    alive = total > 0
    while True:  # drop texts that cannot reach the threshold until nothing changes
        use = alive[member_doc]
        _, inverse, count = np.unique(key[use], return_inverse=True, return_counts=True)
        shared = count[inverse] > 1
        sums = np.bincount(member_doc[use][shared], weights=weight[use][shared], minlength=len(total))
        left_over = alive & (sums >= (threshold - 1e-9) * total)
        if (left_over == alive).all():
            break
        alive = left_over
    rows_l, rows_r = np.flatnonzero(alive[:n_left]), np.flatnonzero(alive[n_left:])
    if not len(rows_l) or not len(rows_r):
        return {}
    place = np.full(len(total), -1)
    place[rows_l], place[n_left + rows_r] = np.arange(len(rows_l)), np.arange(len(rows_r))
    docs, keys, weights = member_doc[use][shared], inverse[shared], weight[use][shared]
    common = np.zeros((len(rows_l), len(rows_r)))
    width = 4096
    order = np.argsort(keys, kind="stable")
    docs, weights = docs[order], weights[order]
    keys = np.unique(keys[order], return_inverse=True)[1]
    for at in range(0, int(keys[-1]) + 1, width):
        lo, hi = np.searchsorted(keys, [at, at + width])
        d, k, w = docs[lo:hi], keys[lo:hi] - at, weights[lo:hi]
        x, y = np.zeros((len(rows_l), width), np.float32), np.zeros((len(rows_r), width), np.float32)
        is_left = d < n_left
        x[place[d[is_left]], k[is_left]] = w[is_left]
        y[place[d[~is_left]], k[~is_left]] = 1
        common += x @ y.T
    union = total[rows_l][:, None] + total[n_left + rows_r][None] - common
    i, j = np.nonzero(common >= (threshold - 1e-6) * union)
    return {(int(rows_l[p]), int(rows_r[q])): float(common[p, q] / union[p, q]) for p, q in zip(i, j, strict=True)}


def _forest(found: list[tuple[int, int, float]], one: np.ndarray, two: np.ndarray) -> list[tuple[str, str]]:
    """Links that join the same classes as all links do, without a circle: fewer than there are classes."""
    parent: dict[str, str] = {}

    def top(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j, _ in found:
        a, b = top(one[i]), top(two[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((one[i], two[j]))
    return out


def _rest_links(members: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """(a, b) classes that links within buckets join.

    members: bucket columns (band, key), node, comp, size (bytes), major (the bucket's largest class).
    Members outside the largest class are compared with all members, block by block.
    """
    sizes = members.groupBy("band", "key").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("size") / BLOCK_BYTES)).cast("int").alias("m"))
    dealt = (salted_lookup(members.withColumn("_salt", salt_of("node")), sizes, ["band", "key"], "_salt")
             .withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("m")).cast("int")))
    minor = dealt.where("comp <> major")
    lefts = minor.select("band", "key", F.col("block").alias("lb")).distinct()
    left = minor.select("band", "key", F.col("block").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("rb"),
                        "node", "comp", F.lit(0).alias("side"))
    per_bucket = lefts.groupBy("band", "key").agg(F.collect_set("lb").alias("lbs"))  # numbers of blocks
    right = (salted_lookup(dealt, per_bucket, ["band", "key"], "_salt", "inner")
             .select("band", "key", F.explode("lbs").alias("lb"), F.col("block").alias("rb"), "node", "comp", "major")
             .where("comp = major OR rb >= lb")  # two blocks of minor members meet once
             .select("band", "key", "lb", "rb", "node", "comp", F.lit(1).alias("side")))
    rows = left.unionByName(right).withColumn("_salt", salt_of("band", "key", "lb", "rb"))
    rows = salted_lookup(rows, texts.select("node", "text"), ["node"], "_salt", "inner").select(
        "band", "key", "lb", "rb", "side", "node", "comp", F.col("text").cast("binary").alias("text"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group[group.side == 0], group[group.side == 1]
        found = block_links(list(one.text), list(two.text), idf, threshold)
        return pd.DataFrame(_forest(found, one.comp.to_numpy(), two.comp.to_numpy()), columns=["a", "b"])

    return rows.groupBy("band", "key", "lb", "rb").applyInPandas(run, "a string, b string")


# ------------------------------------------------------------------- classes
def _bucket(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(FILTER_BUCKETS)).cast("int")


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node, size in bytes; texts: node, text of every distinct text)."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = materialise(docs.select("doc_id", _node().alias("node"), F.octet_length(text).alias("size")), "nodes")
    repeated = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    wanted = F.broadcast(repeated.select(_bucket("node").alias("bucket")).distinct())  # at most FILTER_BUCKETS rows
    every = docs.select(_node().alias("node"), text).withColumn("bucket", _bucket("node"))
    met = materialise(every.join(wanted, "bucket", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "met-texts")
    return rows, every.join(wanted, "bucket", "left_anti").select("node", "text").unionByName(met)


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes; only texts in a broadcast set of hash buckets are moved."""
    wanted = F.broadcast(nodes.select(_bucket("node").alias("bucket")).distinct())  # at most FILTER_BUCKETS rows
    return (texts.withColumn("bucket", _bucket("node")).join(wanted, "bucket", "left_semi")
            .join(nodes.select("node"), "node", "left_semi").select("node", "text"))


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Of (a, b) node pairs those whose texts are similar enough."""
    one = salted_lookup(pairs.withColumn("_salt", salt_of("b")), texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")),
                        ["a"], "_salt", "inner")
    two = salted_lookup(one.withColumn("_salt", salt_of("a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")),
                        ["b"], "_salt", "inner")
    return materialise(verify(two, idf, threshold), "links")


def _open_buckets(members: DataFrame) -> DataFrame:
    """The members (band, key, node, comp, size) of buckets that hold several classes, with the largest class (major)."""
    per_class = members.groupBy("band", "key", "comp").agg(F.count("*").alias("c"))
    mixed = (per_class.groupBy("band", "key").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"), F.count("*").alias("classes"))
             .where("classes > 1").select("band", "key", "major"))
    found = salted_lookup(members.drop("major").withColumn("_salt", salt_of("node")), mixed, ["band", "key"], "_salt", "inner")
    return materialise(found.select("band", "key", "node", "comp", "size", "major"), "open")


def _joined(more: DataFrame) -> DataFrame:
    """(comp, to) after links (a, b) between classes; one round, since names that stay apart only cost comparisons."""
    return components(more, rounds=1).select(F.col("node").alias("comp"), F.col("root").alias("to"))


def _renamed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """members with the classes that links joined; a class may hold many members, so the lookup is salted."""
    found = salted_lookup(members.withColumn("_salt", salt_of("node")), joined, ["comp"], "_salt")
    return found.withColumn("comp", F.coalesce("to", "comp")).drop("to", "_salt")


def _more_leaders(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of each member outside its bucket's largest class with a member of that class."""
    rank = F.xxhash64("node", "band", F.lit(turn)).alias("rank")
    leaders = members.where("comp = major").groupBy("band", "key").agg(F.min(F.struct(rank, "node"))["node"].alias("leader"))
    met = salted_lookup(members.where("comp <> major").withColumn("_salt", salt_of("node")), leaders, ["band", "key"], "_salt", "inner")
    pairs = met.select(F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("major").alias("cb"), F.col("leader").alias("b"))
    return materialise(pairs.distinct(), "pairs")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node; classes: node, class, of every node linked to another)."""
    ship(docs.sparkSession)
    rows, distinct = distinct_texts(docs)
    mean = rows.agg(F.coalesce(F.avg("size"), F.lit(0.0))).first()[0]
    idf = document_frequencies(distinct.select(F.col("text").cast("binary").alias("text")), mean)
    banded = materialise(
        sign(distinct, idf).select("node", F.expr(f"inline(array_distinct(transform(bands, (k, i) -> struct(i % {BANDS} AS band, k AS key))))"))
        .where("key <> 0").withColumn("rank", F.xxhash64("node", "band")).withColumn("salt", salt_of("node")), "banded")
    leaders = (banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(F.struct("rank", "node")).alias("least"))
               .where("n > 1").select("band", "key", "n", F.col("least.node").alias("leader")))
    members = materialise(salted_lookup(banded, leaders, ["band", "key"], "salt", "inner"), "members")
    pairs = (members.where("node <> leader")
             .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())
    texts = materialise(_texts_of(distinct, members.select("node").distinct()), "texts")
    pairs = materialise(pairs, "pairs")
    links = _verified(pairs, texts, idf, threshold)
    first = materialise(components(links), "classes")
    drop_tables(banded, pairs, links)

    # buckets that still hold several classes
    size = texts.select("node", F.octet_length("text").alias("size"))
    left = _open_buckets(members.where("n > 2").join(first, "node", "left").join(size, "node")
                         .select("band", "key", "node", F.coalesce("root", "node").alias("comp"), "size"))
    if left.isEmpty():
        return rows, first.withColumnRenamed("root", "class")
    every, texts = texts, materialise(_texts_of(texts, left.select("node").distinct()), "open-texts")
    drop_tables(every, members)
    merges: list[DataFrame] = []  # links between classes, each in the names of its time
    for turn in range(1, 1 << 30):
        pairs = _more_leaders(left, turn)
        near = _verified(pairs.select("a", "b").distinct(), texts, idf, threshold)
        links = materialise(pairs.join(near.select("a", "b"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "class-links")
        linked, compared = links.count(), pairs.count()
        drop_tables(pairs, near)
        if linked:
            merges.append(links)
            before, left = left, _open_buckets(_renamed(left, _joined(links)))
            drop_tables(before)
        if linked <= FAIR * compared or left.isEmpty():
            break
    for bands in PHASES:
        now = left.where(F.col("band").isin(list(bands)))
        if now.isEmpty():
            continue
        links = materialise(_rest_links(now, texts, idf, threshold), "rest-links")
        if not links.isEmpty():
            merges.append(links)
            before, left = left, _open_buckets(_renamed(left, _joined(links)))
            drop_tables(before)
    drop_tables(texts, left)
    if not merges:
        return rows, first.withColumnRenamed("root", "class")
    edges = merges[0]
    for more in merges[1:]:
        edges = edges.unionByName(more)
    joined = components(edges).select(F.col("node").alias("root"), F.col("root").alias("class"))
    moved = salted_lookup(first.withColumn("_salt", salt_of("node")), joined, ["root"], "_salt").select(
        "node", F.coalesce("class", "root").alias("class"))
    loose = joined.join(first.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), "class")
    return rows, materialise(moved.unionByName(loose), "classes")


def _verdicts(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Per node: class_id (smallest doc_id of the class), keep_node (its node), class_size and text_copies."""
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("_id"), F.count("*").alias("text_copies"))
    nodes = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    whole = nodes.groupBy("class").agg(F.min(F.struct(F.col("_id").isNull().alias("void"), "_id", "node")).alias("best"),
                                       F.sum("text_copies").alias("class_size"))
    found = salted_lookup(nodes.withColumn("_salt", salt_of("node")), whole, ["class"], "_salt")
    return found.select("node", F.col("best._id").alias("class_id"), F.col("best.node").alias("keep_node"),
                        F.col("class_size").cast("bigint").alias("class_size"), "text_copies")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size (rows), text_copies (rows of equal text), kept.

    ``kept`` marks the row with the class's smallest ``doc_id`` (one of them, if rows repeat it).
    """
    rows_of, classes = near_classes(docs, threshold)
    rows = salted_lookup(rows_of.withColumn("_salt", salt_of("doc_id")), _verdicts(rows_of, classes), ["node"], "_salt")
    nth = F.row_number().over(Window.partitionBy("node", "_salt", "doc_id").orderBy("class_size"))
    return (rows.withColumn("_nth", nth)
            .select("doc_id", "class_id", "class_size", "text_copies",
                    ((F.col("node") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
                     & (F.col("_nth") == 1)).alias("kept")))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class; texts alone in their class are not moved."""
    rows_of, classes = near_classes(docs, threshold)
    verdicts = materialise(_verdicts(rows_of, classes).where("class_size > 1").select("node", "class_id", "keep_node"), "verdicts")
    bucket = F.pmod(F.xxhash64("_node"), F.lit(FILTER_BUCKETS)).cast("int")
    wanted = F.broadcast(verdicts.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BUCKETS)).cast("int").alias("_bucket"))
                         .distinct())  # at most FILTER_BUCKETS rows
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", _node().alias("_node")).withColumn("_bucket", bucket)
    alone = rows.join(wanted, "_bucket", "left_anti").select("_row.*")
    met = rows.join(wanted, "_bucket", "left_semi").withColumn("_salt", salt_of("doc_id"))
    judged = salted_lookup(met, verdicts.withColumnRenamed("node", "_node"), ["_node"], "_salt")
    nth = F.row_number().over(Window.partitionBy("_node", "_salt", "doc_id").orderBy("_bucket"))
    keep = F.col("keep_node").isNull() | ((F.col("_node") == F.col("keep_node"))
                                          & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_nth") == 1))
    return alone.unionAll(judged.withColumn("_nth", nth).where(keep).select("_row.*"))
