"""Line deduplication on content-defined chunks of lines.

A text's lines are hashed; a rolling hash over the last one or two line hashes
decides after which lines a chunk ends, so boundaries move with the content
and survive lines inserted elsewhere.  Several such chunkings (``CHUNKINGS``)
run side by side, since a short passage may lie across the boundaries of one.
Chunks of at least two lines that occur more than once in the corpus are
told apart by the SHA-256 of their text, and all occurrences but the first
(smallest ``doc_id``, then first line) are removed.

All steps are Spark expressions.  Chunk counts travel as hashes; the texts are
dealt out once by row, and digests are taken only for hashes that occur more
than once.  A chunk that a third of all documents hold is a partial aggregate first
and is looked up on (hash, salt) after.

Defined cases: null texts stay null with no lines; an empty text is one empty
line; a null ``doc_id`` comes after all others; rows that repeat ``doc_id`` and
text lose the same lines; a text that loses all its lines becomes ``""``; a
hash that stands for two different chunk texts is judged for each text; the
first holder of a chunk always keeps it; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauce.llm.common import materialise, salt_of, salted_lookup

#: Per chunking: lines in the rolling hash, 1 / frequency of boundaries, seed.
CHUNKINGS = ((1, 2, 11), (1, 2, 23), (2, 2, 37), (2, 4, 53))
#: Characters (spaces at line ends not counted) that a chunk needs, and lines.
MIN_CHARS, MIN_LINES = 40, 2

_NULL_ID = str(1 << 63)


def _spans(hashes: str, size: str) -> str:
    """SQL for the distinct (first, last) line numbers of all chunks of all chunkings."""
    parts = []
    for window, modulus, seed in CHUNKINGS:
        back = f"if(i > 0, {hashes}[i - 1], 0) * 17" if window > 1 else "0"
        ends = (f"filter(sequence(0, {size} - 1), i -> i = {size} - 1 "
                f"or (({hashes}[i] * 31 + {back} + {seed}) div 7) % {modulus} = 0)")
        parts.append(f"transform(array({ends}), ends -> transform(ends, (e, k) -> "
                     f"named_struct('a', if(k = 0, 0, ends[k - 1] + 1), 'b', e)))[0]")
    return f"array_distinct(concat({', '.join(parts)}))"


def _chunks(docs: DataFrame) -> DataFrame:
    """doc_id, _text_key, lines, a, b of every chunk with enough lines and characters."""
    rows = (docs.select("doc_id", "text").where("text IS NOT NULL")
            .withColumn("_text_key", F.xxhash64("text"))
            .withColumn("lines", F.split("text", "\n", -1))
            .withColumn("h", F.expr("transform(lines, l -> cast(conv(substring(md5(l), 1, 8), 16, 10) as bigint))"))
            .withColumn("len", F.expr("transform(lines, l -> length(trim(l)))"))
            .withColumn("span", F.explode(F.expr(_spans("h", "size(lines)")))))
    return (rows.select("doc_id", "_text_key", "lines", "h", "len", "span.a", "span.b")
            .where(F.expr(f"b - a + 1 >= {MIN_LINES}"))
            .where(F.expr(f"aggregate(slice(len, a + 1, b - a + 1), 0, (s, x) -> s + x) >= {MIN_CHARS}")))


def _rank() -> Column:
    """Order of occurrences: doc_id, then first line, in one decimal (so that min() hash-aggregates)."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.expr(f"cast({_NULL_ID}BD as decimal(20,0))"))
    return (doc * F.expr("cast(2147483648BD as decimal(10,0))") + F.col("a")).cast("decimal(38,0)")


def _key() -> Column:
    """A row's key for the joins: its doc_id and text, hashed."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text_key"))


def _same_row(left: str, right: str) -> Column:
    return ((F.col(f"{left}._key") == F.col(f"{right}._key")) & (F.col(f"{left}._text_key") == F.col(f"{right}._text_key"))
            & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")))


def _per_row(spans: DataFrame, name: str, *cols: str) -> DataFrame:
    """The spans of each row as one array (bounded by its lines)."""
    return spans.withColumn("_key", _key()).groupBy("_key", "doc_id", "_text_key").agg(
        F.collect_set(F.struct(*cols)).alias(name))


def _repeated_spans(slim: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, _text_key, a, b of every repeated chunk occurrence that is not the chunk's first."""
    often = slim.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h")
    salted = slim.withColumn("_salt", salt_of("doc_id", "a"))
    wanted = _per_row(salted_lookup(salted, often, ["_h"], "_salt", "inner"), "_wanted", "a", "b")
    # chunks are told apart by the SHA-256 of their text, of hashes that occur more than once only
    chunk = F.array_join(F.slice("lines", F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1), "\n")
    chunks = (rows.alias("r").join(wanted.alias("w"), _same_row("r", "w"))
              .select("r.doc_id", "r._text_key", F.split("r.text", "\n", -1).alias("lines"), F.explode("w._wanted").alias("s"))
              .select("doc_id", "_text_key", "s.a", "s.b", F.unhex(F.sha2(chunk, 256)).alias("_digest")))
    chunks = materialise(chunks, "line-digests")
    verdict = (chunks.select("_digest", _rank().alias("_r")).groupBy("_digest")
               .agg(F.min("_r").alias("_first"), F.count("*").alias("n")).where("n > 1").select("_digest", "_first"))
    marked = salted_lookup(chunks.withColumn("_salt", salt_of("doc_id", "a")), verdict, ["_digest"], "_salt", "inner")
    return marked.where(_rank() != F.col("_first")).select("doc_id", "_text_key", "a", "b")


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of repeated chunks, plus ``n_lines`` (before) and ``n_removed``.

    Columns named like the added ones are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    chunk_hash = F.xxhash64(F.slice("h", F.col("a") + 1, F.col("b") - F.col("a") + 1))
    slim = materialise(_chunks(docs).select("doc_id", "_text_key", "a", "b", chunk_hash.alias("_h")), "line-chunks")
    # dealt by row key once: the fetch of chunk texts and the removal read the same shuffle
    other = {c: f"_other{i}" for i, c in enumerate(own) if c not in ("doc_id", "text")}
    rows = (docs.select("doc_id", "text", *[F.col(c).alias(name) for c, name in other.items()])
            .withColumn("_text_key", F.xxhash64("text")).withColumn("_key", _key()).repartition("_key"))
    spans = _per_row(_repeated_spans(slim, rows), "_spans", "a", "b")
    lines = F.split(F.col("r.text"), "\n", -1)
    found = rows.alias("r").join(spans.alias("w"), _same_row("r", "w"), "left").select(
        "r.doc_id", "r.text", *[f"r.{name}" for name in other.values()], lines.alias("_lines"),
        F.expr("array_distinct(flatten(transform(w._spans, s -> sequence(s.a, s.b))))").alias("_gone"))
    left = F.expr("array_except(sequence(0, size(_lines) - 1), _gone)")
    new = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    return found.select(
        *[new.alias("text") if c == "text" else F.col(other.get(c, c)).alias(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_removed"))
