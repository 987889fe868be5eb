"""Token counts through a digest cache.

A text's count depends on its normalised content and on the tokenizer alone, so
counts are kept by (version, digest): the version is the SHA-256 of the
vocabulary file, the library's name and release; the digest is the SHA-256 of
the normalised text.  A call joins the digests of all rows to the stored counts,
encodes one text of each digest that is missing, appends those counts and reads
every row's count from the cache.

* Normalisation is only what no count can see: null becomes the empty text, and
  for sentencepiece models the space sign U+2581, which the library puts in place
  of every space, becomes a space.
* Misses: a digest of one row is encoded where the row is; the rows of repeated or
  stored digests (told by a broadcast set of at most ``FILTER_BUCKETS`` hash
  buckets) are reduced to one text per digest by a partial aggregate.
* Appending: every call writes a new folder below ``cache/version``, and readers
  take the folders whose write was committed.  Two calls that miss the same text
  at the same time store it twice with the same count; readers group by digest.
  So a lost executor, driver or call leaves no wrong count behind.
* Encoding: a sentencepiece vocabulary without a piece in which a space follows
  another character cannot join what stands on both sides of such a place, so
  texts are cut there and each distinct word is encoded once per worker.  Other
  vocabularies and ``.json`` tokenizers get whole texts.

Defined cases: null and empty texts have no bytes and no tokens; special strings
inside texts are ordinary text unless the library's default says otherwise; repeated
rows and null ids are rows like any other; an empty table gives an empty result.
Of ``docs`` only ``doc_id`` and ``text`` are read; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.llm.common import materialise, salt_of, salted_lookup, scratch_path, ship
from cauce.llm.textnum import parts_of, release

#: Hash buckets of the broadcast set of digests that are repeated or stored.
FILTER_BUCKETS = 1 << 18
#: Words that a worker remembers, and the longest of them.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 40

SPACE_SIGN = "▁"
STORED = "digest binary, n_tokens bigint"


# ------------------------------------------------------------------ encoding
def _splits_at_spaces(path: str) -> bool:
    """Whether a sentencepiece model gives the same pieces when a text is cut before its runs of spaces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    joins = any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p.piece) or p.type == pb.ModelProto.SentencePiece.USER_DEFINED
                for p in model.pieces)
    return (model.trainer_spec.model_type == pb.TrainerSpec.BPE and not joins and not rules.precompiled_charsmap
            and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix)


def words_of(text: str) -> list[str]:
    """A text cut before its runs of spaces, each word without the space that the library puts before it; '' is a lone space."""
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    found = re.findall(" +[^ ]*|[^ ]+", text)
    return found[:1] + [word[1:] for word in found[1:]]


def _word_counter(model) -> Callable[[list[str]], list[int]]:
    lone = 1 if model.piece_to_id(SPACE_SIGN) != model.unk_id() else len(SPACE_SIGN.encode())
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            words = words_of(text)
            new = [w for w in set(words) if w and w not in known]
            if len(known) + len(new) > MEMORY_WORDS:
                known.clear()
                new = [w for w in set(words) if w]
            known[""] = lone
            found = dict(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
            if len(found) < MEMORY_WORDS:
                known.update((w, n) for w, n in found.items() if len(w) <= MEMORY_CHARS)
            out.append(sum(found[w] if w in found else known[w] for w in words) if found else sum(map(known.__getitem__, words)))
        return out

    return count


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if _splits_at_spaces(path):
            return _word_counter(model)
        return lambda texts: [len(model.encode(t, num_threads=1)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def version_of(path: str) -> str:
    """Digest that names a vocabulary together with the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def normalised(text: str | Column, path: str) -> Column:
    """The text as the cache sees it: equal values have equal counts."""
    whole = F.coalesce(text, F.lit(""))
    return F.replace(whole, F.lit(SPACE_SIGN), F.lit(" ")) if path.endswith(".model") and _splits_at_spaces(path) else whole


# --------------------------------------------------------------------- cache
def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the committed appends of a version, each digest once."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{cache}/{version}/*/_SUCCESS")
    marks = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    parts = [m.getPath().getParent().toString() for m in marks]
    if not parts:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*parts).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _append(misses: DataFrame, cache: str, version: str, path: str) -> None:
    """Encode (digest, text) rows and append their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in (p for batch in batches for p in parts_of(batch)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())],
                                             names=["digest", "n_tokens"])
        release()

    misses.select("digest", "text").mapInArrow(run, STORED).write.parquet(f"{cache}/{version}/{uuid.uuid4().hex}")


def token_counts(docs: DataFrame, vocabulary: str, cache: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, digest, n_tokens and cached (whether the count was stored before).

    ``vocabulary`` is the path of a ``.model`` or ``.json`` file that driver and executors hold alike.
    ``cache`` is a folder that all machines share; without it the call starts an empty one in the
    application's scratch folder.
    """
    spark = docs.sparkSession
    ship(spark)
    cache = (cache or scratch_path(spark, "token-cache")).rstrip("/")
    version = version_of(vocabulary)
    text = normalised("text", vocabulary)
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BUCKETS)).cast("int").alias("bucket")

    keyed = materialise(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), digest),
                        "digests")
    before = stored_counts(spark, cache, version)
    digests = materialise(
        keyed.groupBy("digest").agg(F.count("*").alias("n")).join(before.select("digest", F.lit(True).alias("cached")), "digest", "left")
        .select("digest", "n", F.coalesce("cached", F.lit(False)).alias("cached")), "distinct")
    elsewhere = F.broadcast(digests.where("n > 1 OR cached").select(bucket).distinct())  # at most FILTER_BUCKETS rows
    texts = docs.select(digest, text.alias("text")).withColumn("bucket", bucket)
    alone = texts.join(elsewhere, "bucket", "left_anti").select("digest", "text")
    met = (texts.join(elsewhere, "bucket", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
           .join(digests.where("NOT cached").select("digest"), "digest", "left_semi").select("digest", "text"))
    _append(alone.unionByName(met), cache, version, vocabulary)

    counts = digests.join(stored_counts(spark, cache, version), "digest").select("digest", "n_tokens", "cached")
    found = salted_lookup(keyed.withColumn("_salt", salt_of("doc_id", "n_bytes")), counts, ["digest"], "_salt")
    return found.select("doc_id", "n_bytes", "digest", "n_tokens", "cached")
