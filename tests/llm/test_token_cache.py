import hashlib
import random
import tempfile

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cauce.llm import token_cache as C  # noqa: E402

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library():
    rng = random.Random(4)
    count = C.counter(MODEL)
    pieces = ["a", "the", " ", "  ", "   ", "\n", "\t", "▁", "▁▁", "é", "日本", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", " a", "b ", "…", "Word",
              " ", "\U0001f600", "x" * 50]
    texts = ["".join(rng.choices(pieces, k=rng.choice([1, 2, 5, 30, 300]))) for _ in range(600)] + ["", " ", "  ", " a ", "a b ", "\n \n"]
    same = [t.replace("▁", " ") for t in texts]
    assert count(same) == [len(SP.encode(t)) for t in texts]
    assert C.words_of("a  b ") == ["a", " b", ""]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "MEMORY_WORDS", 5)
    count = C.counter(MODEL)
    texts = [" ".join(f"w{i * j % 17}" for i in range(20)) for j in range(9)]
    assert count(texts) == [len(SP.encode(t)) for t in texts]


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.cached) for r in df.collect()), key=str)


@pytest.mark.parametrize("path", [MODEL, JSON])
def test_cache_is_used_and_grows(spark, path):
    cache = tempfile.mkdtemp(prefix="cauce-test-cache-")
    tok = Tokenizer.from_file(JSON)
    length = (lambda t: len(SP.encode(t))) if path == MODEL else (lambda t: len(tok.encode(t, add_special_tokens=False).ids))
    old = [(1, "one text", 0), (2, None, 0), (3, "one text", 0), (None, "", 0), (4, "Ä  b\n<s> <|endoftext|>", 0)]
    new = [*old, (5, "another", 1), (5, "another", 1), (6, "z" * 30_000, 1), (7, "word " * 20_000, 1)]
    schema = "doc_id bigint, text string, digest int"

    def expected(rows, known):
        return sorted(((i, len((t or "").encode()), length(t or ""), (t or "") in known) for i, t, _ in rows), key=str)

    first = C.token_counts(spark.createDataFrame(old, schema), path, cache)
    assert rows_of(first) == expected(old, set())
    known = {t or "" for _, t, _ in old}
    second = C.token_counts(spark.createDataFrame(new, schema), path, cache)
    assert rows_of(second) == expected(new, known)
    version = C.version_of(path)
    assert C.stored_counts(spark, cache, version).count() == len({t or "" for _, t, _ in new})
    third = C.token_counts(spark.createDataFrame(new, schema), path, cache)
    assert all(r.cached for r in third.collect()) and rows_of(third) == expected(new, {t or "" for _, t, _ in new})


def test_only_misses_are_encoded_and_the_cache_is_believed(spark):
    cache = tempfile.mkdtemp(prefix="cauce-test-cache-")
    version = C.version_of(MODEL)
    digest = hashlib.sha256(b"planted").digest()
    for _ in range(2):  # stored twice, as by two calls at the same time
        spark.createDataFrame([(bytearray(digest), 777)], C.STORED).write.mode("append").parquet(f"{cache}/{version}/p")
    half = spark.createDataFrame([(bytearray(b"x" * 32), 1)], C.STORED)
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{cache}/{version}/half")
    docs = spark.createDataFrame([(1, "planted"), (2, "not planted"), (3, "planted")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_tokens, r.cached) for r in C.token_counts(docs, MODEL, cache).collect()}
    assert got == {1: (777, True), 3: (777, True), 2: (len(SP.encode("not planted")), False)}
    assert C.stored_counts(spark, cache, version).count() == 2  # the uncommitted append is not read


def test_empty_table(spark):
    assert C.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), MODEL).count() == 0
