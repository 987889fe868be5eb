import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cauce.llm import bpe  # noqa: E402
from cauce.llm.queries import token_digests  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
REF = Tokenizer.from_file(PATH)
PIECES = ["a", "Á", "ë", " ", "\n", "<|endoftext|>", "<|startoftext|>", "　", "'s", "\x1c", "<|ENDOFTEXT|>", "...", "é.", "́",
          "E", "1", "٣", "…", "日本", "%%%", "\x85", "<|", "|>"]


def expected(text):
    ids = REF.encode(text, add_special_tokens=False).ids
    return ids, REF.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [16, 100, 2048])
def test_random_texts_equal_the_library(leaf):
    rng = random.Random(leaf)
    enc = bpe.TreeEncoder(PATH, leaf)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "thesandionr", "aab", "0123456789abc", "日本語あいうえ漢字", "!?-.,*#$%'", PIECES]
    for _ in range(150):
        alphabet = rng.choice(alphabets)
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 30, 400, 4000])))
        ids, decoded = enc.encode([text.encode()])
        assert (np.frombuffer(ids[0], np.int32).tolist(), decoded[0]) == expected(text)


def test_long_word_needs_the_tree():
    enc = bpe.TreeEncoder(PATH, 64)
    word = "".join(random.Random(1).choices("etaoinshrdlu", k=20_000))
    ids, _ = enc.encode([word.encode()])
    assert np.frombuffer(ids[0], np.int32).tolist() == expected(word)[0]


def test_cache_generations_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_RUNS", 3)
    enc = bpe.TreeEncoder(PATH)
    texts = [f"word{i} some text, {'x' * 90}." for i in range(20)]
    for i in range(0, 20, 5):
        ids, _ = enc.encode([t.encode() for t in texts[i:i + 5]])
        assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [expected(t)[0] for t in texts[i:i + 5]]
    assert all(len(r) <= bpe.CACHE_BYTES for r in enc.cache)


def test_documents(spark):
    rows = [(1, None, "k"), (2, "", None), (3, "Hello, World!", "x"), (3, "Hello, World!", "x"), (None, "a " * 50_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.encode_documents(docs, PATH)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    for r in out.collect():
        assert (r["token_ids"], r["decoded"]) == expected(r["text"] or "")
        if r["token_ids"]:
            assert bpe.decode_ids(PATH, r["token_ids"]) == r["decoded"]
    for r in token_digests(out).collect():
        ids, decoded = expected({x[0]: x[1] for x in rows}[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
