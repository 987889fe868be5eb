"""BPE encoding and decoding with a given tokenizer file, by tree concatenation.

The tokenizer (a ``tokenizers`` JSON file with a BPE model) drops white space,
so a text is cut at ASCII white space into runs, and equal runs are encoded
once per worker.  A run without white space can be as long as the text itself
(a table of digits, base64, a script that writes no spaces); BPE over such a
run is done as a tree: the run's long pre-tokens are cut into leaves of
``LEAF`` symbols, the leaves are encoded together, and halves are joined pair
by pair.  A join re-encodes a window of tokens around the cut and grows it
until its outer tokens agree with both halves exactly; tokens outside the
window are then final, because a BPE encoding is fixed by which neighbouring
tokens may stand side by side.

Defined cases: null and empty texts have no tokens and decode to ``""``;
strings of special tokens inside a text are encoded as these tokens, as the
library does with ``add_special_tokens=False``; repeated rows each get their
row; columns named like the added ones are replaced.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cauce.llm.common import ship
from cauce.llm.textnum import blocks, parts_of, release, utf8

#: Symbols of a leaf of the tree; pre-tokens up to this length are encoded at once.
LEAF = 2048
#: Tokens of each side in the first window around a join, and tokens that must agree on each side.
WINDOW, AGREE = 8, 2
#: Runs kept per worker with their encoding, and the longest run kept.
CACHE_RUNS, CACHE_BYTES = 150_000, 64
#: Threads that encode the leaves of a long word.
LEAF_THREADS = 2
#: Text bytes per output batch.
BATCH_BYTES = 1 << 21


_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _ends_word(head: bytes) -> bool:
    """Whether the last character is a letter or an ASCII digit."""
    if head[-1] < 128:
        return head[-1:].isalnum()
    return head[-4:].decode("utf-8", "ignore")[-1:].isalpha()


class TreeEncoder:
    """Encoder and decoder of one tokenizer file; results equal the library's own."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mark = next(iter(self.special))
        self.path = path
        self._inner = None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.width = [len(t.removesuffix(self.suffix) if self.suffix else t) for t in self.tokens]
        self.leaf = leaf
        self.special_in = re.compile(b"|".join(re.escape(m.encode()) for m in self.special)).search
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        # whether a run of a-z is one pre-token that the model takes as it stands
        steps = json.dumps(spec["pre_tokenizer"])
        self.plain_words = self.lowers and "p{L}]+" in steps and '"add_prefix_space": false' in steps
        self.cache: dict[bytes, tuple[bytes, str]] = {}

    # ---------------------------------------------------------------- pieces
    @property
    def inner(self):
        """The model for pieces that end inside a word: without end-of-word marks (made when first needed)."""
        if self._inner is None:
            from tokenizers import models

            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self._inner = models.BPE(vocab=model["vocab"], merges=merges)
        return self._inner

    def _piece(self, text: str, last: bool) -> list[int]:
        return [t.id for t in (self.tok.model if last else self.inner).tokenize(text)]

    def _join(self, text: str, a: int, b: int, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encoding of ``text[a:b]`` from the encodings of its two parts; ``last``: b ends the word."""
        k = WINDOW
        while True:
            kl, kr = min(k, len(left)), min(k, len(right))
            lo = b - sum(self.width[i] for i in right) - sum(self.width[i] for i in left[len(left) - kl:])
            hi = b - sum(self.width[i] for i in right[kr:])
            window = self._piece(text[lo:hi], last and kr == len(right))
            at_start, at_end = kl == len(left), kr == len(right)
            n = min(AGREE, kl, kr)
            same_left = at_start or window[:n] == left[len(left) - kl:len(left) - kl + n]
            same_right = at_end or window[-n:] == right[kr - n:kr]
            if same_left and same_right and (len(window) >= 2 * n or (at_start and at_end)):
                return left[:len(left) - kl] + window + right[kr:]
            k *= 2

    def long_word(self, text: str) -> list[int]:
        """Encoding of one long pre-token (already mapped to byte symbols)."""
        cuts = list(range(0, len(text), self.leaf))
        parts = [(a, min(a + self.leaf, len(text))) for a in cuts]
        with ThreadPoolExecutor(LEAF_THREADS) as pool:
            codes = list(pool.map(lambda p: self._piece(text[p[0]:p[1]], p[1] == len(text)), parts))
        while len(parts) > 1:  # one level of the tree
            spans, joined = [], []
            for i in range(0, len(parts) - 1, 2):
                a, b = parts[i][0], parts[i + 1][1]
                joined.append(self._join(text, a, b, codes[i], codes[i + 1], b == len(text)))
                spans.append((a, b))
            if len(parts) % 2:
                spans.append(parts[-1])
                joined.append(codes[-1])
            parts, codes = spans, joined
        return codes[0]

    def _long_run(self, run: str) -> list[int]:
        """Encoding of a long run without white space, pre-token by pre-token."""
        out: list[int] = []
        at = 0
        while at < len(run):
            found = [(p, -len(s), s) for s in self.special if (p := run.find(s, at)) >= 0]
            end, _, mark = min(found, default=(len(run), 0, ""))
            if end > at:
                part = run[at:end]
                if self.tok.normalizer is not None:
                    part = self.tok.normalizer.normalize_str(part)
                for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(part):
                    out += self.long_word(word) if len(word) > self.leaf else self._piece(word, True)
            if mark:
                out.append(self.special[mark])
            at = end + len(mark) if mark else len(run)
        return out

    # ----------------------------------------------------------------- texts
    def _learn(self, runs: list[bytes]) -> dict[bytes, tuple[bytes, str]]:
        """Encodings of runs: int32 ids as bytes, and their decoding."""
        mark = self.mark.encode()  # a special token stands between runs
        ids = {r: self._long_run(r.decode()) for r in runs if len(r) > self.leaf or mark in r}
        plain, tokenize = {}, self.tok.model.tokenize
        if self.plain_words:
            plain = {r: [t.id for t in tokenize(r.decode())] for r in runs
                     if r.isalpha() and r.isascii() and r.islower() and len(r) <= self.leaf}
        short = [r for r in runs if r not in ids and r not in plain]
        groups = [short[i:i + 256] for i in range(0, len(short), 256)]
        # many runs in one call, told apart by a special token that none of them contains
        glue = f" {self.mark} ".encode()
        codes = self.tok.encode_batch_fast([glue.join(g).decode() for g in groups], add_special_tokens=False)
        stop, tokens = self.special[self.mark], self.tokens
        new = {r: (array("i", i).tobytes(), " ".join([tokens[x] for x in i])) for part in (ids, plain) for r, i in part.items()}
        for group, code in zip(groups, codes, strict=True):
            flat = array("i", code.ids)
            words = " ".join([tokens[x] for x in flat]).split(f" {self.mark} ") if len(group) > 1 else None
            at = 0
            for n, r in enumerate(group):
                end = flat.index(stop, at) if n + 1 < len(group) else len(flat)
                new[r] = (flat[at:end].tobytes(),
                          words[n] if words and len(words) == len(group) else " ".join([tokens[x] for x in flat[at:end]]))
                at = end + 1
        return new

    def _complete(self, runs: set[bytes]) -> list[bytes]:
        """Put the encodings of all runs into the cache; returns those too long to stay there.

        A run that ends in ASCII punctuation after a letter or digit is two pre-tokens or more, and its
        encoding is that of the part before followed by that of the punctuation.
        """
        cache = self.cache
        missing, parts = set(), []
        new = runs - cache.keys()
        for r in new:
            head = r.rstrip(_PUNCTUATION)
            if head and len(head) < len(r) <= self.leaf and _ends_word(head) and not self.special_in(r):
                tail = r[len(head):]
                parts.append((r, head, tail))
                missing.add(head)
                missing.add(tail)
            else:
                missing.add(r)
        cache.update(self._learn(list(missing - cache.keys())))
        for r, head, tail in parts:
            (a, b), (c, d) = cache[head], cache[tail]
            cache[r] = (a + c, f"{b} {d}")
        return [r for r in new | missing if len(r) > CACHE_BYTES]

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[str]]:
        """Ids (int32 bytes) and decoded text of each UTF-8 text."""
        if self.lowers:  # the tokenizer lowers letters itself, after it has looked for special tokens
            lowered = [t.lower() for t in texts]
            texts = [t if self.special_in(low) else low for t, low in zip(texts, lowered, strict=True)]
        split = [t.split() for t in texts]
        passing = self._complete(set().union(*split))
        find, first, second = self.cache.__getitem__, itemgetter(0), itemgetter(1)
        ids, decoded = [], []
        for words in split:
            found = list(map(find, words))
            ids.append(b"".join(map(first, found)))
            decoded.append(" ".join(filter(None, map(second, found))))
        for r in passing:
            del self.cache[r]
        if len(self.cache) > CACHE_RUNS:  # frequent runs are in every batch: keep this one's
            self.cache = {r: v for r in set().union(*split) if (v := self.cache.get(r))}
        return ids, decoded


_encoders: dict[tuple[str, int], TreeEncoder] = {}


def encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    """The worker's encoder of this file."""
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = TreeEncoder(path, leaf)
    return _encoders[path, leaf]


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) and ``decoded`` (string) added, in one narrow pass."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    source, at = docs.select(*keep), keep.index(text)
    schema = source.schema
    schema = T.StructType([*schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for batch in (part for whole in batches for part in parts_of(whole)):
            column = utf8(batch.column(at))
            for i, j in blocks(column, BATCH_BYTES):
                ids, decoded = enc.encode(column[i:j])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.string())],
                    names=[*keep, "token_ids", "decoded"])
        enc.cache = {}  # the worker outlives the task
        release()

    return source.mapInArrow(run, schema)


def decode_ids(path: str, ids: list[int]) -> str:
    """Decoded text of ids, special tokens included (no decoder in the file: tokens joined by a space)."""
    return encoder(path).tok.decode(ids, skip_special_tokens=False)
