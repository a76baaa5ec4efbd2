"""Exact byte-level BPE encoding of a corpus with a public vocabulary.

Instead of merging pairs, each prefix of a word gets its last token by dynamic programming. An
automaton over the vocabulary lists the tokens that end at each position; exactly one of them
belongs to the encoding of the prefix, namely the one that is compatible with the last token of
the prefix it leaves, and the back-pointers give the ids. Two tokens are compatible if encoding
their joined bytes gives back the two.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: the public word pattern of this vocabulary, with white space spelled out.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# Bounds of what a Python worker remembers; beyond them it starts afresh, which changes no result.
CACHE_WORDS = 400_000
CACHE_PAIRS = 2_000_000
# Words that are held as Python strings and ids at once, but for those of a longer text.
SLICE_WORDS = 400_000
# A vocabulary file goes to every worker.
MAX_VOCABULARY = 32 << 20
TOKENIZERS = "/opt/tokenizers"


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("CHIRPLINE_TOKENIZERS", TOKENIZERS), f"{name}.tiktoken")


class PrefixEncoder:
    """Encoder of single words over a vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._split: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, vocabulary: bytes) -> PrefixEncoder:
        """From the content of a vocabulary file: lines of a token in base 64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())})

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte gives itself twice.

        The merge that makes a token is its last, so its parts are what its bytes encode to with
        the tokens of lower rank alone.
        """
        found = self._split.get(token)
        if found is None:
            parts = [bytes([x]) for x in self.tokens[token]]
            while len(parts) > 2:
                pairs = [(self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(pairs)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
            self._split[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the tokens stay apart when their bytes are encoded together.

        Both are taken apart from the outside in, in the reverse order of their merges. They fit
        if at no point of that history a merge over the border was due before the next one inside.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is not None:
            return known
        a, b, before = left, right, len(self.tokens) + 1
        while True:
            over = self.ranks.get(self.tokens[a] + self.tokens[b])
            if over is not None and over < before:
                known = False
                break
            inner_a, inner_b = self.split(a), self.split(b)
            single_a, single_b = inner_a[0] == inner_a[1] == a, inner_b[0] == inner_b[1] == b
            if single_a and single_b:
                known = True
                break
            # the later of the two merges is undone; on equal ranks the left one was made first
            if not single_a and (single_b or a > b):
                before, a = a, inner_a[1]
            else:
                before, b = b + 1, inner_b[0]
        if len(self._fits) >= CACHE_PAIRS:
            self._fits.clear()
        self._fits[key] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        last, known = [-1] * (n + 1), self._fits.get
        for end, (length, token) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if length == end:
                last[end] = token
                continue
            left = last[end - length]
            if left >= 0:
                fits = known(left << 32 | token)
                if fits or (fits is None and self.fits(left, token)):
                    last[end] = token
        ids, at, tokens = [], n, self.tokens
        if last[n] < 0:
            raise ValueError(f"the vocabulary has no tokens for {word[:40]!r}")
        while at:
            ids.append(last[at])
            at -= len(tokens[last[at]])
        return ids[::-1]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, flat, and how many each has. Frequent words come from a bounded cache."""
        cache, out = self._cache, []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8"))
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(w) <= 64:
                    cache[w] = ids
            out.append(ids)
        counts = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        flat = np.fromiter((i for ids in out for i in ids), dtype=np.int32, count=int(counts.sum()))
        return flat, counts


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> PrefixEncoder:
    """One encoder a worker and vocabulary, with what it remembers."""
    return PrefixEncoder.parse(vocabulary)


def words_of(text: Column) -> Column:
    """The words of the vocabulary's pattern; null gives none. They join to the whole text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _encode_batch(encoder: PrefixEncoder, words: pa.ListArray) -> pa.ListArray:
    offsets = np.asarray(words.offsets)
    flat = words.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    ids, counts = encoder.encode_words(flat.dictionary.to_pylist())
    at = np.asarray(flat.indices, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    n = counts[at]
    ends = np.concatenate(([0], np.cumsum(n)))
    take = np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]].astype(np.int32)), pa.array(ids[take]))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_WORDS`` words, from the places where the rows' words begin."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_WORDS, "right")) - 1)
        yield start, end
        start = end


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add the ids of every text, without special tokens; null and empty texts get an empty list.

    The words are cut in the JVM, whose Arrow batches are bounded in bytes; Python takes slices of
    about ``SLICE_WORDS`` words, sees the distinct ones once, encodes those it doesn't know yet and
    gathers the ids of the texts with array arithmetic. Nothing is shuffled, whole texts are
    encoded, and strings of special tokens are ordinary text. Bytes that the vocabulary has no
    token for fail the call. The driver reads the vocabulary file, which may have ``MAX_VOCABULARY``
    bytes, and sends it to the workers. A column of the name ``out`` in the input is replaced.
    """
    with open(path or vocabulary_path(), "rb") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY} bytes")
    shared = df.sparkSession.sparkContext.broadcast(content)
    cut = df.withColumn(out, words_of(F.col(text))).drop(*([text] if text != out else []))
    fields = [f for f in cut.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for whole in batches:
            for start, end in _slices(np.asarray(whole.column(out).offsets)):
                batch = whole.slice(start, end - start)
                columns = [batch.column(f.name) for f in fields] + [_encode_batch(encoder, batch.column(out))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), out])

    return cut.select(*[f"`{f.name}`" for f in fields], out).mapInArrow(run, schema)
