"""Passages of evaluation items in a corpus, also with other numbers, names or units filled in.

Words are put into template form: numbers, names and units become typed placeholders. Windows of
consecutive template words are joined by hash; the words that fill the placeholders then tell
whether a passage was copied as it is or re-parameterised consistently.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.session import checkpoint

WINDOW = 12
# What may go to every worker, and the sizes of the filters in bits.
MAX_BYTES = 64 << 20
FEW_BITS, MANY_BITS = 1 << 20, 1 << 27
SALTS = 16
# Words for numbers and units that a template leaves open.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth hundred thousand".split()
)
UNITS = frozenset("s sec seconds second min minutes h hours ms hz khz mhz db m cm mm km metres meters g kg mg l ml percent degrees".split())
NUMBER, NAME, UNIT = "\0number", "\0name", "\0unit"

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_KEEP_CASE = bytes(c if c >= 128 or chr(c).isalnum() and c < 128 else 32 for c in range(256))
_B = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.array([pow(int(_B), k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


@lru_cache(maxsize=4096)
def _separates(c: str) -> bool:
    return not (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Maximal runs of letters and digits after NFKC and lower-casing, as UTF-8; null has none."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII if lower else _KEEP_CASE).split()
    text = unicodedata.normalize("NFKC", text)
    if lower:
        text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c >= "\x80" and _separates(c):
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_ASCII if lower else _KEEP_CASE).split()


def _id(template_word: str) -> int:
    return int.from_bytes(blake2b(template_word.encode(), digest_size=8).digest(), "little") or 1


_NUMBER_ID, _NAME_ID, _UNIT_ID = _id(NUMBER), _id(NAME), _id(UNIT)


def names_in(text: str | None) -> set[str]:
    """Words that stand capitalised inside a sentence, lower-cased."""
    return {m.lower() for m in re.findall(r"(?<=[a-z,] )([A-ZÀ-Þ][^\W\d_]+)", unicodedata.normalize("NFKC", text or ""))}


def template_id(word: str, names: frozenset[str]) -> int:
    """The id of a word's template form; it depends on the lower-case word alone."""
    if word.isdecimal() or word in NUMBER_WORDS:
        return _NUMBER_ID
    if word in UNITS:
        return _UNIT_ID
    return _NAME_ID if word in names else _id(word)


def _hashes(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out += ids[starts + k] * _POWERS[k]
    return out.view(np.int64)


class WindowFilter:
    """Which hashes may be those of items' windows: the sorted hashes themselves or, where they are too many, a field of bits that lets some others through."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None = None):
        self.hashes, self.bits = hashes, bits
        if hashes is not None:
            self.bits = np.zeros(FEW_BITS >> 3, dtype=np.uint8)
            at = hashes & (FEW_BITS - 1)
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.mask = len(self.bits) * 8 - 1

    def passes(self, h: np.ndarray) -> np.ndarray:
        """The places in ``h`` of the hashes that pass."""
        at = h & self.mask
        kept = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        if self.hashes is not None and len(kept):
            found = np.minimum(np.searchsorted(self.hashes, h[kept]), len(self.hashes) - 1)
            kept = kept[self.hashes[found] == h[kept]]
        return kept


class Templates:
    """The template ids of the items' words and the filter of their windows."""

    def __init__(self, words: dict[bytes, int], filter_: WindowFilter):
        # number words and units have one id, whether items have them or not
        self.words, self.filter = words | _CLOSED, filter_

    def windows(self, text: str | None) -> Iterator[tuple[int, int, list[str]]]:
        """(position, hash, words) of the windows of a text that may be those of an item.

        A word that no item has can only fill a placeholder: as a number, a unit or a capitalised
        word. Windows that hold an unknown word of another kind are passed over.
        """
        words = words_of(text)
        n = len(words) - WINDOW + 1
        if n <= 0:
            return
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], dtype=np.uint64)
        open_ = np.flatnonzero(ids == 0)
        if len(open_):
            cased = words_of(text, lower=False)
            cased = cased if len(cased) == len(words) else words
            ids[open_] = [_placeholder(words[i], cased[i]) for i in open_.tolist()]
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        starts = np.flatnonzero(unknown[WINDOW:] == unknown[:-WINDOW])
        h = _hashes(ids, starts)
        kept = self.filter.passes(h)
        starts, h = starts[kept], h[kept]
        for s, x in zip(starts.tolist(), h.tolist()):
            yield s, x, _text(words[s : s + WINDOW])


_CLOSED = {w.encode(): template_id(w, frozenset()) for w in NUMBER_WORDS | UNITS}


def _placeholder(word: bytes, cased: bytes) -> int:
    """The id of the placeholder that a word fills which no item has, 0 if none."""
    if word.isdigit() or (not word.isascii() and word.decode("utf-8", "replace").isdecimal()):
        return _NUMBER_ID
    upper = 65 <= cased[0] <= 90 if cased[0] < 128 else cased.decode("utf-8", "replace")[0].isupper()
    return _NAME_ID if upper else 0


def _text(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words]


ITEM_SCHEMA = "item_id long, item_at int, h long, item_words array<string>"
DOCUMENT_SCHEMA = "doc_id long, doc_at int, h long, words array<string>"
ITEM_NAMES, DOCUMENT_NAMES = (["item_id", "item_at", "h", "item_words"], ["doc_id", "doc_at", "h", "words"])
_WINDOW_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _vocabulary(texts: DataFrame) -> DataFrame:
    """The words of the items, each once, and whether one of them has it as a name: (word, is_name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, bool], None] = {}
            for t in b.column("text").to_pylist():
                found |= dict.fromkeys((w.decode("utf-8", "replace"), False) for w in words_of(t))
                found |= dict.fromkeys((w, True) for w in names_in(t))
            yield _batch(list(found), ["word", "is_name"], [pa.string(), pa.bool_()])

    w = texts.select("text").mapInArrow(run, "word string, is_name boolean")
    return w.groupBy("word").agg(F.max("is_name").alias("is_name"), F.min("is_name").alias("only_name")).where("not only_name").drop("only_name")


def _with_known(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, text) with the words of each text that items have, and the names among them: (id, text, known, names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                yield _batch([(key, w.decode("utf-8", "replace")) for w in dict.fromkeys(words_of(t))], ["key", "word"], [pa.string(), pa.string()])

    # equal texts share a key, which doesn't depend on how the input is cut into tasks
    keyed = texts.where("text is not null").withColumn("key", F.sha2("text", 256))
    words = keyed.select("key", "text").mapInArrow(run, "key string, word string").distinct().join(vocabulary, "word")
    known = words.groupBy("key").agg(F.collect_list("word").alias("known"), F.collect_list(F.when(F.col("is_name"), F.col("word"))).alias("names"))
    return keyed.join(known, "key", "left").drop("key")


def _hash_bits(windows: DataFrame) -> np.ndarray:
    """The lowest bits of all hashes as one field of ``MANY_BITS`` bits; it is made of blocks of a kilobyte and has the same size for any number of windows."""
    at = F.col("h").bitwiseAND(F.lit(MANY_BITS - 1))
    blocks = windows.select(F.shiftright(at, 13).cast("int").alias("block"), at.bitwiseAND(F.lit(8191)).cast("int").alias("bit")).distinct()

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros(8192, dtype=np.uint8)
        field[pdf["bit"]] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(field, bitorder="little").tobytes()]})

    bits = np.zeros((MANY_BITS >> 13, 1024), dtype=np.uint8)
    for r in blocks.groupBy("block").applyInPandas(pack, "block int, bits binary").toLocalIterator():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def leaked_windows(documents: DataFrame, items: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Windows of documents whose template is that of an item's window: (doc_id, doc_at, item_id, item_at, words, item_words).

    The items' windows are made by the workers and written once. Only windows of documents that
    pass a filter of the items' hashes leave their worker, so what is shuffled follows the leaks
    and not the corpus. Each thing that goes to all workers is measured first: the hashes up to
    ``max_bytes``, beyond it a field of bits of fixed size; the items' vocabulary up to
    ``max_bytes``, beyond it each text meets its own words of it in a join; the items' windows up
    to ``max_bytes``, beyond it both sides meet in a shuffle, in which each hash is spread over
    ``SALTS`` tasks, so that an instruction line that most items share is no hot key. The rows are
    the same on all ways. Each text is read as a whole. Null or short texts have no window;
    repeated items and documents give repeated rows.
    """
    spark = documents.sparkSession
    texts = items.select("item_id", "text").where("item_id is not null and text is not null")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = checkpoint(_vocabulary(texts))
    # a word in a dictionary takes about 200 bytes more than its letters
    words = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    held = None
    if words.b + 200 * words.n <= max_bytes:
        rows = vocabulary.collect()
        names = frozenset(r.word for r in rows if r.is_name)
        held = spark.sparkContext.broadcast({r.word.encode("utf-8", "surrogatepass"): template_id(r.word, names) for r in rows})

    def item_rows(item_id: int, text: str | None, known: dict[bytes, int]) -> list[tuple]:
        found = words_of(text)
        if len(found) < WINDOW:
            return []
        h = _hashes(np.array([known[w] for w in found], dtype=np.uint64), np.arange(len(found) - WINDOW + 1)).tolist()
        return [(item_id, i, x, _text(found[i : i + WINDOW])) for i, x in enumerate(h)]

    def own(known: list[str] | None, names: list[str] | None) -> dict[bytes, int]:
        as_names = frozenset(names or ())
        return {w.encode("utf-8", "surrogatepass"): template_id(w, as_names) for w in known or ()}

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            for k, (i, t) in enumerate(zip(rows["item_id"], rows["text"])):
                yield _batch(item_rows(i, t, held.value if held else own(rows["known"][k], rows["names"][k])), ITEM_NAMES, _WINDOW_KINDS)

    # written once: read for the measure, the filter and the join
    right = checkpoint((texts if held else _with_known(texts, vocabulary)).mapInArrow(of_items, ITEM_SCHEMA))
    size = right.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("item_words", " "))), F.lit(0)).alias("b")).first()
    if size.n * 8 <= max_bytes:
        shared = spark.sparkContext.broadcast((np.unique(np.array([r.h for r in right.select("h").distinct().collect()], dtype=np.int64)), None))
    else:
        shared = spark.sparkContext.broadcast((None, _hash_bits(right)))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = WindowFilter(*shared.value)
        templates = Templates(held.value, filter_) if held else None
        for b in batches:
            rows = b.to_pydict()
            out = []
            for k, (i, t) in enumerate(zip(rows["doc_id"], rows["text"])):
                own_templates = templates or Templates(own(rows["known"][k], rows["names"][k]), filter_)
                out += [(i, *w) for w in own_templates.windows(t)]
            yield _batch(out, DOCUMENT_NAMES, _WINDOW_KINDS)

    left = (docs if held else _with_known(docs, vocabulary)).mapInArrow(of_documents, DOCUMENT_SCHEMA)
    # a window takes twelve words, each with its length, in the joined table's rows
    if size.b + 160 * size.n <= max_bytes:
        return left.join(F.broadcast(right), "h").drop("h")
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_at"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("h", "salt")


def leaks(windows: DataFrame, min_literal: int = 5) -> DataFrame:
    """What leaked where: (doc_id, item_id, exact_windows, template_windows, changed_slots).

    The slot check: along one alignment of a document and an item, each word of the item that
    changed always became the same word of the document and the other way round. A window is
    exact if no slot changed. The others count where the check holds and at least ``min_literal``
    words besides the changed ones agree. The windows of an alignment, at most as many as the
    item has, meet in one aggregation; those of repeated rows count again.
    """
    pairs = F.arrays_zip(F.col("item_words").alias("a"), F.col("words").alias("b"))
    w = windows.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift"), F.filter(pairs, lambda x: x["a"] != x["b"]).alias("changed"))
    w = w.where(F.size("changed") <= WINDOW - min_literal)
    exact = F.size("changed") == 0
    aligned = w.groupBy("doc_id", "item_id", "shift").agg(
        F.sum(exact.cast("long")).alias("exact"), F.sum((~exact).cast("long")).alias("template"), F.array_distinct(F.flatten(F.collect_set("changed"))).alias("slots")
    )
    n = F.size("slots")
    consistent = (F.size(F.array_distinct("slots.a")) == n) & (F.size(F.array_distinct("slots.b")) == n)
    return (
        aligned.groupBy("doc_id", "item_id")
        .agg(F.sum("exact").alias("exact_windows"), F.sum(F.when(consistent, F.col("template")).otherwise(0)).alias("template_windows"), F.max(F.when(consistent, n).otherwise(0)).cast("long").alias("changed_slots"))
        .where("exact_windows > 0 or template_windows > 0")
    )


def exact_leaks(windows: DataFrame) -> DataFrame:
    """Documents with an item's window in which the slot check finds no changed word: (doc_id, item_id)."""
    return leaks(windows).where("exact_windows > 0").select("doc_id", "item_id")
