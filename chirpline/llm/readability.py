"""Reading level of the English prose in notebooks.

Sentence lengths and syllable counts go into several classic grade formulas; a document's grade is
their median, over the whole of its prose. Where ratings exist, cut points turn grades into bands.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.session import checkpoint

# Frequent function words by language, to tell which one a prose is in.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be are this by not or from at we you if when which can have has but an each its these where",
    "fr": "le la les des une et est dans que qui pour pas sur avec par ce cette nous vous sont au aux du en ne plus ou mais chaque puis",
    "de": "der die das und ist nicht ein eine mit auf für den dem des wir sie es zu von im sind auch aber wenn wird jede dann oder",
    "es": "el la los las una y es en que por para con del se no un lo como más pero al su son cada luego está cuando este",
    "pt": "o a os as um uma e é em que para com do da não se no na dos das por mais mas como ao são cada depois está quando",
    "fi": "ja on ei se että oli olla ovat kun mutta myös tämä niin kuin joka sen ole tai jos sitten",
    "it": "il lo la gli le di che è un una per non con del della sono nel si ma come più al ogni poi questo",
    "nl": "de het een en van is dat niet op te in met voor zijn er maar ook als wordt elke dan wij",
}
WORD_LISTS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_MATH = re.compile(r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+\$")
_CODE = re.compile(r"`[^`\n]*`")
_IMAGE = re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)")
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)")
_TAG = re.compile(r"(?s)<!--.*?-->|<[A-Za-z/][^>\n]*>")
_URL = re.compile(r"(?:https?://|www\.)\S+|data:[a-z]+/\S+")
_ESCAPE = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_NOT_PROSE = re.compile(r"[ \t]*(?:#|\||(?:[-=*_][ \t]*){3,}$)")
_MARKER = re.compile(r"^[ \t]*(?:>[ \t]*)*(?:[-*+] +|\d{1,3}[.)] +)?")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9])|\n{2,}")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

_VOWELS = re.compile(r"[aeiouyàâäáãéèêëíîïóôöõúùûü]+")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of a lower-case English word by hyphenation-style rules; at least one."""
    n = len(_VOWELS.findall(word))
    n -= bool(re.search(r"[^aeiouyl]e$", word)) or bool(re.search(r"[aeiouy]le$", word))
    n -= bool(re.search(r"[^aeioutdy]ed$", word))
    n -= bool(re.search(r"[^aeiouyscxzg]es$", word)) and not word.endswith(("ches", "shes", "les"))
    n += len(re.findall(r"(?<![cstgx])i[aou]", word)) + len(re.findall(r"[aeiou]ing$|ism$|uou|eous$|[aeiou]ity$", word))
    return max(1, n)


def prose_of(cell: str, commented: bool) -> str:
    """The running text of a markdown cell: no headings, tables, code, formulas, images, links' targets or tags.

    ``commented``: the export put ``# `` before each line, which is taken off first.
    """
    if commented:
        cell = "\n".join(x[2:] if x.startswith("# ") else x[1:] if x.startswith("#") else x for x in cell.split("\n"))
    for pattern, to in ((_ESCAPE, ""), (_FENCE, "\n"), (_MATH, " "), (_CODE, " "), (_IMAGE, " "), (_LINK, r"\1"), (_TAG, " "), (_URL, " ")):
        cell = pattern.sub(to, cell)
    lines = ["" if _NOT_PROSE.match(x) else _MARKER.sub("", x) for x in cell.split("\n")]
    return "\n".join(lines).strip()


def language_of(words: list[str]) -> str | None:
    """The language whose function words are the most frequent among the words; None without any."""
    best, most = None, 0
    for lang, known in WORD_LISTS.items():
        n = sum(w in known for w in words)
        if n > most:
            best, most = lang, n
    return best if most >= 0.08 * len(words) else None


NAMES = ("sentences", "words", "letters", "syllables", "complex_words", "long_words", "easy_words")


def counts_of(prose: str) -> tuple[int, ...]:
    """The counts named in ``NAMES`` of one text; sentences without a word don't count."""
    total = np.zeros(len(NAMES), dtype=np.int64)
    for sentence in _SENTENCE.split(prose):
        words = [w.lower() for w in _WORD.findall(sentence or "")]
        if not words:
            continue
        syl = [syllables(w) for w in words]
        total += (1, len(words), sum(map(len, words)), sum(syl), sum(s >= 3 for s in syl), sum(len(w) > 6 for w in words), sum(s == 1 for s in syl))
    return tuple(int(x) for x in total)


def grades(c: dict[str, Column]) -> list[Column]:
    """School-grade estimates of six classic formulas from the counts."""
    s, w = (F.nullif(c[n].cast("double"), F.lit(0.0)) for n in ("sentences", "words"))
    per = lambda a, b: c[a].cast("double") / b
    return [
        0.39 * w / s + 11.8 * per("syllables", w) - 15.59,  # Flesch-Kincaid
        0.4 * (w / s + 100 * per("complex_words", w)),  # Gunning fog
        1.043 * F.sqrt(30 * per("complex_words", s)) + 3.1291,  # SMOG
        5.88 * per("letters", w) - 29.6 * s / w - 15.8,  # Coleman-Liau
        4.71 * per("letters", w) + 0.5 * w / s - 21.43,  # automated readability index
        20 - 15 * per("easy_words", w),  # FORCAST, for 150 words
    ]


def _cell_texts() -> Column:
    """The bodies of the markdown cells in order; a cell that starts outside the text is empty.

    Code points are found by their place in bytes, one for each in a text of single bytes and four
    in UTF-32 otherwise, so that a long notebook isn't walked through anew for every cell.
    """
    markdown = F.filter(F.col("cells"), lambda c: (F.lower(F.trim(c["kind"])) == "markdown") & (c["char_from"] >= 0) & (c["char_len"] > 0))
    text = F.col("text")

    def bodies(width: int, charset: str) -> Column:
        at = lambda c, name: F.least(c[name], F.lit(500_000_000)) * F.lit(width)
        return F.transform(F.array(F.encode(text, charset)), lambda raw: F.transform(markdown, lambda c: F.decode(F.substring(raw, at(c, "char_from") + 1, at(c, "char_len")), charset)))[0]

    plain = F.when(F.octet_length(text) == F.char_length(text), bodies(1, "UTF-8")).otherwise(bodies(4, "UTF-32"))
    return F.coalesce(plain, F.array().cast("array<string>"))


def prose_counts(documents: DataFrame) -> DataFrame:
    """Language and counts of each document's markdown prose: (doc_id, language, the counts of ``NAMES``).

    The cells are cut out in the JVM, so outputs and code never reach Python. A document without
    text, cells or prose has language null and zero counts. Whole cells count, whatever their length.
    """
    cells = documents.select("doc_id", _cell_texts().alias("prose"), F.coalesce(F.col("text").contains("# %% ["), F.lit(False)).alias("commented"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cells_, commented in zip(pdf["prose"], pdf["commented"]):
                prose = "\n\n".join(prose_of(c, commented) for c in cells_)
                language = language_of([w.lower() for w in _WORD.findall(prose)])
                # the formulas are for English; other prose isn't counted
                rows.append((language, *(counts_of(prose) if language == "en" else (0,) * len(NAMES))))
            out = pd.DataFrame(rows, columns=["language", *NAMES], index=pdf.index)
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    return cells.mapInPandas(run, "doc_id long, language string, " + ", ".join(f"{n} long" for n in NAMES))


def document_grades(documents: DataFrame) -> DataFrame:
    """The reading grade of each document with English prose: (doc_id, grade, words, sentences, the grades).

    The grade is the median of the six formulas over the prose as a whole.
    """
    counts = prose_counts(documents).where("language = 'en' and words > 0 and sentences > 0")
    g = counts.withColumn("grades", F.array(*grades({n: F.col(n) for n in NAMES})))
    s = F.array_sort("grades")
    return g.select("doc_id", ((s[2] + s[3]) / 2).alias("grade"), "words", "sentences", "grades")


# Cut points where no ratings tell: the usual ends of primary, middle and high school and of college, in school years.
DEFAULT_CUTS = (5.0, 8.0, 12.0, 16.0)


def _rising(medians: dict[int, float]) -> dict[int, float]:
    """The medians by band, neighbours that don't rise joined to their mean."""
    groups: list[list] = []
    for band in sorted(medians):
        groups.append([medians[band], [band]])
        while len(groups) > 1 and groups[-2][0] >= groups[-1][0]:
            (m1, b1), (m2, b2) = groups.pop(-2), groups.pop()
            groups.append([(m1 * len(b1) + m2 * len(b2)) / (len(b1) + len(b2)), b1 + b2])
    return {band: m for m, bands in groups for band in bands}


def fit_cuts(graded: DataFrame, ratings: DataFrame, max_rated: int = 5000) -> tuple[tuple[float, ...], int]:
    """Cut points between bands 1 to 5 from the grades of rated documents, and how many of the four the ratings tell.

    At most ``max_rated`` rated documents are used, the first by a hash of doc_id. A document's
    band is the mean of its ratings from 1 to 5, rounded; null and other ratings don't count. Each
    cut lies halfway between the median grades of the neighbouring bands; medians that don't rise
    are joined to their mean first. Between bands that aren't both rated the default cut holds,
    raised to the cut below it.
    """
    rated = ratings.where("doc_id is not null and band between 1 and 5").groupBy("doc_id").agg(F.avg("band").alias("mean"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    both = graded.join(sample, "doc_id")
    medians = _rising({r.band: r.m for r in both.groupBy(F.round("mean").cast("int").alias("band")).agg(F.percentile("grade", F.lit(0.5)).alias("m")).collect()})
    cuts, told = [], 0
    for b in range(1, 5):
        known = b in medians and b + 1 in medians
        told += known
        cuts.append(max((medians[b] + medians[b + 1]) / 2 if known else DEFAULT_CUTS[b - 1], *cuts[-1:], -math.inf))
    return tuple(cuts), told


def reading_levels(documents: DataFrame, ratings: DataFrame, max_rated: int = 5000) -> DataFrame:
    """The band from 1 to 5 of each document with English prose: (doc_id, grade, band, words, sentences, fitted_cuts).

    The documents are read once: their grades are written, a small table, and read for the cut
    points and for the bands. fitted_cuts tells how many of the four cuts the ratings gave.
    """
    graded = checkpoint(document_grades(documents).select("doc_id", "grade", "words", "sentences"))
    cuts, told = fit_cuts(graded, ratings, max_rated)
    band = F.lit(1).cast("int")
    for c in cuts:
        band = band + (F.col("grade") >= c).cast("int")
    return graded.select("doc_id", "grade", band.alias("band"), "words", "sentences", F.lit(told).alias("fitted_cuts"))
