"""Queries of the operators for language-model data: p7 to p9."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chirpline.llm import bpe, leakage, readability
from chirpline.session import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_windows(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_item"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(p8_windows(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Exact leaks: aligned passages in which the slot check finds no changed word."""
    return leakage.exact_leaks(p8_windows(spark, d))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(table(spark, d, "documents"), table(spark, d, "level_label"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("band >= 4").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p7_ids, p8_found, p8_windows, p8_leaks, p9_found, p9_levels)
}

# Words of a text in SQL. It has no NFKC, but NFC; the single letters and digits of Latin-1 and of the full-width forms are translated beside it.
_COMPATIBLE = [c for c in map(chr, [*range(0xA0, 0x100), *range(0xFF10, 0xFF5B)]) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c and n.isalnum()]
_PLAIN = unicodedata.normalize("NFKC", "".join(_COMPATIBLE))
NORMAL = f"translate(nfc_normalize(text), '{''.join(_COMPATIBLE)}', '{_PLAIN}')"
CASED = rf"list_filter(regexp_split_to_array({NORMAL}, '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"
WORDS = CASED.replace(NORMAL, f"lower({NORMAL})")
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
_NUMBER = rf"(regexp_full_match(w, '\p{{Nd}}+') OR w IN {_LIST(leakage.NUMBER_WORDS)})"
# Windows of template words in SQL. A letter before a blank is doubled, so that names in a row are all found behind one.
LEAKED = rf"""i AS (SELECT DISTINCT item_id, text, {WORDS} AS w FROM eval_item WHERE item_id IS NOT NULL AND text IS NOT NULL),
        d AS (SELECT DISTINCT doc_id, {WORDS} AS w, {CASED} AS c FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        names AS (SELECT DISTINCT lower(unnest(regexp_extract_all(regexp_replace({NORMAL}, '([a-z,]) ', '\1 \1 ', 'g'), '[a-z,] ([A-ZÀ-Þ]\p{{L}}+)', 1))) AS w FROM i),
        vocabulary AS (SELECT w, CASE WHEN {_NUMBER} THEN '#number' WHEN w IN {_LIST(leakage.UNITS)} THEN '#unit' WHEN w IN (FROM names) THEN '#name' ELSE w END AS t FROM (SELECT DISTINCT unnest(w) AS w FROM i)),
        iw AS (SELECT item_id, pos, w, t FROM (SELECT item_id, unnest(w) AS w, unnest(range(0, len(w))) AS pos FROM i) JOIN vocabulary USING (w)),
        dw AS (SELECT doc_id, pos, w, CASE WHEN t IS NOT NULL THEN t WHEN {_NUMBER} THEN '#number' WHEN w IN {_LIST(leakage.UNITS)} THEN '#unit' WHEN upper(c[1]) = c[1] AND lower(c[1]) <> c[1] THEN '#name' END AS t
          FROM (SELECT doc_id, unnest(w) AS w, unnest(c) AS c, unnest(range(0, len(w))) AS pos FROM d WHERE len(w) = len(c)) LEFT JOIN vocabulary USING (w)),
        ix AS (SELECT item_id, pos AS item_at, list(w) OVER k AS item_words, list(t) OVER k AS t, count(*) OVER k AS n FROM iw WINDOW k AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
        dx AS (SELECT doc_id, pos AS doc_at, list(w) OVER k AS words, list(t) OVER k AS t, count(t) OVER k AS n FROM dw WINDOW k AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
        leaked AS (SELECT doc_id, CAST(doc_at AS INTEGER) AS doc_at, item_id, CAST(item_at AS INTEGER) AS item_at, words, item_words FROM dx JOIN ix USING (t) WHERE dx.n = 12 AND ix.n = 12)"""

ORACLES: dict[str, str] = {
    "p8_found": f"""
        WITH d AS (SELECT DISTINCT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        i AS (SELECT DISTINCT item_id, {WORDS} AS w FROM eval_item WHERE item_id IS NOT NULL AND text IS NOT NULL),
        wi AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS words FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
        wd AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM wd JOIN wi USING (words)""",
    "p8_windows": f"WITH {LEAKED} SELECT doc_id, doc_at, item_id, item_at, words, item_words FROM leaked",
    "p8_leaks": f"""
        WITH {LEAKED}, x AS (SELECT doc_id, item_id, doc_at - item_at AS shift, list_filter(list_zip(item_words, words), lambda p: p[1] <> p[2]) AS changed FROM leaked),
        y AS (SELECT * FROM x WHERE len(changed) <= 7),
        s AS (SELECT doc_id, item_id, shift, count(*) AS n, count(DISTINCT p[1]) AS a, count(DISTINCT p[2]) AS b FROM (SELECT DISTINCT doc_id, item_id, shift, unnest(changed) AS p FROM y) GROUP BY 1, 2, 3),
        g AS (SELECT doc_id, item_id, shift, count(*) FILTER (WHERE len(changed) = 0) AS exact, count(*) FILTER (WHERE len(changed) > 0) AS template FROM y GROUP BY 1, 2, 3),
        c AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(n = a AND n = b, true) AS same FROM g LEFT JOIN s USING (doc_id, item_id, shift))
        SELECT doc_id, item_id, CAST(sum(exact) AS BIGINT) AS exact_windows, CAST(sum(CASE WHEN same THEN template ELSE 0 END) AS BIGINT) AS template_windows, max(CASE WHEN same THEN n ELSE 0 END) AS changed_slots
        FROM c GROUP BY 1, 2 HAVING sum(exact) > 0 OR sum(CASE WHEN same THEN template ELSE 0 END) > 0""",
}
