"""The operators for language-model data against libraries, brute force and at their edges."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.llm import bpe, leakage, readability

TEXTS = [
    "Hello world, it's 2024!", "", None, "  \n\n\tindent x　y ", "naïve café ßtraße 雨が降る 🙂🙂 مرحبا", "<|endoftext|> is text", "a" * 3000, "-" * 257 + "=" * 99, "x_y __init__ 3.14e-10 \r\n \r\n",
    "UE5HU8DX8u3KNvg2Zz/1if6/6NE+I4rOjO8yP20X+Hs48FvgrRalVQWq", "I'd've  we'll DON'T 'tis", "\x00\x01\x7f​ ﻿", "½²Ⅷ ٣٤ ०१", "é́́ é",
]


@pytest.fixture(scope="module")
def vocabulary():
    path = bpe.vocabulary_path()
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    return path


def test_encode_equals_the_public_library(spark, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(vocabulary.replace(".tiktoken", ".json"))
    tok.encode_special_tokens = True
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("abcXYZ 019'\n.-_éß雨") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert bpe.encode(df).columns == ["doc_id", "ids"]
    assert bpe.encode(df.limit(0)).count() == 0


def test_encoder_on_bytes(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    enc = bpe.PrefixEncoder.load(vocabulary)
    core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=enc.ranks, special_tokens={})
    rnd = random.Random(2)
    for _ in range(3000):
        word = bytes(rnd.choices(b"abcdefghij =-_ theTHE\xc3\xa9\xff", k=rnd.randint(1, 30)))
        ids = enc.encode_word(word)
        assert b"".join(enc.tokens[i] for i in ids) == word
        assert ids == core._core_bpe.encode_single_piece(word)


def test_small_bounds_change_nothing(spark, vocabulary, monkeypatch):
    words = [f" w{i}ord{i % 7}" for i in range(500)] * 2
    whole = [x.tolist() for x in bpe.PrefixEncoder.load(vocabulary).encode_words(words)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 10)
    assert [x.tolist() for x in bpe.PrefixEncoder.load(vocabulary).encode_words(words)] == whole
    for offsets in ([0, 0], [0], [0, 3, 3, 9, 30, 31, 31]):
        monkeypatch.setattr(bpe, "SLICE_WORDS", 5)
        slices = list(bpe._slices(np.array(offsets)))
        assert [r for a, b in slices for r in range(a, b)] == list(range(len(offsets) - 1))
        assert all(b == a + 1 or offsets[b] - offsets[a] <= 5 for a, b in slices)


def test_bytes_without_token_are_refused():
    encoder = bpe.PrefixEncoder({b"a": 0, b"b": 1})
    assert encoder.encode_word(b"ab") == [0, 1]
    with pytest.raises(ValueError):
        encoder.encode_word(b"axb")


def plain_words(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").lower())


ITEMS = [
    (1, "Read the passage.\n\nThat restless tinker of Pell Crossing twice overlooked 198 hollow candles behind the orchard although the ninth sealed barometers flooded at dusk."),
    (2, "The ÉLAN of São Belmar ﬁnally copied 12 km of rope from the old mill and then nobody counted it again, said Ostravelle."),
    (3, "too short"), (4, None), (5, "one two three four five six seven eight nine ten eleven twelve"),
]


def documents():
    body = ITEMS[0][1].split("\n\n")[1]
    return [
        (1, "noise " * 20 + body + " more"), (2, body.upper()), (3, "\n".join(f"# {w}" for w in body.split())), (4, " ".join(body.split()[:12])), (5, " ".join(body.split()[:11])),
        (6, body.replace("twice", "twice really")), (7, body.replace("198", "4711").replace("Pell", "Quill").replace("ninth", "third")), (8, None), (9, ""), (10, ITEMS[1][1].replace("ﬁ", "fi").lower()),
        (11, ITEMS[4][1]), (12, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (13, "word " * 200_000 + body), (14, body + " " + ITEMS[1][1]), (15, body.replace(" ", "_")), (16, body.replace("Pell", "Quill").replace("198", "4711").replace("ninth", "third") + " " + body),
    ]


@pytest.mark.parametrize("max_bytes", [leakage.MAX_BYTES, 40_000, 0])
def test_exact_leaks_against_brute_force(spark, max_bytes):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in documents() * 2], "doc_id long, text string, words string, h long")
    items = spark.createDataFrame([(i, "s", t, 1) for i, t in ITEMS * 2], "item_id long, suite string, text string, h long")
    got = {tuple(r) for r in leakage.exact_leaks(leakage.leaked_windows(docs, items, max_bytes=max_bytes)).collect()}
    want = set()
    for i, text in documents():
        w = plain_words(text)
        spans = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for j, t in ITEMS:
            v = plain_words(t)
            if any(tuple(v[k : k + 12]) in spans for k in range(len(v) - 11)):
                want.add((i, j))
    assert got == want and {(1, 1), (2, 1), (3, 1), (4, 1), (10, 2), (13, 1)} <= want
    assert leakage.exact_leaks(leakage.leaked_windows(docs.limit(0), items)).count() == 0
    assert leakage.exact_leaks(leakage.leaked_windows(docs, items.limit(0))).count() == 0


def test_reparameterised_copy_is_found(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    items = spark.createDataFrame([(i, "s", t) for i, t in ITEMS], "item_id long, suite string, text string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(leakage.leaked_windows(docs, items)).collect()}
    r = got[(7, 1)]
    assert r.template_windows > 0 and r.changed_slots >= 3
    assert got[(1, 1)].exact_windows > 0 and (12, 1) not in got


def test_window_of_many_new_names_and_numbers_is_found(spark):
    item = "we heard that Anton of Lindau sold 41 hens and 52 geese to Maria near Passau before 1887"
    copy = "we heard that Bruno of Xanten sold 77 hens and 93 geese to Greta near Zwickau before 2044"
    docs = spark.createDataFrame([(1, copy), (2, copy.lower())], "doc_id long, text string")
    items = spark.createDataFrame([(1, "s", item)], "item_id long, suite string, text string")
    got = leakage.leaked_windows(docs, items)
    # some windows have five new words
    assert {r.doc_at for r in got.collect()} == set(range(18 - 11))
    assert {(r.doc_id, r.template_windows, r.changed_slots) for r in leakage.leaks(got).collect()} == {(1, 7, 7)}


def test_large_path_gives_the_same_rows(spark):
    docs = spark.createDataFrame(documents() + [(17, ITEMS[0][1].replace("Pell", "Quill")), (17, ITEMS[0][1].replace("Pell", "Quill"))], "doc_id long, text string")
    items = spark.createDataFrame([(i, "s", t) for i, t in ITEMS * 2], "item_id long, suite string, text string")
    small, large = (sorted(map(str, leakage.leaked_windows(docs, items, max_bytes=n).collect())) for n in (leakage.MAX_BYTES, 0))
    assert small == large and any("quill" in r for r in large)


def test_recall_of_reparameterised_copies(spark, data):
    """Items with all their numbers and inner names replaced one to one, planted in noise: at least 0.9 are found, and nothing where nothing was planted."""
    rnd = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/eval_item.parquet").collect()]
    docs, planted = [], set()
    for k, (item_id, text) in enumerate(items):
        fresh = {}
        new_name = lambda m: fresh.setdefault(m[0], "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)).capitalize() + "q")
        changed = re.sub(r"(?<=[a-z,] )[A-ZÀ-Þ][^\W\d_]+", new_name, text)
        changed = re.sub(r"\d+", lambda m: fresh.setdefault(m[0], str(rnd.randint(10_000, 99_999))), changed)
        docs += [(2 * k, "intro " * 30 + changed + " outro" * 30), (2 * k + 1, "nothing to find in these lines of prose " * 40)]
        if len(fresh) > 0:
            planted.add((2 * k, item_id))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(leakage.leaked_windows(df, it)).collect()}
    found = sum(p in got and got[p].changed_slots > 0 for p in planted)
    assert found >= 0.9 * len(planted) and not any(doc % 2 for doc, _ in got)


def test_shared_line_on_the_salted_way(spark):
    line = "please read all of the following passage and then answer every single question below"
    items = spark.createDataFrame([(i, f"{line} number {i}") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x {line} y") for i in range(40)], "doc_id long, text string")
    got = [tuple(r) for r in leakage.exact_leaks(leakage.leaked_windows(docs, items, max_bytes=0)).collect()]
    assert len(got) == len(set(got)) == 1200


@pytest.mark.parametrize("name", ["p8_found", "p8_windows", "p8_leaks"])
def test_sql_of_leaks(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    from chirpline.llm import plans

    con = duckdb.connect()
    for t in ("documents", "eval_item"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = plans.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    got = [str(tuple(r)) for r in found.select(*columns).collect()]
    assert sorted(got) == sorted(str(r) for r in con.sql(plans.ORACLES[name]).select(*columns).fetchall()) and got


def test_words_of_equals_the_definition():
    rnd = random.Random(4)
    alphabet = "aZ09 _-.\n\tßéİŉﬁ²½Ⅷ٣雨ー́​🙂"
    for _ in range(500):
        t = "".join(rnd.choice(alphabet) for _ in range(30))
        w = unicodedata.normalize("NFKC", t).lower()
        want = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in w).split()
        assert [x.decode() for x in leakage.words_of(t)] == want


@pytest.mark.parametrize("word, n", [("the", 1), ("model", 2), ("recording", 3), ("table", 2), ("closed", 1), ("wanted", 2), ("identify", 4), ("a", 1), ("make", 1), ("propagation", 4), ("reverberation", 5), ("systematic", 4)])
def test_syllables(word, n):
    assert readability.syllables(word) == n


EASY = "We read the map. It is a good day. You can cut it too. The sun is out. I like the old sound more. "
HARD = (
    "Notwithstanding the asymptotic commensurability of the estimation procedure, whose sensitivity depends upon assumptions that practitioners rarely disambiguate, "
    "the inference inferred from such recordings remains a fundamentally counterfactual quantity. Methodological sensitivity necessitates environmental reinterpretation. "
)
GERMAN = "Der Sensor ist nicht gleich und die Aufnahme wird mit dem Filter auf eine Frequenz gesetzt. "


def notebook(doc_id, cells, prefix=""):
    text, out = "", []
    for kind, body in cells:
        out.append((kind, None, len(text), len(body)))
        text += body + "\n"
    return (doc_id, text, out, "clash")


DOC = "doc_id long, text string, cells array<struct<kind:string,exec_count:int,char_from:int,char_len:int>>, grade string"


def test_reading_levels(spark):
    rows = [
        notebook(1, [("markdown", EASY * 3)]), notebook(2, [("markdown", "# Methodological considerations\n" + HARD * 2), ("code", EASY * 50)]), notebook(3, [("markdown", GERMAN * 5)]),
        notebook(4, [("code", HARD), ("output", HARD)]), notebook(5, [("markdown", "")]), (6, None, None, "c"), (7, "", [], "c"), (8, "abc", [("markdown", None, 500, 10), ("markdown", None, None, None), (None, None, 0, 3)], "c"),
        notebook(9, [("markdown", "雨 " + EASY * 2), ("markdown", "```\n" + HARD * 3 + "\n```\n| " + HARD + " |")]), notebook(10, [("markdown", EASY * 20_000)]), notebook(11, [("markdown", HARD)]),
    ]
    docs = spark.createDataFrame(rows + rows[:1], DOC)
    ratings = spark.createDataFrame([(1, "r", 1), (2, "r", 5), (2, "s", None), (None, "r", 3), (999, "r", 4)], "doc_id long, rater string, band int")
    got = {r.doc_id: r for r in readability.reading_levels(docs, ratings).collect()}
    assert set(got) == {1, 2, 9, 10, 11}
    assert got[1].band <= 2 and got[9].band <= 2 and got[10].band <= 2 and got[2].band >= 4 and got[11].band >= 4
    assert abs(got[1].grade - got[10].grade) < 0.5
    assert readability.reading_levels(docs.limit(0), ratings.limit(0)).count() == 0
    assert readability.fit_cuts(readability.document_grades(docs), ratings) == (readability.DEFAULT_CUTS, 0)
    assert {r.fitted_cuts for r in got.values()} == {0}


def test_cells_are_cut_by_code_points(spark):
    text = "a雨🙂é plain " * 30
    spans = [(2_000_000_000, 2_000_000_000), (0, 4), (2, 1), (len(text) - 3, 50), (len(text) + 5, 4), (-1, 3), (3, 0)]
    rows = [(i, t, [("Markdown ", None, a, n) for a, n in spans], None) for i, t in enumerate([text, "plain words " * 30])]
    got = spark.createDataFrame(rows, DOC).select("text", readability._cell_texts().alias("c")).collect()
    for r in got:
        assert r.c == [r.text[a : a + n] for a, n in spans if a >= 0 and n > 0]


def test_cuts_of_partly_rated_bands(spark):
    graded = spark.createDataFrame([(i, float(g)) for i, g in enumerate([1, 3, 9, 7, 30])], "doc_id long, grade double")
    ratings = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 9)], "doc_id long, band int")
    assert readability.fit_cuts(graded, ratings) == ((2.0, 5.5, 8.0, 16.0), 3)


def test_commented_layout_is_the_same_prose():
    body = "## Setup\n\n" + EASY.replace(". ", ".\n") + "\n- an item\n"
    commented = "\n".join("# " + x if x else "#" for x in body.split("\n"))
    assert readability.prose_of(commented, True) == readability.prose_of(body, False)
    assert "Setup" not in readability.prose_of(body, False)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs, ratings = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "level_label"))
    fit, held = ratings.where("doc_id % 2 = 0"), ratings.where("doc_id % 2 = 1")
    mean = held.where("band is not null").groupBy("doc_id").agg(F.avg("band").alias("m"))
    both = readability.reading_levels(docs, fit).join(mean, "doc_id").select((F.col("band") >= 4).alias("got"), (F.col("m") >= 3.5).alias("want")).collect()
    assert np.mean([r.got == r.want for r in both]) >= 0.9


def test_commit_boundary():
    """Nothing outside this subpackage imports it, but the driver's entry, which may."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "chirpline")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "chirpline.llm" not in f.read(), n
