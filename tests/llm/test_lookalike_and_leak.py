"""Look-alike texts and leaked passages against brute force."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracewright.llm import leak, lookalike
from tracewright.llm.fold import PAIRS, fold, fold_column, strip_markup

SCHEMA = "doc_id long, text string, extra string, class_id long"


def frame(spark, texts):
    return spark.createDataFrame([(i, x, "e", 0) for i, x in enumerate(texts)], SCHEMA)


def pairs(spark, texts):
    return sorted(tuple(r) for r in lookalike.lookalike_pairs(frame(spark, texts)).collect())


def test_kinds_of_likeness(spark):
    texts = ["café no", "café no", "ｃａｆé no", "cаfé no", "caf​é no", "café no"]
    n = len(texts)
    assert pairs(spark, texts) == [(i, j) for i in range(n) for j in range(i + 1, n)]


@pytest.mark.parametrize("other", ["CAFÉ 2", "cafe 2", "café ²", "café  2", "café\n2", "café 2"])
def test_what_a_reader_sees_is_no_pair(spark, other):
    assert pairs(spark, ["café 2", other]) == []


def test_characters_above_the_basic_plane(spark):
    text = "cafe\u0301 \U0001f9fa \U0001d465\U000e0041\U000e007f 2"
    assert fold(text) == "caf\u00e9 \U0001f9fa \U0001d465 2"
    df = spark.createDataFrame([(text,)], "text string").select(fold_column(F.col("text")).alias("v"))
    assert unicodedata.normalize("NFC", df.first().v) == fold(text)


def test_edges(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, [None, "", None, "​", "x" * 50_000]) == [(1, 3)]
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "а"), (2, "а")], "doc_id long, text string")
    assert [tuple(r) for r in lookalike.lookalike_pairs(twice).collect()] == [(1, 2)]


def test_many_copies_of_one_text(spark):
    texts = ["a b"] * 40 + ["a b"] + ["c d"] * 30
    assert pairs(spark, texts) == [(i, 40) for i in range(40)]


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    swap = {"a": "а", "e": "е", " ": " ", "é": "é", "o": "ｏ"}
    base = ["la casa é ora", "le rose", "oé ae", "e a o"]
    texts = ["".join(swap[c] if c in swap and rng.random() < 0.3 else c for c in rng.choice(base)) for _ in range(60)]
    expected = [(i, j) for i in range(60) for j in range(i + 1, 60) if texts[i] != texts[j] and fold(texts[i]) == fold(texts[j])]
    assert pairs(spark, texts) == expected


def test_forms_are_equal_within_a_class(spark):
    texts = ["éa", "éa", "É", None, ""]
    rows = {r.doc_id: (r.class_id, r.canonical_text) for r in lookalike.canonical_forms(frame(spark, texts)).collect()}
    assert rows[0] == rows[1] and rows[0][0] == 0
    assert rows[2] == (None, "É") and rows[3] == (None, None) and rows[4] == (None, "")


def test_fold_is_the_same_in_python_and_spark(spark):
    texts = ["ＡＢ１＂", "мама", "a­b⁠c﻿", "ﬁne ½ m²", "tab\tline\n", "\u0004x"]
    got = [r.v for r in frame(spark, texts).orderBy("doc_id").select(fold_column(F.col("text")).alias("v")).collect()]
    assert [unicodedata.normalize("NFC", x) for x in got] == [fold(x) for x in texts]
    assert strip_markup("<p>a&nbsp;b</p>c<b>d</b>") == "\na b\ncd"


def test_table_against_public_confusables(spark):
    """The letters of some scripts against the confusables data in the ICU library that Spark brings."""
    skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    letters = {}
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        letters.setdefault(skeleton(c), []).append(c)
    # drawn alike only in some fonts, or known as other letters to any reader
    seen = set("ͺσϒϱгѡҽӏագզռքᏳꓒ")
    for first, last in ((0x370, 0x590), (0x13A0, 0x13F5), (0x2160, 0x2180), (0xA4D0, 0xA4F8)):
        for c in map(chr, range(first, last)):
            like = [x for x in letters.get(skeleton(c), []) if x.isupper() == c.isupper() or first == 0xA4D0 or first == 0x13A0]
            if like and c.isalpha() | (first == 0x2160) and c not in seen and unicodedata.normalize("NFD", c) == c:
                assert PAIRS.get(c) in letters[skeleton(c)], (c, like)


def test_new_scripts(spark):
    assert pairs(spark, ["LISU TEXT \u00a3", "\ua4e1\ua4f2\ua4e2\ua4f4 \ua4d4\ua4f0\ua4eb\ua4d4 \uffe1", "\u216cISU TEXT \u00a3"]) == [(0, 1), (0, 2), (1, 2)]
    assert pairs(spark, ["bold x", "bold \U0001d431"]) == []


def test_copies_are_not_compared(spark):
    """A text in a thousand copies and one variant: as many pairs as copies."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "\u0430 b").otherwise("a b").alias("text"))
    assert lookalike.lookalike_pairs(df).count() == 2999


# Leaks.


def leaks(spark, docs, items, m=4, **kw):
    d = spark.createDataFrame([(i, x, "x") for i, x in enumerate(docs)], "doc_id long, text string, item_id string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, problem string")
    return {(r.doc_id, r.item_id): r.match_words for r in leak.leaked_passages(d, t, min_words=m, **kw).collect()}


def brute(docs, items, m):
    out = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            a, b = leak.words(d), leak.words(t)
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
            if best >= m:
                out[i, j] = best
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs, items = [make(rng.randrange(30)) for _ in range(25)], [make(rng.randrange(12)) for _ in range(8)]
    assert leaks(spark, docs, items, 5) == brute(docs, items, 5)
    assert leaks(spark, docs, items, 5, block_chars=10) == brute(docs, items, 5)


def test_leak_in_other_clothes(spark):
    item = "The Cat sat, on the mat; near 45 m."
    docs = ["<p>THE CAT SAT ON<br>the mаt</p> near $45$ m", "x the cat sat on the mat y", "the cat sat", None, ""]
    assert leaks(spark, docs, [item], 5) == {(0, 0): 9, (1, 0): 6}


def test_leak_of_high_characters(spark):
    assert leaks(spark, ["\U0001f600 a b \U000e0041c d e"], ["a b c d e"]) == {(0, 0): 5}


def test_leak_edges(spark):
    assert leaks(spark, [], ["a b c d e"]) == {}
    assert leaks(spark, ["a b c d e"], []) == {}
    assert leaks(spark, ["a b c d e"] * 2, [None, "a b", "a b c d e"]) == {(0, 2): 5, (1, 2): 5}


def test_leak_report_and_clean(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "z")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "a b c d"), (8, "q q q q")], "item_id long, problem string")
    found = leak.leaked_passages(docs, tests, min_words=4)
    assert [r.doc_id for r in leak.without_leaks(docs, found).collect()] == [2]
    assert sorted((r.item_id, r.documents) for r in leak.leak_report(found, tests).collect()) == [(7, 1), (8, 0)]
