"""Text operators against the Python functions they stand for."""

from __future__ import annotations

import re
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as t
from tracewright.operators import evaluators, features, instruct
from tracewright.operators import transforms as tr

TEXTS = [
    "", "   ", "a.  ", "One.Two. Three!  Four?", "no break space", "line\r\nend\rand more\n", "Straße am groß ÄNDERN they're x-y 12a3",
    "AND And and anD", "1. a\n2. b", "six apples", "Level, (noon) racecar! abba eve", "the cat. The dog: the bird\n\nthe end? the", "a  b   c", "a\n\nb\n\nc", "hmm, wait so, So",
    "The error is a Warning. Test!", "[a] [b]", "[a [b]]", "café thé end", "First point\n\nSecond point",
]


def run(spark, make, texts=TEXTS):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").repartition(1)
    return [r.v for r in df.select("i", make(F.col("text")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("make", "python"),
    [
        (t.words, lambda s: s.split()),
        (t.sentences, lambda s: re.split(r"(?<=[.!?])\s+", s)),
        (t.split_lines, lambda s: s.splitlines()),
        (t.strip, lambda s: s.strip()),
        (t.bare, lambda s: s.strip(string.punctuation)),
        (tr.upper_case, lambda s: s.upper()),
        (tr.lower_case, lambda s: s.lower()),
        (tr.title_case, lambda s: s.title()),
        (tr.one_word_per_line, lambda s: "\n".join(s.split())),
        (tr.use_multiple_spaces, lambda s: re.sub(" +", "   ", s)),
        (tr.commas_to_semicolons, lambda s: s.replace(",", ";")),
        (tr.full_stops_to_exclamation_marks, lambda s: re.sub(r"\.([ \n])", r"!\1", s)),
        (tr.add_line_numbers, lambda s: "\n".join(f"{i}: {x}" for i, x in enumerate(s.splitlines(), 1))),
        (tr.bracket_sentences, lambda s: " ".join(f"[{x}]" for x in re.split(r"(?<=[.!?])\s+", s))),
        (tr.indent_paragraphs, lambda s: "\n\n".join("\t" + x for x in s.split("\n\n"))),
        (tr.highlight_logical_words, lambda s: re.sub(rf"\b({'|'.join(tr.CONNECTORS)})\b", r"*\1*", s, flags=re.I)),
        (tr.replace_and_ampersand, lambda s: re.sub(r"\bAnd\b", "&", re.sub(r"\band\b", "&", s))),
        (tr.replace_words_with_emojis, lambda s: re.sub(r"\b\w+\b", lambda m: tr.EMOJIS.get(m[0].lower(), m[0]), s)),
        (tr.palindromes, lambda s: [w for w in (x.strip(string.punctuation) for x in s.split()) if len(w) > 3 and w.lower() == w.lower()[::-1]]),
        (features.unique_word_count, lambda s: len(set(s.lower().split()))),
        (tr.paragraph_count, lambda s: len([x for x in s.split("\n") if x.strip()])),
    ],
)
def test_like_python(spark, make, python):
    assert run(spark, make) == [python(x) for x in TEXTS]


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    row = df.select(*[f(F.col("text")).alias(n) for n, (f, _) in tr.FORWARD.items()]).first()
    assert all(v is None for n, v in row.asDict().items() if n != "json_of_paragraphs_forward")


def test_avoid_the(spark):
    assert run(spark, tr.avoid_the, ["the cat. The dog", "Breathe the air"]) == ["Cat. Dog", "Breathe air"]


def test_top_word_ties_go_to_the_first(spark):
    assert [tuple(x) if x else None for x in run(spark, tr.top_word, ["b a b a", "", "x"])] == [("b", 2), None, ("x", 1)]


def test_forward_then_evaluator(spark):
    """What a transform writes, its evaluator accepts, for the strict ones."""
    text = "So this is one. And the second, here! Is that all?"
    df = spark.createDataFrame([(text,)], "text string")
    names = "upper_case_forward lower_case_forward title_case_forward avoid_the_forward replace_and_ampersand_forward one_word_per_line_forward use_multiple_spaces_forward".split()
    names += "sentences_per_line_forward commas_to_semicolons_forward add_line_numbers_forward json_of_paragraphs_forward bracket_sentences_forward indent_paragraphs_forward".split()
    names += "highlight_logical_words_forward insert_sentence_divider_forward render_as_html_forward".split()
    made = df.select("text", *[tr.FORWARD[n][0](F.col("text")).alias(n) for n in names])
    scores = made.select(*[evaluators.EVALUATORS[n](F.col(n), F.col("text")).alias(n) for n in names]).first().asDict()
    assert scores == dict.fromkeys(names, 1)


def test_json_evaluator(spark):
    cases = ['{"paragraphs": []}', '{"paragraphs": [1]}', "[]", "{", "plain", '{"paragraphs": ["a"]}', None]
    assert run(spark, lambda c: evaluators.json_of_paragraphs(c, c), cases) == [1, 0, 0, 0, 0, 1, None]


def test_bracket_evaluator(spark):
    assert run(spark, lambda c: evaluators.bracket_sentences(c, c), ["[a] [b]", "[a [b]]", "[a]\n", ""]) == [1, 0, 0, 0]


def test_fan_out_gives_eight_or_nothing(spark):
    df = spark.createDataFrame([(1, "A first one, and the second. So it is the end.\n\nYes, that!"), (2, ""), (3, None)], "doc_id long, text string")
    rows = instruct.fan_out(df).collect()
    assert {r.doc_id for r in rows} == {1} and len(rows) == 8 and rows[0].function_name == "identity"


def test_acrostic_and_rhyme(spark):
    docs = spark.createDataFrame([(1, "We go. Over there. Run fast. Do it.")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("word",), ("ord",)], "word string")
    assert features.hidden_acrostics(docs, lexicon).first().hidden_acrostic == "word"
    lines = spark.createDataFrame([(1, 0, "cat"), (1, 1, "dog"), (1, 2, "hat"), (1, 3, "log")], "doc_id long, line_no int, last_word string")
    sounds = spark.createDataFrame([("cat", ["K", "AE", "T"]), ("hat", ["AE", "T"]), ("dog", ["AO", "G"]), ("log", ["AO", "G"])], "word string, phonemes array<string>")
    assert features.rhymes_abab(lines, sounds).first().rhymes is False


def test_html_is_judged_by_default(spark):
    rows = [("render_as_html_forward", "<p>a</p>"), ("render_as_html_forward", "<p>a"), ("render_as_html_forward", None), ("upper_case_forward", "<p>A"), ("unknown", "<p>a</p>")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, text string").repartition(1)
    got = df.select("i", evaluators.dispatch(F.col("name"), F.col("text"), F.col("text")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [1, 0, None, 0, None]


def test_every_forward_transform_is_in_the_matrix(spark):
    docs = spark.createDataFrame([(1, "First point\n\nSecond point.")], "doc_id long, text string")
    got = {r.function_name: r.accuracy for r in evaluators.forward_matrix(docs).collect()}
    assert set(got) == {n for n in tr.FORWARD if n in evaluators.EVALUATORS} and got["render_as_html_forward"] == 1


def test_hypernyms(spark):
    df = spark.createDataFrame([("Two jars, a crate and some jars.", "jar of honey"), ("nothing", "crate and jars"), (None, "x")], "t string, g string")
    got = df.select(tr.hypernym_groups(F.col("t")).alias("h"), evaluators.hypernyms(F.col("t"), F.col("g")).alias("s"), tr.hypernyms_backward(F.col("t")).alias("b")).collect()
    assert [(x.hypernym, x.nouns) for x in got[0].h] == [("container", ["crate", "jars"])] and got[0].s == 1
    assert "container: crate, jars" in got[0].b.description
    assert (got[1].h, got[1].s, got[1].b.description) == ([], 0, None) and got[2].s is None


def test_repeats_against_counter(spark):
    rows = [(i, [random.Random(i).choice("abc") for _ in range(i)]) for i in range(12)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, x array<string>")
    for r in df.select("x", features.repeats(F.col("x")).alias("n")).collect():
        assert (r.x is None and r.n is None) or [(p.phrase, p.n) for p in r.n] == sorted((k, v) for k, v in Counter(r.x).items() if v > 1)
