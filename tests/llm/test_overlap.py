"""Cross-split overlap against comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracewright.llm import overlap
from tracewright.llm.sameproblem import banded_distances, edits, parse, problem_text, same_problem, search_string, slip

BASE = "Anna keeps 12 jars for Brunton and gives 7 to Carl. After 31 days at Brunton, Carl has sold 5 of the jars. How many jars remain in Brunton?"


def same(a, b):
    return same_problem(parse(problem_text(a)), parse(problem_text(b)))


@pytest.mark.parametrize(
    "other",
    [
        BASE.upper(), BASE.lower(), BASE.replace("keeps", "stores").replace("jars for", "jasr for"), f"Question: {BASE} Show your work.", BASE + "\n\n## NOTES\nThink 9 times.",
        "After 31 days at Brunton, Carl has sold 5 of the jars. Anna keeps 12 jars for Brunton and gives 7 to Carl. How many jars remain in Brunton?",
        BASE.replace(" ", " ").replace("12", "$12$"), BASE.replace(".", "").replace(",", ""), f"<p>{BASE}</p>", BASE.replace("a", "а"),
    ],
)
def test_same(other):
    assert same(BASE, other)


@pytest.mark.parametrize("other", [BASE.replace("12", "13"), BASE.replace("Brunton", "Farhill"), BASE.replace("Anna", "Paula").replace("Carl", "Peter")])
def test_not_same(other):
    assert not same(BASE, other)


def full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_other_wording_is_too_far():
    (_, a), (_, b) = search_string(parse(BASE)), search_string(parse("Other text with 12 then 7 then 31 and 5 only"))
    assert full(a, b) > edits(len(a), True)


def test_banded_distances_against_full():
    rng = random.Random(3)
    for n in range(1, 9):
        for k in range(6):
            a = [[rng.randrange(1, 4) for _ in range(n)] for _ in range(40)]
            b = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 10))] for _ in range(40)]
            length = np.array([len(x) for x in b])
            padded = np.array([x + [0] * (length.max() - len(x)) for x in b])
            got = banded_distances(np.array(a), padded, length, k)
            assert got.tolist() == [min(full(x, y), k + 1) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("numeric", [True, False])
def test_segments_never_miss(spark, numeric):
    """Strings within reach share a segment at an allowed place."""
    rng = random.Random(4)
    pairs = []
    for i in range(400):
        n = rng.randrange(1, 40)
        a = [rng.randrange(1, 5) for _ in range(n)]
        b = a[:]
        for _ in range(rng.randrange(edits(n, numeric) + 1)):
            at = rng.randrange(len(b)) if b else 0
            kind = 0 if numeric else rng.randrange(3)
            if kind == 0 and b:
                b[at] = 9
            elif kind == 1 and len(b) > 1:
                b.pop(at)
            else:
                b.insert(at, rng.randrange(1, 5))
        assert full(a, b) <= edits(n, numeric)
        pairs.append((i, a, b))
    make = lambda key, codes: spark.createDataFrame(
        [("t", key + i, 0, numeric, overlap.segment_sizes(len(c), numeric), c) for i, c in codes],
        "table_name string, text_key long, quantities long, numeric boolean, sizes array<int>, codes array<long>",
    )
    evals = overlap.evaluation_keys(make(0, [(i, a) for i, a, _ in pairs]))
    trains = overlap.training_keys(make(1000, [(i, b) for i, _, b in pairs]))
    for hot in (0, 10**6):
        got = {(r.eval_key, r.train_key) for r in overlap.meet(evals, trains, hot).collect()}
        assert {(i, 1000 + i) for i, _, _ in pairs} <= got


def test_long_text_without_numbers_gives_few_keys(spark):
    rng = random.Random(6)
    words = [rng.choice(["alder", "birch", "cedar", "elm", "fir", "hazel", "oak", "yew"]) + rng.choice("abcdefgh") for _ in range(2000)]
    assert len(overlap.segment_sizes(2000, False)) <= 3
    other = words[:]
    for i in range(0, 2000, 9):
        other[i] = "moss"
    rows = [("a", 1, "train", "s", " ".join(words)), ("a", 2, "test", "s", " ".join(other)), ("a", 3, "test", "s", " ".join(reversed(words)))]
    assert run(spark, rows) == [("a", 1, 2)]


def test_slips():
    assert slip("linen", "lien") and slip("gives", "gvies") and not slip("Brunton", "Farhill")


ROWS = "table_name string, id long, split string, source string, text string, eval_id string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    return sorted((r.table_name, r.train_id, r.eval_id) for r in overlap.split_overlaps(df).collect())


def test_pairs(spark):
    rows = [
        ("a", 1, "train", "s", BASE), ("a", 2, "test", None, BASE.upper()), ("a", 2, "test", None, BASE.upper()), ("a", 3, "train", "s", BASE.replace("12", "14")),
        ("a", 4, "validation", "s", BASE + " Explain."), ("b", 5, "test", "s", BASE), ("a", 6, "train", "s", None), ("a", 7, None, "s", BASE), ("a", 8, "test", "s", ""),
        ("a", 9, "train", "s", "No number here at all, only words."), ("a", 10, "test", "s", "no number here at all, only some words"),
    ]
    assert run(spark, rows) == [("a", 1, 2), ("a", 1, 4), ("a", 9, 10)]


def test_empty(spark):
    assert run(spark, []) == []


def test_one_text_everywhere(spark):
    rows = [("a", i, "train" if i % 3 else "test", "s", BASE) for i in range(60)]
    assert len(run(spark, rows)) == 40 * 20


def test_against_all_pairs(spark):
    rng = random.Random(5)
    names = ["Anna", "Bruno", "Carla", "Dario"]

    def make():
        a, b = rng.sample(names, 2)
        return f"In Town {a} has {rng.randrange(3)} jars and {b} has {rng.randrange(3)} boxes. What does {a} keep after {rng.randrange(2)} days in Town?"

    rows = [("a", i, rng.choice(["train", "test"]), "s", rng.choice([str.lower, str, lambda x: x + " Think carefully."])(make())) for i in range(50)]
    expected = []
    for _, i, u, _, x in rows:
        for _, j, v, _, y in rows:
            if u == "train" and v != "train":
                p, q = parse(problem_text(x)), parse(problem_text(y))
                (n, a), (_, b) = search_string(p), search_string(q)
                if p.numbers == q.numbers and (x == y or full(b, a) <= edits(len(b), n) and same_problem(q, p)):
                    expected.append(("a", i, j))
    assert run(spark, rows) == sorted(expected)
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    for hot in (0, 1, 10**6):
        assert sorted((r.table_name, r.train_id, r.eval_id) for r in overlap.split_overlaps(df, hot).collect()) == sorted(expected)


def test_classes(spark):
    rows = [("a", i, "train" if i % 3 else "test", "s", BASE if i % 2 else BASE.upper()) for i in range(60)] + [("a", 99, "test", "s", "1 2 3")]
    found = overlap.find_overlaps(spark.createDataFrame(rows, "table_name string, id long, split string, source string, text string"))
    got = {r.id: (r.class_id, r.links) for r in found.classes().collect()}
    assert got[99] == (99, 0) and len({c for c, _ in got.values()}) == 3
    assert all(got[i][1] == (20 if i % 3 else 40) for i in range(60))
    assert [r.pairs for r in found.steps().orderBy("step").collect()] == [2, 2, 2]


@pytest.mark.parametrize("text", ["\U0001f600 Anna keeps 12 jars", "\U000e0041Anna keeps 12 jars", "\U0001d400nna keeps 12 jars", "\U00020000 12 3 4"])
def test_high_characters(spark, text):
    assert run(spark, [("a", 1, "train", "s", text), ("a", 2, "test", "s", text)]) == [("a", 1, 2)]


def test_report(spark):
    df = spark.createDataFrame([("a", 1, "train", "s", BASE), ("a", 2, "test", None, BASE), ("a", 3, "test", "s", "1 2")], "table_name string, id long, split string, source string, text string")
    got = {(r.split, r.source): (r.records, r.overlapping, r.pairs) for r in overlap.overlap_report(df, overlap.find_overlaps(df)).collect()}
    assert got == {("test", None): (1, 1, 1), ("test", "s"): (1, 0, 0)}
