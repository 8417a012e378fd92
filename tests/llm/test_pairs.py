"""Truncation and defects of pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import pairs, truncation
from tracewright.llm.endings import ending
from tracewright.llm.languages import UNKNOWN, fit, plain
from tracewright.llm.pairrules import asked_language, is_blank, judge

Q = "Anna keeps 12 jars for Brunton and gives 7 to Carl. How many jars remain in Brunton after 3 days?"
T = "<think>\nSo the first part is 4, and the rest is 5.\n</think>\n\n"


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("", "blank"), ("​ ", "blank"), ("...", "blank"), ("Done.", "closed"), ("So the wheel", "open"), ("The answer is \\boxed{3}", "closed"), ("The answer is \\boxed{3", "cut"),
        ("The answer is \\bo", "cut"), ("\\[ \\boxed{4} \\]", "closed"), ("\\[ x", "cut"), ("a, b,", "cut"), ("<think> a </thi", "cut"), ("<think>\nand then", "cut"), ("<think>\nand then.", "closed"),
        ("So the wh…", "cut"), ("So the wh�", "cut"), ("All is well…", "cut"), ("Well. [truncated]", "cut"), ("1. One.\n2.", "cut"), ("**Answer:** 3 jars", "open"), ("**Answer", "cut"), ("x" * 100_000, "open"),
        ("So \\[ " + "x + " * 300 + "x", "cut"), ("He said \"yes.\"" + " " * 20, "closed"), ("Well. [truncated" + " here" * 30 + "]", "cut"), ("A " + "b" * 90 + " <|end_of_" + "c" * 70, "cut"), ("All \U0001f600\U0001f600", "open"),
    ],
)
def test_endings(text, state):
    assert ending(text).state == state


@pytest.mark.parametrize("text", [None, "", " ", "​", "N/A", "null", "-", "...", "<p></p>", "\\boxed{}", "**", "None.", "[]"])
def test_blank_answers(text):
    assert is_blank(text)


@pytest.mark.parametrize(
    ("prompt", "response", "defect"),
    [
        (Q, None, "empty"), (Q, "<think>\nSo it is.\n</think>", "empty"), (Q, T + "N/A", "empty"), (Q, "<think>\nSo it is.", "empty"), (Q, Q, "copy"), (Q, T + Q.upper(), "copy"), (Q, T + Q + "\n\nThe answer is \\boxed{9}.", None),
        (Q, T + "I'm sorry, but I can't help with this.", "refusal"), (Q, T + "Sorry, I added 3 twice. The answer is \\boxed{9}.", None), (Q, "Leider kann ich diese Aufgabe nicht lösen.", "refusal"),
        (Q, T + "La respuesta es \\boxed{9}.", "other_language"), (Q + " Answer in Spanish.", T + "The answer is \\boxed{9}.", "other_language"), (Q, T + "The answer is \\boxed{9}.", None),
        (Q, "The answer is \\boxed{9}.", None), (None, T + "La respuesta es \\boxed{9}.", None), ("", "", "empty"), (Q, "<think>\nSo the wh", None), (Q, T + "I cannot divide by zero here, so the sec", None),
        (Q, T + "I am sorry, but I cannot help with this. " + "Please take no offence, for there is a reason. " * 15, "refusal"), (Q, T + "I cannot divide by zero, so 44 drops out. " * 20 + "It is 9 jars.", None),
        (Q, "Unfortunately this is not something that I am willing to do. Please ask somebody else.", "refusal"), (Q, T + "\U0001f600", None), (Q, T + "\U000e0041", "empty"),
    ],
)
def test_judge(prompt, response, defect):
    assert judge(prompt, response).defect == defect


def test_languages():
    assert asked_language("Bitte antworte auf Englisch.") == "en" and asked_language(Q) is None
    assert plain().language("Combien de jours faut-il pour le trajet entre la ville et la mer ?") == "fr"
    assert plain().language("12 34") is None and plain().language(None) is None


TEXTS = {
    "en": "The jars remain in the town and the rest of them are kept for the people who have not yet come to the market this week",
    "de": "Die Gläser bleiben in der Stadt und der Rest davon wird für die Leute aufbewahrt die noch nicht auf den Markt gekommen sind",
    "pl": "Słoiki pozostają w mieście a reszta z nich jest przechowywana dla ludzi którzy jeszcze nie przyszli na targ w tym tygodniu",
}


def labelled(spark, names):
    rng = random.Random(1)
    rows = [(" ".join(rng.sample(TEXTS[n].split(), 14)), n if i % 10 else "en") for n in names for i in range(60)]
    return spark.createDataFrame([*rows, (None, "en"), ("Ohne Angabe", None)], "text string, lang string")


def test_fitted_languages(spark):
    model = fit(labelled(spark, ["en", "de", "pl"]))
    assert [model.language(t) for t in TEXTS.values()] == ["en", "de", "pl"]
    assert fit(labelled(spark, [])).names == plain().names
    two = fit(labelled(spark, ["en", "de"]))
    assert two.language(TEXTS["pl"]) == UNKNOWN and len(two.weights) <= 20_000
    rows = [("s", "r", TEXTS["en"] + " 1?", T + TEXTS["pl"] + "."), ("s", "r", TEXTS["en"] + " 1?", T + "The jars are kept for the people in the market.")]
    found = pairs.broken_pairs(pairs.output_pairs(outputs(spark, rows)), labelled(spark, ["en", "de"])).collect()
    assert {r.record_id: r.defect for r in found} == {0: "other_language", 1: None}


def features(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, group string, text string")


def outputs(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "output_id long, source string, run_id string, instruction string, model_response string")
    return df.withColumn("defect", F.lit("extra"))


def defects(spark, rows):
    return {r.record_id: r.defect for r in pairs.broken_pairs(pairs.output_pairs(outputs(spark, rows))).collect() if r.defect}


def test_broken_pairs_over_a_table(spark):
    full = [("s", f"r{i}", Q, T + f"**Answer:** {i} seed packets") for i in range(6)]
    rows = [*full, ("s", "r", Q, T + "**Answer:** 3 seed pac"), (None, None, Q, T + "So it ta"), ("s", "r", Q, None), ("s", None, None, "Fine."), ("s", "r", Q, Q)]
    assert defects(spark, rows) == {6: "truncated", 7: "truncated", 8: "empty", 10: "copy"}
    assert defects(spark, []) == {}


def test_repeated_rows_count_once(spark):
    df = outputs(spark, [("s", "r", Q, None)])
    assert pairs.broken_pairs(pairs.output_pairs(df.unionByName(df))).count() == 1


def test_spikes(spark):
    rng = random.Random(6)
    lengths = [rng.randrange(100, 400) for _ in range(300)] + [400] * 9
    df = spark.createDataFrame([("t", ["g"], "open", n, n + 1) for n in lengths], "table_name string, groups array<string>, state string, chars int, octets int")
    assert sorted((r.unit, r.length, r.texts) for r in truncation.length_spikes(df).collect()) == [("bytes", 401, 9), ("chars", 400, 9)]
    flat = spark.createDataFrame([("t", ["g"], "open", n, n) for n in range(100, 400)], "table_name string, groups array<string>, state string, chars int, octets int")
    assert truncation.length_spikes(flat).count() == 0


def test_shortened_against_brute_force(spark):
    rng = random.Random(7)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 9) for _ in range(150)}
    df = spark.createDataFrame(list(texts.items()), "text string, support long").repartition(3)
    expected = {a: max(n for b, n in texts.items() if b.startswith(a) and b != a) for a in texts if any(b.startswith(a) and b != a for b in texts)}
    assert {r.text: r.longer for r in truncation.shortened(df).collect()} == expected
    assert truncation.shortened(df.limit(0)).count() == 0


def test_results_against_their_chunk(spark):
    annotation = "array<struct<id:string,result:string,correct:boolean>>"
    rows = [
        (1, "s", [("1", "total cost of 9 tok", True)], ["So far: total cost of 9 tokens for Brunton."], "t"), (2, "s", [("1", "total cost of 9 tokens for Brunton", True)], ["Result: total cost of 9 tokens for Brunton."], "t"),
        (3, None, [("1", None, None)], ["x"], None), (4, "s", None, ["x"], "t"), (5, "s", [], None, None), (6, "s", [("1", "838", True), ("2", "x + 3 = \\sqrt{2", None)], ["It is 838."], ""), (7, "s", [("1", "", True)], ["a"], "a"),
    ]
    df = spark.createDataFrame(rows, f"trace_id long, source string, `partial_solutions-annotation` {annotation}, `partial_solutions-chunks` array<string>, trace string")
    df = df.union(spark.createDataFrame([(8, "s", [("1", "sev", True), ("2", "60", True), ("3", "4", True)], ["It is seven.", "x = 602 here", "4 jars"], None)], df.schema))
    found = pairs.cut_records(pairs.output_pairs(outputs(spark, [])), pairs.trace_results(df))
    assert sorted(r.record_id for r in found.where("truncated").collect()) == [1, 6, 8]
    report = truncation.truncation_report(found).collect()
    assert sum(r.truncated for r in report) == 3 == sum(r[f"by_{s}"] for r in report for s in truncation.SIGNALS)


def test_cuts_of_a_source_that_truncates_much(spark):
    names = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "inlet", "jetty"]
    cut = [("s", "r", Q, T + f"The first part is 4 crates. The second needs {n} in the wa") for n in names]
    whole = [("s", "r", Q, T + f"The first part is 4 crates. The second needs {n} in the yard.") for n in names]
    # the cuts are at different places of different texts, so none continues another
    cut = [(s, r, q, x.replace("in the wa", f"{n[::-1]} wa")) for (s, r, q, x), n in zip(cut, names, strict=True)]
    assert defects(spark, [*whole, *cut]) == {i: "truncated" for i in range(10, 20)}


def test_a_habit_of_open_ends_is_no_cut(spark):
    rows = [("s", "r", Q, T + f"The first part is {i} crates{' of tin' * i}. So we get\n\n{i} crates in all") for i in range(10)]
    assert defects(spark, rows) == {}


def test_shortened_over_many_partitions(spark):
    stems = spark.range(6_000).select(F.md5(F.col("id").cast("string")).alias("t"))
    texts = stems.select(F.explode(F.transform(F.sequence(F.lit(10), F.lit(14)), lambda k: F.substring("t", F.lit(1), k))).alias("text")).distinct().withColumn("support", F.lit(1).cast("long"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        assert truncation.shortened(texts).count() == 24_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def signals(spark, rows):
    return {r.record_id: r.signal for r in pairs.broken_pairs(pairs.output_pairs(outputs(spark, rows))).collect() if r.signal}


def test_only_the_spike_can_tell(spark):
    """Lines of verse without any punctuation: the longest of them share one length."""
    rng = random.Random(8)
    words = ["amber", "birches", "cedar", "delta", "embers", "fjord", "grove", "heathland", "oak"]
    verse = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(10, 40)))
    rows = [("s", "r", Q, T + verse() + " " + "".join(rng.choice("aeiou") for _ in range(5))) for _ in range(200)]
    limit = max(len(r[3]) for r in rows) + 1
    cut = [("s", "r", Q, (T + " ".join(rng.choice(words) for _ in range(80)))[:limit].rstrip().ljust(limit, "q")) for _ in range(8)]
    assert signals(spark, [*rows, *cut]) == {i: "spike" for i in range(200, 208)}


def test_only_the_neighbour_can_tell(spark):
    """A response that another one continues, at the end of a word and with a usual last line."""
    body = "".join(f"jar {i} of the cedar row\n" for i in range(30))
    rows = [("s", "r", Q, T + f"so {i}\n" + "jar 4 of the cedar row") for i in range(40)]
    rows += [("s", "r", Q, T + body + "jar 4 of the cedar row"), ("s", "r", Q, T + body + "jar 4 of the cedar row\nand then the rest is done.")]
    assert signals(spark, rows) == {40: "neighbour"}
