from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewright.functions import external
from tracewright.operators import dataset, grading, instruct, metrics, pipeline, trace, viewer
from tracewright.operators.instruct import prompt
from tracewright.plans import annotate, backward, verify


def column(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(1)
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_reasoning(spark):
    long = "x" * 300
    got = column(spark, trace.reasoning, ["a</think>b", "no end", "Let me recall it\n\nrest</think>z", f"{long}let me recall\n\nrest", "let me recall only"])
    assert got == ["a", "no end", "rest", f"{long}let me recall\n\nrest", "let me recall only"]


def test_boxes(spark):
    texts = ["</think> \\boxed{\\frac{1}{2}} and }", "\\boxed{1}", "</think> none", "</think> \\boxed{1} \\boxed{2}"]
    assert column(spark, trace.boxed_answer, texts) == ["\\frac{1}{2}", "", "", "1"]
    assert column(spark, trace.boxed_answer_compat, texts[:1]) == ["\\frac{1}{2}} and }"]
    assert column(spark, trace.last_box, texts[3:]) == ["2"]


def test_thought_and_fence(spark):
    assert column(spark, trace.thought, ["a<think>b</think>c</think>d", "plain"]) == ["b</think>c", "plain"]
    assert column(spark, trace.fenced_json, ["x ```json\n{1} ``` y ```", "none"]) == ["{1} ``` y", None]


def test_nearest_merge_ties_go_to_the_earlier(spark):
    rows = [(1, 0, "a", "1"), (1, 1, "b", None), (1, 2, "c", "2"), (2, 0, "x", None), (3, 0, "p", None), (3, 1, "q", None), (3, 2, "r", "9")]
    df = spark.createDataFrame(rows, "doc_id long, ix long, chunk string, answer string")
    got = {(r.doc_id, r.ix): r.text for r in trace.merge_by_nearest_answer(df).collect()}
    assert got == {(1, 0): "a\n\nb", (1, 2): "c", (3, 2): "p\n\nq\n\nr"}


def test_splice(spark):
    df = spark.createDataFrame([("abcabc", "c"), ("abc", "z"), ("abc", None), ("xabc", "x")], "c string, r string")
    tag = lambda s: f"<partial_solution>{s}</partial_solution>"
    assert [r.v for r in df.select(trace.splice_tag(F.col("c"), F.col("r")).alias("v")).collect()] == [f"ab{tag('c')}abc", "abc", "abc", f"{tag('x')}abc"]


@pytest.mark.parametrize("shards", [0, 1, 3, 7, 20])
def test_shards(spark, shards):
    got = dataset.sharded(spark.range(10), shards, "id").orderBy("id").collect()
    expected = [(i, s) for s, (a, b) in enumerate(dataset.shard_bounds(10, shards)) for i in range(a, b)]
    assert [(r.id, r["shard"]) for r in got] == expected


def test_numbering_ranges_and_batches(spark):
    df = spark.range(100).repartition(5)
    assert [r.row_no for r in dataset.numbered(df, "id").orderBy("id").collect()] == list(range(1, 101))
    assert [r.id for r in dataset.row_range(df, 3, 6, "id").orderBy("id").collect()] == [3, 4, 5]
    assert dataset.batched(df, 30, "id").where("batch = 3").count() == 10
    assert dataset.numbered(df.limit(0), "id").count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_many_partitions_are_distinct(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(5)
        got = [r.row_no for r in dataset.numbered(df, "k").orderBy("k").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == list(range(1, 20_001))


@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_a_large_table(spark, adaptive, wide):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(400_000).select(F.xxhash64("id").alias("k"), F.repeat(F.col("id").cast("string"), 20 if wide else 0).alias("t"))
        got = dataset.numbered(rows if wide else rows.select("k"), "k").agg(F.countDistinct("row_no"), F.min("row_no"), F.max("row_no")).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tuple(got) == (400_000, 1, 400_000)


def test_first_per_json(spark):
    rows = [(1, '{"a": 1, "b": 2}'), (2, '{"b": 2, "a": 1}'), (3, "no json"), (4, "no json"), (5, None), (6, None), (7, "[1")]
    df = spark.createDataFrame(rows, "id long, v string")
    assert sorted(r.id for r in dataset.first_per_json(df, "v", "id").collect()) == [1, 3, 5, 7]


def test_generation_by_length(spark):
    class Sizes:
        def __call__(self, prompts):
            assert len({len(p) // 10 for p in prompts}) == 1 and len(prompts) <= max(1, 4 // (1 + len(prompts[0]) // 10))
            return [f"{len(p)}!rest" for p in prompts]

    df = spark.createDataFrame([(i, "x" * (i * 7 % 40 + 1)) for i in range(30)], "id long, prompt string").coalesce(1)
    got = {r.id: r.answer for r in external.generated_by_length(df, Sizes, batch=4, width=10, stops=("!",)).collect()}
    assert got == {i: str(i * 7 % 40 + 1) for i in range(30)}


def test_annotation_defaults(spark):
    df = spark.createDataFrame([(1, ["a 5\nb 6", "none here"]), (2, []), (3, None)], "trace_id long, chunks array<string>")
    got = annotate.annotated(df).collect()
    assert [r.trace_id for r in got] == [1] and len(got[0].annotation) == 2
    bad = df.where("trace_id = 1").select(annotate.annotation_of(F.lit("no list"), F.col("chunks")).alias("a")).first().a
    assert [(x.id, x.result, x.correct) for x in bad] == [("0", None, None), ("1", None, None)]


def test_whole_plan(spark):
    seeds = spark.createDataFrame([(i, f"Write line {i}.") for i in range(40)], "instruction_id long, instruction string")
    queries = spark.createDataFrame([("How many jars?",), ("Which road?",), (None,)], "query string").where("query is not null")
    made = verify.generate_verify_filter(seeds, queries)
    rows = made.responses.collect()
    assert rows and len({r.response_id for r in rows}) == len(rows)
    assert {r.instruction_id for r in rows} <= {r.instruction_id for r in made.instructions.collect()} <= {r.instruction_id for r in made.functions.collect()}
    assert made.preferences.count() == len(rows) and made.preferences.where("is_positive = 1").count() == sum(r.kept for r in rows)
    assert verify.generate_verify_filter(seeds.limit(0), queries).responses.count() == 0


def test_backward_samples(spark):
    message = lambda q, a: [("user", q), ("assistant", f"<think>\n{a}\n</think>\n\nDone.")]
    rows = [(i, message(f"Question {i}?", "The jar and the crate. The jar and the crate.")) for i in range(10)] + [(10, None), (11, [("user", "x")])]
    df = spark.createDataFrame(rows, "sample_id long, messages array<struct<role:string,content:string>>")
    got = backward.backward_samples(df, instruct.template_table(spark)).collect()
    assert sorted((r.sample_id, r.part) for r in got) == [(i, "train" if i < 9 else "test") for i in range(10)]
    asked = got[0].messages[0].content
    assert "container" in asked and "Question" in asked and "repeated" not in asked


def test_first_per_value_keeps_nulls_and_ties(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "id long, v string")
    assert sorted((r.id, r.v) for r in dataset.first_per_value(df, ["v"], "id").collect()) == [(1, "a"), (3, None)]


def test_templates():
    assert len(instruct.TEMPLATES) == 15 and all(len(set(x)) == 10 and all("{value}" in y for y in x) for x in instruct.TEMPLATES.values())


def test_canonical_json(spark):
    assert column(spark, dataset.canonical_json, ['{"b":1,"a":2}', None]) == ['{"a": 2, "b": 1}', None]


def test_generation_is_keyed_and_retried(spark):
    class Broken:
        def __call__(self, prompts):
            raise RuntimeError

    assert external.call_with_retry(Broken(), ["a", "b"], sleep=lambda _: None) == ["", ""]
    rows = spark.createDataFrame([(1, "x\nyes"), (2, None)], "id long, prompt string")
    assert {r.id: r.answer for r in external.generated(rows, external.EchoGenerator, batch=1, parallel=2).collect()} == {1: "yes", 2: ""}


def test_pipeline_stages(spark):
    answers = spark.createDataFrame([("- one\n- two\nno",), ("- one",)], "answer string")
    known = spark.createDataFrame([("two",)], "instruction string")
    assert [r.instruction for r in pipeline.new_seeds(answers, known).collect()] == ["one"]
    functions = spark.createDataFrame([(1, "upper_case_forward"), (1, "lower_case_forward"), (2, "upper_case_forward")], "instruction_id long, function_name string")
    cases = spark.createDataFrame([(1, 1, "ABC", "true"), (1, 2, "abc", "False")], "instruction_id long, case_id long, input string, output string")
    got = {(r.instruction_id, r.function_name): r.accuracy for r in pipeline.tested_functions(functions, cases).collect()}
    assert got == {(1, "upper_case_forward"): 1.0}
    assert column(spark, pipeline.score_of, ["Score: 5", "Score:10 Score: 2", "none"]) == [5, 10, None]
    parsed = column(spark, pipeline.parsed_function, ['```json\n{"func": "f", "cases": []}\n```', 'x {"func": "g", "cases": []}', "none"])
    assert [p and p["func"] for p in parsed] == ["f", "g", None]
    broken = '{"func": "a = "b"\nreturn", "cases": []}'
    assert column(spark, lambda c: pipeline.parsed_function(pipeline.repaired_json(c)), [broken])[0]["func"] == 'a = "b"\nreturn'


def test_prompts(spark):
    df = spark.createDataFrame([("q", "a")], "q string, a string")
    assert "[Question] q" in df.select(prompt("hindsight", question=F.col("q"), answer=F.col("a")).alias("p")).first().p


@pytest.mark.parametrize(
    ("given", "truth", "right"),
    [
        ("0.5", "\\frac{1}{2}", True), ("1,000", "1000", True), ("7 3/4", "\\frac{31}{4}", True), ("(1,2)", "[1,2]", False), ("2/4", "1/2", False), ("50\\%", "50", True),
        ("\\text{Evelyn}", "Evelyn", True), ("x=5", "5", True), ("\\sqrt3", "\\sqrt{3}", True), ("2x+3", "3+2x", True), ("12 cm", "12", True), ("", "3", False), (None, "3", False),
        ("5", "6", False), ("(1, 2)", "(1,2)", True), ("1/3", "0.333", False),
    ],
)
def test_grading(spark, given, truth, right):
    df = spark.createDataFrame([(given, truth)], "g string, t string")
    assert df.select(grading.grade(F.col("g"), F.col("t")).alias("v")).first().v is right


def test_expressions_never_run_code():
    assert not grading.equal_expressions("__import__('os')", "1")
    assert not grading.equal_expressions("9^9^9^9", "1")


def test_calibration_edges(spark):
    rows = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.5, 1)], "p double, y int")
    # the first is in no bin: (|1 - 1| + |0.5 - 1|) / 3
    assert metrics.ece(rows, F.col("p"), F.col("y")).first().ece == pytest.approx(0.5 / 3)
    assert rows.agg(metrics.rounded_accuracy(F.col("p"), F.col("y"))).first()[0] == pytest.approx(2 / 3)


def test_benchmark_grid():
    grid = metrics.benchmark_grid(4)
    assert len(grid) == 20 and grid[0][:2] == (4, 16)


def test_viewer(spark):
    df = spark.createDataFrame([(5, ["a"], "s"), (6, None, None)], "sample_id long, applied_functions array<string>, source string")
    listed = viewer.listing(df)
    assert [tuple(r) for r in listed.orderBy("index").collect()] == [(5, 0, "a", "s"), (6, 1, "No function", "unknown")]
    assert viewer.item(listed, 9).count() == 0
    assert column(spark, viewer.highlighted, ["<think>a<b</think>"]) == ['<span class="think">a&lt;b</span>']
