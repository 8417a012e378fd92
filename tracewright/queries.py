"""Queries over the driver's tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import external
from tracewright.functions import text as t
from tracewright.operators import dataset, evaluators, features, grading, instruct, metrics, pipeline, probe, trace, viewer
from tracewright.operators import transforms as tr
from tracewright.plans import annotate as plans_annotate
from tracewright.plans import backward as plans_backward
from tracewright.plans import mix as plans_mix
from tracewright.plans import verify as plans_verify
from tracewright.plans.mix import HELD_OUT_FUNCTIONS, TRAIN_FUNCTIONS

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer partitions than the cluster has cores.

    A small file of one row group is one partition, however costly its rows
    are; a scan of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents")


def _transform(function: Callable) -> Query:
    return lambda spark, d: _docs(spark, d).select("doc_id", function(F.col("text")).alias("new_text"))


QUERIES: dict[str, Query] = {
    f"tf_{n.removesuffix('_forward')}": _transform(f) for n, (f, _) in tr.FORWARD.items() if n not in ("identity", "json_of_paragraphs_forward", "render_as_html_forward")
}
QUERIES["tf_html_paragraphs"] = _transform(tr.html_paragraphs)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def tf_json_of_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The JSON is read back, since only the value is defined, not its bytes."""
    made = _docs(spark, d).select("doc_id", tr.json_of_paragraphs(F.col("text")).alias("j"))
    return made.select("doc_id", F.from_json("j", "struct<paragraphs:array<string>>")["paragraphs"].alias("paragraphs"))


@query
def feat_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.counts(spread(_docs(spark, d).select("doc_id", "text")))


@query
def feat_top_word(spark: SparkSession, d: str) -> DataFrame:
    best = spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", tr.top_word(F.col("text")).alias("b")).where("b is not null")
    return best.select("doc_id", "b.word", "b.freq")


@query
def feat_repeated_sentences(spark: SparkSession, d: str) -> DataFrame:
    return features.repeated_sentences(_docs(spark, d))


@query
def feat_ngram_repetitions(spark: SparkSession, d: str) -> DataFrame:
    return features.repeated_ngrams(spread(_docs(spark, d).select("doc_id", "text")))


@query
def feat_sentence_openings(spark: SparkSession, d: str) -> DataFrame:
    return features.sentence_openings(_docs(spark, d))


@query
def feat_sentence_closings(spark: SparkSession, d: str) -> DataFrame:
    return features.sentence_closings(_docs(spark, d))


@query
def feat_paragraph_openings(spark: SparkSession, d: str) -> DataFrame:
    return features.paragraph_openings(_docs(spark, d))


@query
def feat_paragraph_closings(spark: SparkSession, d: str) -> DataFrame:
    return features.paragraph_closings(_docs(spark, d))


@query
def feat_enumeration(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select("doc_id", tr.is_enumeration(text).alias("all_lines"), features.opens_with_enumeration(text).alias("opening"))


@query
def feat_alliteration_haiku(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select("doc_id", features.is_alliterative(text).alias("alliterative"), features.is_haiku(text).alias("haiku"))


# Evaluators over model outputs against the reference response.


def _evaluator(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _t(spark, d, "model_outputs").select("output_id", "model_response", "gt_response").distinct()
        return rows.select("output_id", evaluators.EVALUATORS[name](F.col("model_response"), F.col("gt_response")).alias("score"))

    return run


QUERIES |= {f"ev_{n}": _evaluator(n) for n in evaluators.EVALUATORS}


@query
def eval_forward_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluators.forward_matrix(spread(_docs(spark, d).select("doc_id", "text")))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs, an id once."""
    columns = ["output_id", "sample_id", "instruction", "function_name", "model_response", "model_reasoning", "gt_response", "if_score", "score"]
    return _t(spark, d, "model_outputs").select(*columns).dropDuplicates(["output_id"])


@query
def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rollup_by_function(metrics.scored(_outputs(spark, d)))


# Traces.


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns of samples."""
    rows = _t(spark, d, "samples").select("sample_id", F.get("messages", F.lit(1))["content"].alias("text"))
    return rows.where("text is not null").distinct()


@query
def trace_tag_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("sample_id", trace.normalize_tags(F.col("text")).alias("text"))


@query
def trace_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).select("sample_id", trace.split_thought(trace.normalize_tags(F.col("text"))).alias("s")).where("s is not null")
    return rows.select("sample_id", "s.cot", "s.response")


@query
def trace_split_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).select("sample_id", trace.split_thought_strict(trace.normalize_tags(F.col("text"))).alias("s"))
    return rows.select("sample_id", "s.cot", "s.response", "s.error")


@query
def trace_thought(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("sample_id", trace.thought(F.col("text")).alias("thought"))


@query
def trace_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "annotated_traces").select("trace_id", trace.reasoning(F.col("raw_answer")).alias("reasoning")).distinct()


@query
def trace_boxed(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_answer")
    rows = _t(spark, d, "annotated_traces").select("trace_id", trace.boxed_answer(raw).alias("boxed"), trace.boxed_answer_compat(raw).alias("compat"), trace.last_box(raw).alias("last"))
    return rows.distinct()


@query
def trace_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "annotated_traces").select("trace_id", "trace").distinct()
    return rows.select("trace_id", F.posexplode(trace.chunks(F.col("trace"))).alias("ix", "chunk")).select("trace_id", F.col("ix").cast("long").alias("ix"), "chunk")


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of traces with the result of the annotation at the same place."""
    rows = _t(spark, d, "annotated_traces").select("trace_id", F.col("`partial_solutions-annotation`").alias("a"), F.col("`partial_solutions-chunks`").alias("c")).distinct()
    pairs = rows.select("trace_id", F.posexplode(trace.zip_shorter(F.col("a"), F.col("c"))).alias("ix", "z"))
    return pairs.select("trace_id", F.col("ix").cast("long").alias("ix"), F.col("z.1").alias("chunk"), F.col("z.0.result").alias("answer"))


@query
def trace_nearest_merge(spark: SparkSession, d: str) -> DataFrame:
    return trace.merge_by_nearest_answer(_chunk_rows(spark, d), "trace_id")


@query
def trace_splice(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_rows(spark, d).select("trace_id", "ix", trace.splice_tag(F.col("chunk"), F.col("answer")).alias("chunk"))


@query
def trace_annotated(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "annotated_traces").select("trace_id", "raw_answer", F.col("`partial_solutions-annotation`").alias("a"), F.col("`partial_solutions-chunks`").alias("c")).distinct()
    return rows.select("trace_id", trace.annotated_trace(F.col("c"), F.col("a"), F.col("raw_answer")).alias("text")).where("text is not null")


# Datasets.


@query
def ds_shards(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sharded(_docs(spark, d).select("doc_id", "text"), 7, "doc_id")


@query
def ds_split_90_10(spark: SparkSession, d: str) -> DataFrame:
    return dataset.positional_split(_docs(spark, d).select("doc_id", "text"), 0.9, "doc_id")


@query
def ds_sample_n(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sample_n(_docs(spark, d).select("doc_id", "source"), 50, "doc_id", seed=42)


@query
def ds_row_range(spark: SparkSession, d: str) -> DataFrame:
    return dataset.row_range(_docs(spark, d).select("doc_id", "text"), 100, 160, "doc_id")


@query
def ds_batches(spark: SparkSession, d: str) -> DataFrame:
    return dataset.batched(_docs(spark, d).select("doc_id", "text"), 64, "doc_id")


@query
def ds_ood_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", instruct.one_function(F.col("doc_id"), TRAIN_FUNCTIONS + HELD_OUT_FUNCTIONS).alias("function_name"))
    return rows.withColumn("part", F.when(F.col("function_name").isin(HELD_OUT_FUNCTIONS), "ood_test").otherwise("train"))


@query
def ds_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return dataset.first_per_value(_docs(spark, d).select("doc_id", "text"), ["text"], "doc_id")


@query
def ds_dedup_delivered(spark: SparkSession, d: str) -> DataFrame:
    """Rows delivered twice: the first delivery of each id."""
    rows = _t(spark, d, "samples").select("sample_id", "source", "ingested_at")
    return dataset.first_per_value(rows, ["sample_id"], "ingested_at").select("sample_id", "source", F.unix_micros("ingested_at").alias("ingested_us"))


@query
def ds_dedup_json(spark: SparkSession, d: str) -> DataFrame:
    """Judgements, functions and other documents that are JSON or not: the first of each value."""
    fenced = F.regexp_extract("text", r"(?s)```json(.*?)```", 1)
    rows = _docs(spark, d).where("doc_kind = 'code' and text is not null").select("doc_id", F.when(fenced != "", t.strip(fenced)).otherwise(F.col("text")).alias("value"))
    return dataset.first_per_json(rows, "value", "doc_id").select("doc_id")


@query
def bench_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Outputs and characters per second of each run, from the first to the last finished."""
    rows = _t(spark, d, "model_outputs").select("output_id", "run_id", "finished_at", "model_response").distinct()
    return metrics.throughput(rows, "run_id", F.col("finished_at"), F.length("model_response"))


@query
def ds_new_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Bulleted instructions of documents that are not seeds yet."""
    answers = _docs(spark, d).where("doc_kind = 'instruction'").select(F.col("text").alias("answer"))
    known = _t(spark, d, "seed_instructions").select(t.strip(F.col("instruction")).alias("instruction"))
    return pipeline.new_seeds(answers, known)


@query
def ds_first_pair(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "samples").where(dataset.well_formed_pair(F.col("messages")))
    m = lambda i: F.get("messages", F.lit(i))["content"]
    return rows.select("sample_id", F.size("messages").cast("long").alias("turns"), F.length(m(0)).cast("long").alias("asked"), F.length(m(1)).cast("long").alias("said")).distinct()


@query
def ds_assistant_turns(spark: SparkSession, d: str) -> DataFrame:
    return dataset.assistant_turns(_t(spark, d, "samples").select("sample_id", "messages").distinct(), "sample_id")


@query
def ds_two_turns(spark: SparkSession, d: str) -> DataFrame:
    m = lambda i: F.get("messages", F.lit(i))["content"]
    return dataset.with_turns(_t(spark, d, "samples")).select("sample_id", "split", m(0).alias("asked"), m(1).alias("said")).distinct()


@query
def ds_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    words = features.word_count(F.col("text")).cast("double")
    return dataset.histogram(_docs(spark, d).where("text is not null"), words, 0.0, 600.0)


@query
def ds_union_common(spark: SparkSession, d: str) -> DataFrame:
    both = dataset.concatenated(_t(spark, d, "samples"), _t(spark, d, "annotated_traces"))
    return both.groupBy("split", "source").agg(F.count("*").alias("n"))


@query
def ds_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return dataset.length_buckets(_answers(spark, d), F.col("text"), 16, 1000).select("sample_id", "bucket", "batch_size")


@query
def ds_hyper_grid(spark: SparkSession, d: str) -> DataFrame:
    return dataset.grid(spark, lr=[0.1, 0.01], hidden=[0, 64, 128], alpha=[0.5, 1.0], decay=[0.0, 0.01])


# Instructions.


@query
def instr_fan_out(spark: SparkSession, d: str) -> DataFrame:
    rows = instruct.fan_out(spread(_docs(spark, d).select("doc_id", "text")))
    return rows.groupBy("function_name").agg(F.count("*").alias("n"))


@query
def instr_fan_out_ranks(spark: SparkSession, d: str) -> DataFrame:
    return instruct.fan_out(spread(_docs(spark, d).select("doc_id", "text"))).select("doc_id", F.col("rank").cast("long").alias("rank"), "function_name")


@query
def instr_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Training samples: the user turn with an instruction, the reasoning transformed to follow it."""
    rows = _t(spark, d, "samples").where(dataset.well_formed_pair(F.col("messages"))).select("sample_id", "messages").distinct()
    m = lambda i: F.get("messages", F.lit(i))["content"]
    parts = rows.select("sample_id", m(0).alias("user"), trace.split_thought(trace.normalize_tags(m(1))).alias("s")).where("s is not null")
    made = parts.select("sample_id", instruct.wrap_sample(F.col("user"), tr.upper_case(F.col("s.cot")), F.col("s.response"), F.lit("use capital letters only")).alias("messages"))
    return made.select("sample_id", F.get("messages", F.lit(0))["content"].alias("asked"), F.get("messages", F.lit(1))["content"].alias("said"), instruct.num_chars(F.col("messages")).alias("num_chars"))


@query
def instr_reinstructed(spark: SparkSession, d: str) -> DataFrame:
    m = lambda i: F.get("messages", F.lit(i))["content"]
    rows = _t(spark, d, "samples").select("sample_id", m(0).alias("user"), m(1).alias("assistant")).distinct()
    # a reasoning that recalls two instructions, as transforms that are applied after one another leave it
    twice = F.concat(instruct.prefix(F.lit("be loud")), instruct.prefix(F.lit("be slow")), F.col("assistant"))
    made = rows.select("sample_id", instruct.reinstruct(F.col("user"), F.when(F.col("sample_id") % 2 == 0, twice).otherwise(F.col("assistant")), F.lit("be brief")).alias("r"))
    return made.select("sample_id", F.col("r.user").alias("asked"), F.col("r.assistant").alias("said"))


@query
def instr_rendered(spark: SparkSession, d: str) -> DataFrame:
    return instruct.render(features.feature_values(_feature_rows(spark, d)), instruct.template_table(spark))


@query
def plan_backward(spark: SparkSession, d: str) -> DataFrame:
    """Samples with constraints that their reasoning meets, split 90/10."""
    made = plans_backward.backward_samples(_t(spark, d, "samples"), instruct.template_table(spark))
    m = lambda i: F.get("messages", F.lit(i))["content"]
    return made.select("sample_id", "part", m(0).alias("asked"), m(1).alias("said"))


# Generate, verify, filter.


@query
def gen_parsed_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("doc_kind = 'code'").select("doc_id", pipeline.parsed_function(F.col("text")).alias("p")).where("p is not null")
    return rows.select("doc_id", pipeline.cleaned_function(F.col("p.func")).alias("func"), F.coalesce(F.size("p.cases"), F.lit(0)).cast("long").alias("cases"))


@query
def gen_suspicious_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of functions in documents and of those that the offline writer makes for the seeds."""
    parsed = lambda df, c: df.select(pipeline.parsed_function(F.col(c)).alias("p")).where("p is not null").select("p.func")
    seeds = _t(spark, d, "seed_instructions").select(instruct.prompt("eval_function", instruction=F.coalesce("instruction", F.lit(""))).alias("prompt"))
    made = parsed(external.generated(seeds, external.FunctionWriter), "answer")
    return pipeline.suspicious_lines(parsed(_docs(spark, d).where("doc_kind = 'code'"), "text").unionByName(made))


@query
def gen_tested_functions(spark: SparkSession, d: str) -> DataFrame:
    """All registered functions against cases made from documents; the expected output is whether the text is in capitals."""
    names = sorted(evaluators.EVALUATORS)
    seeds = _t(spark, d, "seed_instructions").select(F.col("seed_id").alias("instruction_id"))
    functions = seeds.select("instruction_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("function_name"))
    docs = spread(_docs(spark, d).where("seed_id is not null and text is not null"))
    cases = docs.select(F.col("seed_id").alias("instruction_id"), F.col("doc_id").alias("case_id"), F.col("text").alias("input"), (F.col("text") == F.upper("text")).cast("string").alias("output"))
    tested = pipeline.tested_functions(functions, cases)
    return tested.select("instruction_id", "function_name", F.round("accuracy", 9).alias("accuracy"))


@query
def gen_judge_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("doc_kind = 'judge' and seed_id is not null").select("seed_id", "text")
    return pipeline.judged(rows, "seed_id", "text")


@query
def gen_preferences(spark: SparkSession, d: str) -> DataFrame:
    rows = _outputs(spark, d).where("model_response is not null and instruction is not null")
    kept = rows.select(F.col("instruction").alias("query"), F.col("model_response").alias("response"), (F.coalesce("if_score", F.lit(0.0)) > 0).alias("kept"))
    return pipeline.preferences(kept).groupBy("is_positive").agg(F.count("*").alias("n"))


@query
def gen_verified_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = _outputs(spark, d).where("function_name is not null and model_response is not null")
    responses = rows.select(F.col("output_id").alias("response_id"), F.col("function_name").alias("instruction_id"), F.col("model_reasoning").alias("response"), F.col("instruction").alias("query"))
    functions = rows.select(F.col("function_name").alias("instruction_id"), "function_name").distinct()
    return pipeline.verified_responses(responses, functions).select("response_id", "kept")


@query
def gen_stub_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Seeds, rewrites and judgements with the offline generators."""
    seeds = _t(spark, d, "seed_instructions").select("seed_id", t.strip(F.col("instruction")).alias("instruction"))
    judgements = pipeline.asked_k_times(seeds, 3).withColumn("prompt", instruct.prompt("judge", instruction=F.col("instruction"), response=F.col("attempt").cast("string"), query=F.col("seed_id").cast("string")))
    return pipeline.judged(external.generated(judgements, external.HashJudge), "seed_id")


@query
def gen_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan from seeds to verdicts, with the offline generators."""
    seeds = _t(spark, d, "seed_instructions").select(F.col("seed_id").alias("instruction_id"), t.strip(F.col("instruction")).alias("instruction"))
    queries = _t(spark, d, "benchmark_items").where("problem is not null").select(F.col("problem").alias("query"))
    found = plans_verify.generate_verify_filter(seeds, queries).responses
    return found.select("response_id", "instruction_id", "query", "response", F.round("mean_result", 9).alias("mean_result"), F.round("mean_score", 9).alias("mean_score"), "kept")


@query
def gen_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns through a generator in batches of like length, cut at a stop mark."""
    rows = _answers(spark, d).select("sample_id", F.col("text").alias("prompt"))
    return external.generated_by_length(rows, external.EchoGenerator, width=1000, stops=(".", "}")).select("sample_id", "answer")


@query
def gen_annotated_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of traces through the annotator."""
    rows = _t(spark, d, "annotated_traces").select("trace_id", F.col("`partial_solutions-chunks`").alias("chunks")).distinct()
    done = plans_annotate.annotated(rows)
    return done.select("trace_id", F.transform("annotation", lambda a: F.concat_ws("=", a["id"], a["result"])).alias("results"))


@query
def gen_nli_filter(spark: SparkSession, d: str) -> DataFrame:
    seeds = _t(spark, d, "seed_instructions").select("seed_id", "instruction", F.array(F.lower("instruction"), F.concat(F.lit("do not "), F.col("instruction"))).alias("back_instruction"))
    return pipeline.consistent_instructions(seeds).select("seed_id")


@query
def gen_translated(spark: SparkSession, d: str) -> DataFrame:
    return external.translated(_docs(spark, d).select("doc_id", "text"), external.TagTranslator, "fr").select("doc_id", "new_text")


# Math answers.


@query
def math_short_form(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "annotated_traces").select("trace_id", F.posexplode(F.transform("`partial_solutions-annotation`", lambda a: a["result"])).alias("ix", "result")).where("result is not null")
    return rows.select("trace_id", F.col("ix").cast("long").alias("ix"), grading.short_form(F.col("result")).alias("form")).distinct()


@query
def math_grade(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "annotated_traces").select("trace_id", "raw_answer", "final_answer").distinct()
    return rows.select("trace_id", grading.grade(trace.boxed_answer(F.col("raw_answer")), F.col("final_answer")).alias("correct"))


@query
def math_grade_exact(spark: SparkSession, d: str) -> DataFrame:
    """Grades of whole numbers, where equality as text decides."""
    rows = _t(spark, d, "annotated_traces").select("trace_id", trace.boxed_answer(F.col("raw_answer")).alias("given"), "final_answer").distinct()
    whole = rows.where(F.col("given").rlike("^[1-9][0-9]*$") & F.col("final_answer").rlike("^[1-9][0-9]*$"))
    return whole.select("trace_id", grading.grade(F.col("given"), F.col("final_answer")).alias("correct"))


#: Pairs of answers with what the grade must be: fractions, units, commas, tuples, mixed numbers, roots, polynomials;
#: a whole number must be given as one.
GRADED = [
    ("0.5", "\\frac{1}{2}", True), ("1,000", "1000", True), ("7 3/4", "\\frac{31}{4}", True), ("(1,2)", "[1,2]", False), ("2/4", "1/2", False),
    ("50\\%", "50", True), ("\\text{Evelyn}", "Evelyn", True), ("x=5", "5", True), ("\\sqrt3", "\\sqrt{3}", True), ("2x+3", "3+2x", True), ("12 cm", "12", True),
    ("", "3", False), ("5", "6", False), ("(1, 2)", "(1,2)", True), ("1/3", "0.333", False), ("(1,2)", "(2,1)", False), ("x^2-1", "(x-1)(x+1)", True),
    ("3 million", "3000000", False), ("\\frac12", "\\frac{1}{2}", True), ("-7", "7", False), ("1000", "1,000.0", True), ("\\{1,2\\}", "\\{1,2\\}", True),
]


@query
def math_cases(spark: SparkSession, d: str) -> DataFrame:
    """The rules of grading, case by case."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(GRADED)], "case_id long, given string, truth string")
    return rows.select("case_id", grading.grade(F.col("given"), F.col("truth")).alias("correct"))


@query
def math_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "annotated_traces").select("trace_id", trace.boxed_answer(F.col("raw_answer")).alias("given"), "final_answer").distinct()
    correct = F.when(F.col("given") != "", F.lower("given") == F.lower("final_answer"))
    out = metrics.gradable_accuracy(rows.withColumn("ok", correct), F.col("ok"))
    return out.select("samples", "graded", F.round("accuracy_of_graded", 9).alias("accuracy_of_graded"), F.round("accuracy", 9).alias("accuracy"))


# Metrics.


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Scores as labels with a probability that depends on the id and stays off the edges of the bins."""
    rows = _outputs(spark, d).where("score is not null").select("output_id", F.col("score").alias("y")).distinct()
    return rows.withColumn("p", (F.pmod(F.col("output_id") * 7919, F.lit(997)) + 0.5) / 997.0)


@query
def calibration_ece(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(_probabilities(spark, d), F.col("p"), F.col("y")).select(F.round("ece", 9).alias("ece"))


@query
def calibration_losses(spark: SparkSession, d: str) -> DataFrame:
    rows, p, y = _probabilities(spark, d), F.col("p"), F.col("y")
    ratio = rows.agg(metrics.class_ratio(y).alias("ratio"))
    return rows.crossJoin(F.broadcast(ratio)).agg(  # one row
        F.round(metrics.brier(p, y), 9).alias("brier"), F.round(metrics.weighted_bce(p, y, F.col("ratio")), 8).alias("bce"),
        F.round(metrics.rounded_accuracy(p, y), 9).alias("accuracy"), F.round(F.max("ratio"), 9).alias("ratio"),
    )


@query
def latency_p90(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency(_t(spark, d, "events"), "event_type", F.col("value"))


@query
def bench_best(spark: SparkSession, d: str) -> DataFrame:
    rate = F.col("avg_tokens_per_second")
    return metrics.best_run(_t(spark, d, "serving_runs")).select("run_id", rate.alias("rate"), F.round(metrics.projected_hours(rate), 6).alias("hours"), F.round(metrics.speedup(rate), 6).alias("speedup"))


@query
def bench_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "serving_runs").where("success")
    return rows.groupBy(F.col("config.tensor_parallel_size").cast("long").alias("parallel")).agg(
        F.count("*").alias("runs"), F.round(F.max("avg_tokens_per_second"), 6).alias("best"), F.round(F.percentile("p90_latency_seconds", 0.9), 6).alias("p90")
    )


@query
def bench_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Success and latency by batch size."""
    return metrics.sweep(_t(spark, d, "serving_runs"), F.col("config.batch_size").cast("long"), F.col("success"), F.col("avg_latency_seconds"))


@query
def bench_memory(spark: SparkSession, d: str) -> DataFrame:
    """Peak reserved memory over the devices of a run."""
    reserved = F.transform(F.map_values("memory_usage_gb"), lambda m: m["reserved_gb"])
    return _t(spark, d, "serving_runs").select("run_id", F.size(F.map_keys("memory_usage_gb")).cast("long").alias("devices"), F.round(F.array_max(reserved), 6).alias("reserved"))


@query
def bench_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(metrics.benchmark_grid(4))]
    return spark.createDataFrame(rows, "ordinal long, parallel long, block long, utilization double, batch long")


@query
def probe_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return probe.grid_search(_t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label")))


# Viewer.


@query
def viewer_list(spark: SparkSession, d: str) -> DataFrame:
    return viewer.listing(_t(spark, d, "samples").select("sample_id", "applied_functions", "source").distinct())


@query
def viewer_item(spark: SparkSession, d: str) -> DataFrame:
    return viewer.item(viewer_list(spark, d), 17)


@query
def viewer_highlight(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", viewer.highlighted(F.col("text")).alias("page"))


# Whole pipelines.


@query
def mix_synthesis(spark: SparkSession, d: str) -> DataFrame:
    m = lambda i: F.get("messages", F.lit(i))["content"]
    return plans_mix.synthesize(_t(spark, d, "samples")).select("sample_id", "part", "applied_functions", m(0).alias("asked"), m(1).alias("said"), "num_chars")


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    lexicon = _docs(spark, d).select(F.explode(t.words(F.lower(F.col("text")))).alias("word")).where("word rlike '^[a-z]{4,6}$'").distinct()
    return features.feature_rows(spread(_docs(spark, d).where("text is not null")), lexicon)


@query
def feat_rows(spark: SparkSession, d: str) -> DataFrame:
    out = _feature_rows(spark, d)
    maps = [f.name for f in out.schema.fields if f.dataType.typeName() == "map"]
    # in a form that other engines have too
    value = lambda m, v: F.array_join(v, ",") if m == "common_noun_hypernyms" else v.cast("string")
    shown = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), value(m, e["value"])))
    return out.select(*[c for c in out.columns if c not in maps], *[shown(m).alias(m) for m in maps])


@query
def feat_hypernyms(spark: SparkSession, d: str) -> DataFrame:
    """Lowest common ancestors under a small lexicon: a noun, its last word, and the thing as such."""
    nouns = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+ (?:baskets|boxes|crates|jars|trays|barrels|sacks|bottles|urns))"), 1)).alias("noun"))
    words = nouns.select("noun").distinct()
    lexicon = words.select("noun", F.substring_index("noun", " ", -1).alias("ancestor"), F.lit(2).alias("depth")).unionByName(words.select("noun", F.lit("container").alias("ancestor"), F.lit(1).alias("depth")))
    return features.common_hypernyms(nouns, lexicon, ["entity"])
