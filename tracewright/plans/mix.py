"""The mix: samples whose reasoning follows an instruction, split by function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import instruct, trace
from tracewright.operators import transforms as tr
from tracewright.operators.dataset import well_formed_pair

# Functions for training, and those held out.
TRAIN_FUNCTIONS = """upper_case_forward title_case_forward replace_and_ampersand_forward avoid_the_forward one_word_per_line_forward
use_multiple_spaces_forward sentences_per_line_forward commas_to_semicolons_forward add_line_numbers_forward json_of_paragraphs_forward
indent_paragraphs_forward insert_sentence_divider_forward render_as_html_forward upper_case_backward title_case_backward palindromes_backward
hypernyms_backward""".split()
HELD_OUT_FUNCTIONS = "bracket_sentences_forward highlight_logical_words_forward lower_case_forward full_stops_to_exclamation_marks_forward paragraph_count_backward".split()


def synthesize(samples: DataFrame, functions: list[str] | None = None) -> DataFrame:
    """One transformed sample per row: ``sample_id, part, messages, applied_functions, num_chars``.

    One scan and one projection: tags are normalized, the reasoning is split
    off, a function is chosen by id, applied, and the turns are wrapped.  Rows
    without reasoning, or whose function does not apply or changes nothing,
    are dropped.
    """
    names = functions or [n for n in TRAIN_FUNCTIONS + HELD_OUT_FUNCTIONS if n in tr.FORWARD or n in tr.BACKWARD]
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    parts = (
        samples.where(well_formed_pair(F.col("messages")))
        .select("sample_id", turn(0).alias("user"), trace.split_thought(trace.normalize_tags(turn(1))).alias("s"))
        .where("s is not null")
        .dropDuplicates(["sample_id"])
        .select("sample_id", "user", "s.cot", "s.response", instruct.one_function(F.col("sample_id"), names).alias("function_name"))
    )
    made = F.lit(None).cast("struct<description:string,new_text:string>")
    for n in names:
        result = tr.apply_forward(n, F.col("cot")) if n in tr.FORWARD else tr.BACKWARD[n](F.col("cot"))
        made = F.when(F.col("function_name") == n, result).otherwise(made)
    done = parts.withColumn("r", made).where("r.new_text is not null or r.description is not null")
    backward = F.col("function_name").isin(list(tr.BACKWARD))
    done = done.where(backward | instruct.kept(F.col("cot"), F.col("r.new_text"), F.col("function_name")))
    wrapped = done.withColumn("messages", instruct.wrap_sample(F.col("user"), F.col("r.new_text"), F.col("response"), F.col("r.description")))
    return wrapped.select(
        "sample_id", F.when(F.col("function_name").isin(HELD_OUT_FUNCTIONS), "ood_test").otherwise("train").alias("part"), "messages",
        F.col("function_name").alias("applied_functions"), instruct.num_chars(F.col("messages")).alias("num_chars"),
    )
