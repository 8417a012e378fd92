"""Instructions that a program can check: generate, verify, filter, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.external import BackTranslator, CaseResponder, FunctionWriter, Generator, HashJudge, generated
from tracewright.functions.text import lines, strip
from tracewright.operators import pipeline as p
from tracewright.operators.dataset import numbered
from tracewright.operators.evaluators import EVALUATORS
from tracewright.operators.instruct import prompt
from tracewright.shared import written


class Verified(NamedTuple):
    """What the stages leave: ``functions`` (tested), ``instructions`` (not contradicted), ``responses`` with both verdicts, ``preferences``."""

    functions: DataFrame
    instructions: DataFrame
    responses: DataFrame
    preferences: DataFrame


def written_functions(seeds: DataFrame, writer: Callable[[], Generator] = FunctionWriter, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """``instruction_id, function_name`` and ``instruction_id, case_id, input, output`` from ``k`` answers per seed.

    The first line of a cleaned function names it; names without a registered
    evaluator are left out, since text from data is never executed.  Answers
    are written, so that a generator is asked once.
    """
    ask = prompt("eval_function", instruction=F.concat(F.col("instruction"), F.lit(" #"), F.col("attempt").cast("string")))
    answers = written(generated(p.asked_k_times(seeds, k).withColumn("prompt", ask), writer).select("instruction_id", "attempt", "answer"), "answers")
    parsed = answers.select("instruction_id", "attempt", p.parsed_function(F.col("answer")).alias("f")).where("f is not null")
    name = strip(F.get(lines(p.cleaned_function(F.col("f.func"))), F.lit(0)))
    functions = parsed.select("instruction_id", name.alias("function_name")).where(F.col("function_name").isin(list(EVALUATORS))).distinct()
    cases = parsed.select("instruction_id", "attempt", F.posexplode("f.cases").alias("at", "c"))
    return functions, cases.select("instruction_id", (F.col("attempt") * 1000 + F.col("at")).alias("case_id"), "c.input", "c.output")


def uncontradicted(seeds: DataFrame, functions: DataFrame, translator: Callable[[], Generator] = BackTranslator) -> DataFrame:
    """``instruction_id, function_name, instruction`` of functions whose translations back do not contradict the instruction."""
    rows = functions.select("instruction_id", "function_name").join(seeds, "instruction_id")
    answers = generated(rows.withColumn("prompt", prompt("back_translate", func=F.concat_ws(" ", "function_name", "instruction"))), translator)
    back = answers.withColumn("back_instruction", F.from_json("answer", "array<string>")).where("back_instruction is not null")
    return p.consistent_instructions(back).select("instruction_id", "function_name", "instruction")


def responded(instructions: DataFrame, queries: DataFrame, responder: Callable[[], Generator] = CaseResponder, k: int = 2) -> DataFrame:
    """``response_id, instruction_id, response, query``: ``k`` responses to each instruction, each to another query.

    ``queries``: ``query``; they are numbered, and an instruction's id picks its own.
    """
    numbers = numbered(queries.select("query").distinct(), "query", name="query_no")
    n = queries.select("query").distinct().count()
    asked = p.asked_k_times(instructions.select("instruction_id", "instruction").distinct(), k)
    asked = asked.withColumn("query_no", F.pmod(F.col("instruction_id") * k + F.col("attempt"), F.lit(max(n, 1))) + 1).join(numbers, "query_no")
    ask = prompt("rewrite", instruction=F.col("instruction"), response=F.lit(""), query=F.col("query"))
    answers = generated(asked.withColumn("prompt", ask), responder, out_col="response")
    return answers.select((F.col("instruction_id") * k + F.col("attempt")).alias("response_id"), "instruction_id", "response", "query")


def generate_verify_filter(seeds: DataFrame, queries: DataFrame, judge: Callable[[], Generator] = HashJudge, judgements: int = 3, above: float = 5.0) -> Verified:
    """The whole plan over ``seeds`` (``instruction_id, instruction``) and ``queries`` (``query``).

    A response counts as positive if its instruction's functions accept it and
    judges rate it above ``above`` on the average.
    """
    functions, cases = written_functions(seeds)
    tested = p.tested_functions(functions, cases)
    instructions = written(uncontradicted(seeds, tested), "instructions")
    verified = written(p.verified_responses(responded(instructions, queries), instructions.select("instruction_id", "function_name")), "verified")
    ask = prompt("judge", instruction=F.col("attempt").cast("string"), response=F.col("response"), query=F.col("query"))
    scores = p.judged(generated(p.asked_k_times(verified, judgements).withColumn("prompt", ask), judge), "response_id", above=above)
    both = verified.withColumnRenamed("kept", "verified").join(scores.withColumnRenamed("kept", "liked"), "response_id").withColumn("kept", F.col("verified") & F.col("liked"))
    return Verified(tested, instructions, both, p.preferences(both))
