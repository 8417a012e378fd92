"""Generate, verify, filter: instructions, checking functions, responses, judgements.

Stages that are alike for all rows are made once and joined; generators run in
``mapInPandas`` and their answers carry the id of their prompt.  Checking
functions are names in the registry of evaluators: source text that comes with
data is parsed and cleaned, never executed.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.external import Generator, WordOverlapNli, generated
from tracewright.functions.text import let, lines, strip
from tracewright.operators.dataset import new_values, seeded_key
from tracewright.operators.evaluators import scores
from tracewright.operators.instruct import prompt

# Words that disqualify a line of a generated function.
FORBIDDEN = ["download", "requests"]
EVAL_SCHEMA = "struct<func:string,cases:array<struct<input:string,output:string>>>"
MOST_SEEDS = 50


def bulleted(text: Column) -> Column:
    """Lines that begin with "- ", without it."""
    found = F.filter(lines(text), lambda x: strip(x).startswith("- "))
    return F.transform(found, lambda x: strip(F.regexp_replace(strip(x), "^- ", "")))


def new_seeds(answers: DataFrame, known: DataFrame, column: str = "instruction", answer_col: str = "answer") -> DataFrame:
    """Instructions from generated lists that are not among the known ones, each once."""
    return new_values(answers.select(F.explode(bulleted(F.col(answer_col))).alias(column)).where(F.col(column) != ""), known, column)


def grown_seeds(known: DataFrame, generator: Callable[[], Generator], rounds: int = 1, n: int = 10, seed: int = 0) -> DataFrame:
    """Known and new instructions after some rounds of generation."""
    for k in range(rounds):
        some = known.orderBy(seeded_key(F.col("instruction"), seed + k)).limit(MOST_SEEDS)
        asked = some.agg(F.array_join(F.array_sort(F.collect_list("instruction")), "\n").alias("s")).select(prompt("seed", seeds=F.col("s"), n=F.lit(str(n))).alias("prompt"))
        known = known.select("instruction").unionByName(new_seeds(generated(asked, generator), known))
    return known


def asked_k_times(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def parsed_function(answer: Column) -> Column:
    """``func, cases`` from a fenced block, else from the first object with a "func"; null if neither parses."""
    fenced = F.regexp_extract(answer, r"(?s)```json(.*?)```", 1)
    loose = F.regexp_extract(answer, r'(?s)(\{.*?"func".*\})', 1)
    # a block that is not JSON to its end counts for nothing, though a part of it could be read
    parse = lambda x: F.when(F.try_parse_json(strip(x)).isNotNull(), F.from_json(strip(x), EVAL_SCHEMA))
    first = parse(fenced)
    chosen = F.when(first["func"].isNotNull(), first).otherwise(parse(loose))
    return F.when(chosen["func"].isNotNull(), chosen)


def cleaned_function(func: Column) -> Column:
    """Without lines that fetch things."""
    bad = lambda x: F.coalesce(*[F.when(x.contains(w), True) for w in FORBIDDEN], F.lit(False))
    return F.array_join(F.filter(lines(func), lambda x: ~bad(x)), "\n")


def suspicious_lines(functions: DataFrame, func_col: str = "func") -> DataFrame:
    """Distinct lines that import or fetch."""
    rows = functions.select(F.explode(lines(F.col(func_col))).alias("line"))
    return rows.where(F.col("line").rlike("import|" + "|".join(FORBIDDEN))).distinct()


def expected(output: Column) -> Column:
    """Expected output of a case as a boolean."""
    return F.lower(output) == "true"


def _listed(functions: DataFrame) -> DataFrame:
    """The functions of each instruction in one row; they are names in a registry, so the lists are short."""
    return functions.groupBy("instruction_id").agg(F.array_sort(F.collect_set("function_name")).alias("names"))


def tested_functions(functions: DataFrame, cases: DataFrame, least: float = 0.5) -> DataFrame:
    """Functions with their accuracy over the cases that at least one function reproduces.

    ``functions``: ``instruction_id, function_name``; ``cases``:
    ``instruction_id, case_id, input, output``.  All functions of a case are
    run in one projection, and only names and bits go on.  Functions below
    ``least`` are dropped; one without cases has accuracy 0.
    """
    right = lambda x: F.struct(x["function_name"].alias("function_name"), x["score"].eqNullSafe(expected(F.col("output")).cast("long")).alias("ok"))
    found = F.transform(scores(F.col("names"), F.col("input"), F.col("input")), right)
    # bound, since a filter would be pushed below and run all functions again
    told = let(found, lambda x: F.when(F.exists(x, lambda y: y["ok"]), x))
    bits = cases.join(_listed(functions), "instruction_id").select("instruction_id", F.explode(told).alias("f"))
    score = bits.groupBy("instruction_id", F.col("f.function_name").alias("function_name")).agg(F.avg(F.col("f.ok").cast("double")).alias("accuracy"))
    return (
        functions.join(score, ["instruction_id", "function_name"], "left")
        .select("instruction_id", "function_name", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
        .where(F.col("accuracy") >= least)
    )


def first_parsed(attempts: DataFrame, id_col: str, parsed: Column) -> DataFrame:
    """The first attempt of each row that parses to a list of texts; rows without one are dropped."""
    rows = attempts.select(id_col, "attempt", F.from_json(parsed, T.ArrayType(T.StringType())).alias("texts")).where("texts is not null")
    return rows.groupBy(id_col).agg(F.min_by("texts", "attempt").alias("texts"))


@F.pandas_udf(T.StringType())
def _overlap_label(a: pd.Series, b: pd.Series) -> pd.Series:
    nli = WordOverlapNli()
    return pd.Series([None if x is None or y is None else nli.label(x, y) for x, y in zip(a, b, strict=True)])


def consistent_instructions(rows: DataFrame, label: Callable[[Column, Column], Column] = _overlap_label, first: int = 3) -> DataFrame:
    """Rows (``instruction, back_instruction array``) of which no translation back contradicts the instruction."""
    labels = [label(F.col("instruction"), F.get("back_instruction", F.lit(i))) for i in range(first)]
    return rows.withColumn("nli_scores", F.filter(F.array(*labels), lambda x: x.isNotNull())).where(~F.array_contains("nli_scores", "contradiction"))


def query_of(prompt_: Column) -> Column:
    """Text after the query mark."""
    return strip(F.regexp_extract(prompt_, r"(?s)\[Query\](.*)$", 1))


def score_of(text: Column) -> Column:
    """The first ``Score: n`` in a judgement; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"Score:\s*(\d+)", 1), F.lit("")).try_cast("int")


def last_score_of(text: Column) -> Column:
    """Older behaviour: one digit at the very end."""
    return F.nullif(F.regexp_extract(text, r"Score: (\d+?)\z", 1), F.lit("")).try_cast("int")


def judged(judgements: DataFrame, id_col: str, text_col: str = "answer", above: float = 5.0) -> DataFrame:
    """Mean score per item, 0 without any score, and whether it is kept."""
    mean = F.coalesce(F.avg(score_of(F.col(text_col))), F.lit(0.0))
    return judgements.groupBy(id_col).agg(F.round(mean, 9).alias("mean_score"), (mean > above).alias("kept"))


def verified_responses(responses: DataFrame, functions: DataFrame) -> DataFrame:
    """Responses with the mean result of their instruction's functions; kept above 0.

    ``responses``: ``response_id, instruction_id, response, query``.  All
    functions of a response are run in its row.  Equal responses to an
    instruction are kept once, the first by id; they are compared by digest.
    """
    found = F.filter(F.transform(scores(F.col("names"), F.col("response"), F.col("response")), lambda x: x["score"]), lambda x: x.isNotNull())
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    result = let(found, lambda x: F.when(F.size(x) > 0, total(x) / F.size(x)).otherwise(0.0))
    mean = responses.join(_listed(functions), "instruction_id").select("response_id", "instruction_id", "response", "query", result.alias("mean_result"))
    once = mean.groupBy("instruction_id", F.md5("response").alias("_r"), F.md5("query").alias("_q")).agg(F.min(F.struct("response_id", "response", "query", "mean_result")).alias("x"))
    return once.select("x.response_id", "instruction_id", "x.response", "x.query", "x.mean_result", (F.col("x.mean_result") > 0).alias("kept"))


def preferences(rows: DataFrame) -> DataFrame:
    """Messages with 1 for kept and 0 for rejected answers."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.select(F.array(message("user", "query"), message("assistant", "response")).alias("messages"), F.col("kept").cast("int").alias("is_positive"))


def hindsight(rows: DataFrame, generator: Callable[[], Generator]) -> DataFrame:
    """``question, answer`` with the instruction that fits them."""
    return generated(rows.withColumn("prompt", prompt("hindsight", question=F.col("question"), answer=F.col("answer"))), generator, out_col="instruction").drop("prompt")


def repaired_json(text: Column) -> Column:
    """An object whose ``func`` holds unescaped quotes or line ends, with that part escaped again."""
    head = F.regexp_extract(text, r'(?s)^(.*?"func"\s*:\s*")', 1)
    body = F.regexp_extract(text, r'(?s)"func"\s*:\s*"(.*)"\s*,\s*"cases"', 1)
    tail = F.regexp_extract(text, r'(?s)"func"\s*:\s*".*("\s*,\s*"cases".*)$', 1)
    escaped = body
    for a, b in (("\\\\", "\\"), ('\\"', '"'), ("\\n", "\n"), ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.when(body != "", F.concat(head, escaped, tail)).otherwise(text)
