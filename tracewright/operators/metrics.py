"""Aggregations: accuracy, calibration, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.evaluators import dispatch
from tracewright.operators.trace import reasoning, same_answer

#: Examples and tokens per example by which a run's time is projected.
PROJECTED_EXAMPLES = 50_000
PROJECTED_TOKENS = 1_500
OBSERVED_RATE = 0.04


def scored(outputs: DataFrame) -> DataFrame:
    """Instruction-following score of each output by the evaluator of its function.

    Empty reference reasoning: no row.  Empty model reasoning: 0.  Unknown
    function: no row.
    """
    model, gt = reasoning(F.col("model_response")), reasoning(F.col("gt_response"))
    judged = outputs.where((F.trim(gt) != "") & F.col("function_name").isNotNull()).select(
        "output_id", "function_name", "score",
        F.when(F.trim(F.coalesce(model, F.lit(""))) == "", F.lit(0).cast("long")).otherwise(dispatch(F.col("function_name"), model, gt)).alias("if_score"),
        F.when(F.trim(F.coalesce(model, F.lit(""))) == "", F.lit(0.0)).otherwise(same_answer(F.col("model_response"), F.col("gt_response"))).alias("answer_score"),
    )
    return judged.where("if_score is not null")


def rollup_by_function(rows: DataFrame) -> DataFrame:
    """Mean scores and counts per function, and over all (null function)."""
    return rows.rollup("function_name").agg(
        F.round(F.avg("if_score"), 9).alias("if_accuracy"), F.round(F.avg("score"), 9).alias("accuracy"), F.count("*").alias("examples")
    )


def gradable_accuracy(rows: DataFrame, correct: Column) -> DataFrame:
    """Accuracy among the gradable rows (``correct`` not null) and among all."""
    return rows.agg(
        F.count("*").alias("samples"), F.count(correct).alias("graded"),
        F.avg(correct.cast("double")).alias("accuracy_of_graded"),
        (F.sum(F.coalesce(correct, F.lit(False)).cast("long")) / F.count("*")).alias("accuracy"),
    )


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def ece(rows: DataFrame, p: Column, y: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; a probability of 0 is in none."""
    per = (
        rows.select(p.alias("p"), y.cast("double").alias("y"))
        .groupBy(F.ceil(F.col("p") * bins).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    )
    gap = F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0)
    return per.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def class_ratio(y: Column) -> Column:
    """Negatives for each positive; at least one positive is assumed."""
    return F.count_if(y == 0) / F.greatest(F.count_if(y == 1), F.lit(1))


def weighted_bce(p: Column, y: Column, weight: Column) -> Column:
    """Mean cross entropy with ``weight`` on positives."""
    return F.avg(F.when(y == 1, -weight * F.ln(p)).otherwise(-F.ln(1 - p)))


def rounded_accuracy(p: Column, y: Column) -> Column:
    """Share of right predictions; 0.5 rounds to even."""
    return F.avg((F.bround(p) == y).cast("double"))


def latency(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """Mean and 90th percentile (interpolated)."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 9).alias("mean"), F.round(F.percentile(value, 0.9), 9).alias("p90"))


def throughput(rows: DataFrame, group: str, at: Column, size: Column) -> DataFrame:
    """Rows, their total size, and both per second between the first and the last of a group; null where no time passed."""
    seconds = (F.max(F.unix_micros(at)) - F.min(F.unix_micros(at))) / 1e6
    made = rows.groupBy(group).agg(F.count("*").alias("examples"), F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("size"), seconds.alias("_s"))
    per = lambda c: F.round(F.when(F.col("_s") > 0, F.col(c) / F.col("_s")), 9)
    return made.select(group, "examples", "size", per("examples").alias("examples_per_second"), per("size").alias("size_per_second"))


def sweep(calls: DataFrame, setting: Column, ok: Column, seconds: Column) -> DataFrame:
    """Per setting: calls, successes, failures and the mean time of the successful ones."""
    return calls.groupBy(setting.alias("setting")).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("successes"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failures"),
        F.round(F.avg(F.when(ok, seconds)), 6).alias("mean_seconds"),
    )


def projected_hours(tokens_per_second: Column) -> Column:
    return F.when(tokens_per_second > 0, F.lit(PROJECTED_EXAMPLES * PROJECTED_TOKENS) / (tokens_per_second * 3600))


def speedup(tokens_per_second: Column) -> Column:
    """Against the observed rate of examples."""
    return tokens_per_second / (OBSERVED_RATE * PROJECTED_TOKENS)


def majority_label(scores: Column) -> Column:
    """Index from 0 of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def best_run(runs: DataFrame, rate: str = "avg_tokens_per_second") -> DataFrame:
    """The run with the highest rate, ties by id."""
    return runs.where(F.col(rate).isNotNull()).orderBy(F.desc(rate), "run_id").limit(1)


def benchmark_grid(gpus: int) -> list[tuple[int, int, float, int]]:
    """Configurations to try (tensor parallel, block, utilization, batch), most promising first, at most 20."""
    parallel = [x for x in (1, 2, 4, 8) if x <= gpus]
    top = max(parallel)
    batches = {x: [b for b in (1, 4, 8, 16, 32, 48, 64) if (x >= 4 and b >= 8) or (x == 1 and b <= 16) or (x == 2 and b <= 32)] for x in parallel}
    out = [
        (x, block, share, b)
        for x in parallel
        for block in ((8, 16, 32) if x == top else (16,))
        for share in ((0.8, 0.9, 0.95) if x == top else (0.95,))
        for b in batches[x]
    ]
    return sorted(out, key=lambda c: (-c[0], abs(c[1] - 16)))[:20]
