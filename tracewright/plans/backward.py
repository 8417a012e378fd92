"""Samples whose instruction describes what their reasoning shows already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import features, instruct, trace
from tracewright.operators.dataset import positional_split, well_formed_pair


def reasoned(samples: DataFrame) -> DataFrame:
    """``sample_id, user, cot, response`` of well-formed samples with reasoning, each id once."""
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    return (
        samples.where(well_formed_pair(F.col("messages")))
        .select("sample_id", turn(0).alias("user"), trace.split_thought(trace.normalize_tags(turn(1))).alias("s"))
        .where("s is not null")
        .dropDuplicates(["sample_id"])
        .select("sample_id", "user", "s.cot", "s.response")
    )


def backward_samples(samples: DataFrame, templates: DataFrame, lexicon: DataFrame | None = None, share: float = 0.9) -> DataFrame:
    """``sample_id, part, messages``: features of the reasoning rendered as constraints before the question.

    The first ``share`` of the samples by id are for training, the rest for tests.
    """
    parts = reasoned(samples)
    texts = parts.select("sample_id", F.col("cot").alias("text"))
    values = features.feature_values(features.feature_rows(texts, lexicon, "sample_id"), "sample_id")
    lines = instruct.render(values, templates, "sample_id")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.concat(F.lit("<think>\n"), F.col("cot"), F.lit("\n</think>\n\n"), F.col("response"))
    made = parts.join(lines, "sample_id").select(
        "sample_id", F.array(message("user", instruct.with_constraints(F.col("user"), F.col("instructions"))), message("assistant", said)).alias("messages")
    )
    return positional_split(made, share, "sample_id")
