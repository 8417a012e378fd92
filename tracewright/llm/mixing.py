"""Problem 7: mixing sources to target weights.

Capped water-filling over the token totals of the sources (one row per target
source on the driver, bounded by the table of targets): a source that would be
used more than ``max_repeats`` times is clamped there and what is missing is
spread over the others in proportion to their weights, until nothing changes.
Every record is then used ``floor(r)`` times, and a seeded part of the records
once more: those first in hash order, up to the tokens still due.

The cut in hash order is found from totals per source and hash bucket, and
only the bucket at the cut is ordered row by row, so a source that holds a
third of all rows is not ordered in one task.  Texts are read once; ids,
sources and token counts go to the shared folder.

Defined results: null or empty texts have no tokens and are not drawn; rows of
a null or unlisted source are not drawn; a repeated id counts once; a listed
source without records is reported with share 0; empty tables give a report
of zeros; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
MAX_TARGETS = 100_000
MAX_VOCABULARY_BYTES = 64 << 20


class Share(NamedTuple):
    source: str
    weight: float
    cap: float
    due: float


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Amount per name: in proportion to the weights, none above its cap, the sum as near to ``total`` as the caps allow."""
    out: dict[str, float] = {}
    open_ = {s: w for s, w in weights.items() if w > 0}
    out |= {s: 0.0 for s in weights if s not in open_}
    left = min(total, sum(caps[s] for s in open_))
    while open_:
        scale = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * scale >= caps[s]]
        if not full:
            out |= {s: w * scale for s, w in open_.items()}
            break
        for s in full:
            out[s] = caps[s]
            left -= caps[s]
            del open_[s]
    return out


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id``, kept columns and ``tokens`` of each row with a text."""
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary above {MAX_VOCABULARY_BYTES} bytes")
    held = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *keep, F.col(text_col).alias("_text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"]).add("tokens", "long")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        coder = None
        for b in batches:
            if coder is None:
                ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, held.value.splitlines())}
                coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            out = b.drop(columns="_text")
            out["tokens"] = [len(coder.encode_ordinary(t)) for t in b["_text"]]
            yield out

    return rows.mapInPandas(count, schema)


class Mix(NamedTuple):
    drawn: DataFrame
    report: DataFrame


def mix_sources(
    docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", total_tokens: int | None = None,
    seed: int = 0, vocabulary: str = VOCABULARY, pattern: str = PATTERN,
) -> Mix:
    """Draw records so that each source has its share of all tokens.

    ``targets``: ``source, target_share, max_repeats``.  ``total_tokens`` is
    what the mix is to hold, by default as much as the listed sources hold.
    ``drawn``: ``id, source, tokens, repeats`` (1 or more).  ``report``:
    ``source, target_share, max_repeats, available_tokens, due_tokens,
    drawn_tokens, actual_share, repeats_most, met``.
    """
    spark = docs.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    counts = written(
        token_counts(docs, id_col, text_col, ["source"], vocabulary, pattern)
        .where("source is not null and tokens > 0")
        .dropDuplicates(["id"])
        .withColumn("_hash", F.xxhash64("id", F.lit(seed)))
        .withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(BUCKETS)).cast("int")),
        "mix",
    )
    names = targets.select("source").distinct()
    have = {r.source: r.n for r in counts.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    weights = {r.source: float(r.target_share or 0) for r in wanted}
    caps = {r.source: float(have.get(r.source, 0)) * max(int(r.max_repeats or 0), 0) for r in wanted}
    total = float(total_tokens if total_tokens is not None else sum(have.values()))
    due = water_fill(weights, caps, total)
    plan = []
    for r in wanted:
        n = have.get(r.source, 0)
        whole = min(int(due[r.source] // n), int(r.max_repeats)) if n else 0
        plan.append((r.source, float(r.target_share or 0), int(r.max_repeats or 0), n, due[r.source], whole, due[r.source] - whole * n if n else 0.0))
    plans = spark.createDataFrame(plan, "source string, target_share double, max_repeats long, available_tokens long, due_tokens double, _whole int, _rest double")
    # The bucket in which the rest runs out.
    by_bucket = counts.groupBy("source", "_bucket").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (
        by_bucket.withColumn("_before", before)
        .join(F.broadcast(plans.select("source", "_rest")), "source")
        .where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("n") >= F.col("_rest")))
        .select("source", F.col("_bucket").alias("_cut"), "_before")
    )
    # one row per target source on either side, at most MAX_TARGETS
    rows = counts.join(F.broadcast(plans.select("source", "_whole", "_rest")), "source").join(F.broadcast(cut), "source", "left")
    earlier = rows.where("_rest > 0 and (_cut is null or _bucket < _cut)").withColumn("_extra", F.lit(1))
    later = rows.where("not (_rest > 0 and (_cut is null or _bucket < _cut)) and not (_rest > 0 and _bucket = _cut)").withColumn("_extra", F.lit(0))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("_hash", "id").rowsBetween(Window.unboundedPreceding, 0))
    at_cut = (
        rows.where("_rest > 0 and _bucket = _cut")
        .withColumn("_extra", F.when(F.col("_before") + running - F.col("tokens") / 2 <= F.col("_rest"), 1).otherwise(0))
    )  # the record at the cut is taken if that comes nearer
    drawn = (
        earlier.unionByName(later).unionByName(at_cut)
        .select("id", "source", "tokens", (F.col("_whole") + F.col("_extra")).cast("long").alias("repeats"))
        .where("repeats > 0")
    )
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("g"), F.max("repeats").alias("repeats_most"))
    everything = F.sum(F.coalesce("g", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    actual = F.when(everything > 0, F.coalesce("g", F.lit(0)) / everything).otherwise(0.0)
    report = plans.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", "due_tokens",
        F.coalesce("g", F.lit(0)).alias("drawn_tokens"), actual.alias("actual_share"),
        F.coalesce("repeats_most", F.lit(0)).alias("repeats_most"),
        (F.abs(actual - F.col("target_share")) <= 0.005).alias("met"),
    )
    return Mix(drawn, report)
