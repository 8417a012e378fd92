"""Problem 2: texts cut off by a field limit or on the way.

Per group (source, run) and column, histograms of length in characters and in
bytes are searched for spikes at the maximum; a text of a spike's length
without final punctuation is flagged.  Texts that broke off elsewhere are
known by other signals: their end (an open tag or formula, a hanging comma, a
mark of the cut), another text that goes on where they stop (sorted neighbours
with a common prefix, of whole texts and of last lines), an open sentence after
sentences of the same text that end with punctuation, or an open sentence in a
source whose texts do not otherwise end so.  Results taken from a text are
checked against that text.  The report counts each signal.

Only lengths, states, last lines and the texts that end open are shuffled.  The
histogram is aggregated before it is shuffled, so a hot source costs one row
per length.  Features are written once to the shared folder.

Defined results: null and blank texts are not truncated; complete texts
without final punctuation are not; a repeated id counts once; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.endings import LABELLED
from tracewright.llm.shared import written

#: A spike has this many texts of one length ...
MIN_SPIKE = 4
#: ... and this many times the mean of the lengths just below it,
SPIKE_LIFT = 6.0
#: and at most this share of the group is longer.
MAX_BEYOND = 0.02
#: Lengths below a spike that it is compared with.
NEAR = 8
#: Open sentences of texts without an earlier sentence are cuts where at most this share of a group's texts end so.
MAX_OPEN_SHARE = 0.2
#: Rows by which the share in the whole table counts in that of a source.
PRIOR = 20

#: What shows a cut, the first that holds.
SIGNALS = ("spike", "ending", "neighbour", "sentence", "source")
#: Prefixes that may wait at the ends of sorted partitions.
MAX_WAITING = 1_000_000

FEATURES = (
    "table_name string, record_id long, source string, groups array<string>, state string, tail string, chars int, octets int, defect string, punctuated boolean, open_text string"
)


def length_spikes(features: DataFrame) -> DataFrame:
    """Spikes at the maximum: ``table_name, grp, unit, length, texts``."""
    histogram = (
        features.where("state <> 'blank'")
        .select("table_name", F.explode("groups").alias("grp"), F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "octets")).alias("unit", "length"))
        .groupBy("table_name", "grp", "unit", "length")
        .agg(F.count("*").alias("texts"))
    )
    w = Window.partitionBy("table_name", "grp", "unit").orderBy("length")
    below = F.coalesce(F.sum("texts").over(w.rangeBetween(-NEAR, -1)), F.lit(0)) / NEAR
    beyond = F.coalesce(F.sum("texts").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    total = F.sum("texts").over(Window.partitionBy("table_name", "grp", "unit"))
    return (
        histogram.select("*", below.alias("below"), beyond.alias("beyond"), total.alias("total"))
        .where((F.col("texts") >= MIN_SPIKE) & (F.col("texts") >= SPIKE_LIFT * F.col("below")) & (F.col("beyond") <= MAX_BEYOND * F.col("total")))
        .select("table_name", "grp", "unit", "length", "texts")
    )


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each text of a sorted partition the largest support among texts that continue it; the digest of those that may go on in the next."""
    stack: list[list] = []
    names = ["text", "support", "longer", "pending"]
    for b in batches:
        out = []
        for text, n in zip(b["text"], b["support"], strict=True):
            while stack and not text.startswith(stack[-1][0]):
                out.append((*stack.pop(), None))
            for s in stack:
                s[2] = max(s[2], n)
            stack.append([text, n, 0])
        if out:
            yield pd.DataFrame(out, columns=names)
    if stack:
        yield pd.DataFrame([(*s, _digest(s[0])) for s in stack], columns=names)


def shortened(texts: DataFrame) -> DataFrame:
    """Texts that others continue: ``text, support, longer`` with the support of the most frequent continuation.

    ``texts``: ``text, support``, distinct.  They are sorted across the
    cluster and each is compared with the neighbours that follow it for as
    long as those begin with it.  What still waits at the end of a partition
    (a chain of prefixes of its last text) is looked up in a second pass by
    its length and digest.
    """
    ordered = texts.repartitionByRange("text").sortWithinPartitions("text")
    # written, since a second shuffle would draw other bounds and other texts would wait
    runs = written(ordered.mapInPandas(_sorted_runs, "text string, support long, longer long, pending binary"), "runs")
    # a few rows of 16 bytes for each partition: the prefixes of its last text
    waiting = runs.where("pending is not null").select("pending", F.length("text").alias("n")).limit(MAX_WAITING + 1).collect()
    if len(waiting) > MAX_WAITING:
        raise ValueError(f"more than {MAX_WAITING} prefixes at partition ends")
    held = texts.sparkSession.sparkContext.broadcast((frozenset(bytes(r.pending) for r in waiting), sorted({r.n for r in waiting})))

    def continued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests, lengths = held.value
        best: dict[str, int] = {}
        for b in batches:
            for text, n in zip(b["text"], b["support"], strict=True):
                for k in lengths:
                    if k >= len(text):
                        break
                    if n > best.get(head := text[:k], 0) and _digest(head) in digests:
                        best[head] = n
        if best:
            yield pd.DataFrame({"text": list(best), "longer": list(best.values())})

    after = texts.mapInPandas(continued, "text string, longer long").groupBy("text").agg(F.max("longer").alias("more"))
    waited = runs.where("pending is not null").select("text", "support", "longer").join(after, "text", "left")
    waited = waited.select("text", "support", F.greatest("longer", F.coalesce("more", F.lit(0))).alias("longer"))
    return runs.where("pending is null").select("text", "support", "longer").unionByName(waited).where("longer > 0")


def resolved(features: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """Features with the verdict ``truncated`` and the ``signal`` that shows it.

    ``short``: ``table_name, record_id`` of texts that others continue whole.
    Signals, the first that holds: ``spike`` (the length is a spike and the
    end has no final punctuation), ``ending`` (the end itself breaks off),
    ``neighbour`` (another text or last line goes on), ``sentence`` (open after
    sentences that end with punctuation), ``source`` (open where texts of the
    source seldom end so).
    """
    spikes = length_spikes(features)
    hit = (
        features.select("table_name", "record_id", F.explode("groups").alias("grp"), F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "octets")).alias("unit", "length"))
        .join(spikes, ["table_name", "grp", "unit", "length"], "left_semi")
        .select("table_name", "record_id", "length")
        .distinct()
    )
    # one length may be a spike for one of several results of a record only
    by_length = hit.groupBy("table_name", "record_id").agg(F.collect_set("length").alias("spike_lengths"))
    lines = features.where("tail is not null").groupBy(F.col("tail").alias("text")).agg(F.count("*").alias("support"))
    longer = lines.join(shortened(lines).select("text", "longer"), "text", "left").select(F.col("text").alias("tail"), "support", "longer")
    labelled = F.col("tail").startswith(LABELLED)
    opened = F.col("state") == "open"
    prose = opened & ~labelled
    table = Window.partitionBy("table_name")
    share = (
        features.where("state <> 'blank'").groupBy("table_name", "source").agg(F.count("*").alias("n"), F.count_if(prose).alias("o"))
        # one row per source; small sources lean on their table
        .select("table_name", "source", ((F.col("o") + PRIOR * F.sum("o").over(table) / F.sum("n").over(table)) / (F.col("n") + PRIOR)).alias("open_share"))
    )
    at_spike = F.array_contains("spike_lengths", F.col("chars")) | F.array_contains("spike_lengths", F.col("octets"))
    # the same last line of several texts is how they end, unless it goes on elsewhere
    broken = F.col("punctuated") & (F.col("support") < MIN_SPIKE)
    whole = features.sparkSession.createDataFrame([], "table_name string, record_id long") if short is None else short
    # "label: number unit" is whole if the unit is known
    usual = opened & labelled & (F.col("support") >= MIN_SPIKE)
    signal = (
        F.when(F.col("state").isin("blank", "closed"), None)
        .when(at_spike & ~F.coalesce(usual, F.lit(False)), "spike")
        .when(F.col("state") == "cut", "ending")
        .when(F.col("shown") | (F.col("longer") > F.col("support")), "neighbour")
        .when(prose & broken, "sentence")
        .when(prose & (F.coalesce("open_share", F.lit(0.0)) <= MAX_OPEN_SHARE), "source")
    )
    return (
        features.join(by_length, ["table_name", "record_id"], "left")
        .join(longer, "tail", "left")
        .join(share.withColumnRenamed("source", "s").withColumnRenamed("table_name", "t"), (F.col("t") == F.col("table_name")) & F.col("s").eqNullSafe(F.col("source")), "left")
        .join(whole.withColumn("shown", F.lit(True)), ["table_name", "record_id"], "left")
        .withColumn("signal", signal)
        .withColumn("truncated", F.col("signal").isNotNull())
        .drop("spike_lengths", "support", "longer", "t", "s", "open_share", "shown", "open_text")
    )


def truncation_report(records: DataFrame) -> DataFrame:
    """Per table and source: records, truncated ones and their share, and how many each signal shows.

    ``records``: ``table_name, record_id, source, truncated, signal``.
    """
    one = records.groupBy("table_name", "record_id").agg(F.max("source").alias("source"), F.max("truncated").alias("truncated"), F.min("signal").alias("signal"))
    return one.groupBy("table_name", "source").agg(
        F.count("*").alias("records"), F.count_if(F.col("truncated")).alias("truncated"), F.avg(F.col("truncated").cast("double")).alias("share"),
        *[F.count_if(F.col("signal") == s).alias(f"by_{s}") for s in SIGNALS],
    )
