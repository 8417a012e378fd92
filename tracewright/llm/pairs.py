"""Problems 2 and 3 over this project's tables: features, defects and cuts.

A response is judged with its prompt (:mod:`tracewright.llm.pairrules`) in one
pass over Arrow batches; what a single pair cannot show (spikes of length,
shortened versions among sorted neighbours) is added by
:func:`tracewright.llm.truncation.resolved`.

Defined results: a pair whose response is null or missing is ``empty``; a
null or blank prompt allows no copy or language defect; repeated rows of an id
count once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.endings import LABELLED, ending, without_marks
from tracewright.llm.fold import fold
from tracewright.llm.languages import LanguageModel, fit, plain
from tracewright.llm.pairrules import judge, prompt_reader
from tracewright.llm.shared import written
from tracewright.llm.truncation import FEATURES, resolved, shortened

_DONE = re.compile(r"\s*(?:[.!?;](?!\d)|,(?!\d)|$|\n)|[ \t]+\|")


def _label(name: str, column: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(column.cast("string"), F.lit("")))


def pair_features(pairs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``pairs``: ``table_name, record_id, source, groups, prompt, response``; languages are judged with a ``model``."""
    held = pairs.sparkSession.sparkContext.broadcast(model)  # at most languages.WORDS words

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        read = prompt_reader(model)
        for b in batches:
            v = [judge(p, r, model, read) for p, r in zip(b["prompt"], b["response"], strict=True)]
            out = b[["table_name", "record_id", "source", "groups"]].copy()
            for name in ("state", "tail", "chars", "octets", "defect", "punctuated"):
                out[name] = [getattr(x, name) for x in v]
            # few: what ends closed or is cut already needs no neighbour
            out["open_text"] = [r if x.state == "open" and x.defect in (None, "other_language") else None for r, x in zip(b["response"], v, strict=True)]
            yield out

    return pairs.mapInPandas(judged, FEATURES)


def broken_pairs(pairs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every pair with its defect or null: ``table_name, record_id, source, defect, signal``.

    ``labelled`` (``text, lang``) is what the language model is fitted on;
    without it the plain lists are used.  ``signal`` names what showed a cut.
    """
    model = fit(labelled) if labelled is not None else plain()
    features = written(pair_features(pairs, model), "pairs")
    found = resolved(features, shortened_responses(pairs, features))
    early = F.col("defect").isin("empty", "copy", "refusal")
    defect = F.when(early, F.col("defect")).when(F.col("truncated"), "truncated").otherwise(F.col("defect"))
    return found.select(
        "table_name", "record_id", "source", defect.alias("defect"), F.when(defect == "truncated", F.col("signal")).alias("signal")
    ).dropDuplicates(["table_name", "record_id"])


def shortened_responses(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Records whose response is a shortened version of another one: ``table_name, record_id``.

    Responses that end open are looked for among all: a response that another
    one continues shares with it the hash of its first 2^i characters, 2^i
    being the largest power within its length.  Only responses that share such
    a hash with an open one are sorted by their text and compared with the
    neighbours that follow (:func:`tracewright.llm.truncation.shortened`).
    """
    power = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    head = lambda t, i: F.xxhash64(i, F.substring(t, F.lit(1), F.pow(F.lit(2), i).cast("int")))
    # a hash names a row; a collision would only sort a text more
    row = F.xxhash64("table_name", "record_id").alias("row")
    texts = pairs.where("response is not null").select(row, F.col("response").alias("text"))
    opened = features.where("length(open_text) > 0").select("table_name", "record_id", F.col("open_text").alias("text"), power(F.length("open_text")).alias("i"))
    short = opened.select("*", row, head(F.col("text"), F.col("i")).alias("head"))
    sizes = sorted(r.i for r in short.select("i").distinct().collect())  # at most 31 powers of two
    if not sizes:
        return short.select("table_name", "record_id")
    # hashes only are shuffled: a text gives one for each power of two within its length
    heads = F.array(*[F.when(F.length("text") >= (1 << i), head(F.col("text"), F.lit(i))) for i in sizes])
    placed = texts.select("row", F.explode(F.filter(heads, lambda h: h.isNotNull())).alias("head"))
    shared = placed.groupBy("head").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("head")
    wanted = written(short.join(shared, "head", "left_semi").select("table_name", "record_id", "text", "head"), "short")
    near = placed.join(wanted.select("head").distinct(), "head", "left_semi").select("row").distinct()
    every = written(texts.join(near, "row", "left_semi").select("text").distinct().withColumn("support", F.lit(1).cast("long")), "short")
    return wanted.join(shortened(every).select("text"), "text", "left_semi").select("table_name", "record_id").distinct()


def stands(result: str, *contexts: str | None) -> bool | None:
    """True if the result stands complete in a text it was taken from, False if it only stands there with more to come, null if it does not stand there.

    A bare number, or one word that is not continued inside it, may stand
    elsewhere by chance and with more to come proves nothing.
    """
    one_word = not re.search(r"\s", result)
    seen = False
    for text in contexts:
        at = text.find(result) if text else -1
        while at >= 0:
            if at == 0 or not (text[at - 1].isalnum() and result[0].isalnum()):
                end = at + len(result)
                if _DONE.match(text, end):
                    return True
                inside = result[-1].isalnum() and text[end : end + 1].isalnum()
                seen = seen or not one_word or (inside and not result.isdecimal())
            at = text.find(result, at + 1)
        if seen:
            break
    return False if seen else None


def _result_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for table, record, source, groups, results, chunks, trace in zip(
            b["table_name"], b["record_id"], b["source"], b["groups"], b["results"], b["chunks"], b["trace"], strict=True
        ):
            folded = None
            for i, r in enumerate(results):
                if r is None:
                    continue
                end = ending(r)
                state, tail = end.state, end.tail
                core, mark = without_marks(fold(r).strip())
                core = core.rstrip()
                if core and state != "blank":
                    chunk = fold(chunks[i]) if chunks is not None and i < len(chunks) and chunks[i] else None
                    told = stands(core, chunk)
                    if told is None and trace:
                        folded = folded or fold(trace)
                        told = stands(core, folded)
                    if told is not None:
                        state = "cut" if mark or not told else "closed"
                rows.append((table, record, source, groups, state, tail, end.chars, end.octets, None, False, None))
        if rows:
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "source", "groups", "state", "tail", "chars", "octets", "defect", "punctuated", "open_text"])


def result_features(traces: DataFrame) -> DataFrame:
    """``traces``: ``table_name, record_id, source, groups, results array<string>, chunks array<string>, trace``; one row per result."""
    return traces.mapInPandas(_result_rows, FEATURES)


def cut_records(pairs: DataFrame, traces: DataFrame) -> DataFrame:
    """Outputs and traces with ``truncated`` and the signal that shows it: ``table_name, record_id, source, truncated, signal``."""
    # open ends are the rule among results: their tails are no sentences to compare
    results = result_features(traces).withColumn("tail", F.when(F.col("state") == "open", F.concat(F.lit(LABELLED + "result "), "tail")))
    features = written(pair_features(pairs).unionByName(results), "cuts")
    found = resolved(features, shortened_responses(pairs, features))
    early = F.coalesce(F.col("defect").isin("empty", "copy", "refusal"), F.lit(False))
    cut = F.col("truncated") & ~early
    return found.groupBy("table_name", "record_id").agg(
        F.max("source").alias("source"), F.max(cut).alias("truncated"), F.min(F.when(cut, F.col("signal"))).alias("signal")
    )


def sample_pairs(samples: DataFrame) -> DataFrame:
    """User and assistant turn of samples, in the form that :func:`broken_pairs` takes."""
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    return samples.select(
        F.lit("samples").alias("table_name"), F.col("sample_id").cast("long").alias("record_id"), "source",
        F.array(_label("source", F.col("source"))).alias("groups"), turn(0).alias("prompt"), turn(1).alias("response"),
    )


def output_pairs(outputs: DataFrame) -> DataFrame:
    """Instruction and response of model outputs, in the form that :func:`broken_pairs` takes."""
    return outputs.select(
        F.lit("model_outputs").alias("table_name"), F.col("output_id").cast("long").alias("record_id"), "source",
        F.array(_label("source", F.col("source")), _label("run", F.col("run_id"))).alias("groups"),
        F.col("instruction").alias("prompt"), F.col("model_response").alias("response"),
    )


def trace_results(traces: DataFrame) -> DataFrame:
    """Annotation results of traces, in the form that :func:`result_features` takes."""
    return traces.where(F.col("`partial_solutions-annotation`").isNotNull()).select(
        F.lit("annotated_traces").alias("table_name"), F.col("trace_id").cast("long").alias("record_id"), "source",
        F.array(_label("source", F.col("source"))).alias("groups"),
        F.transform(F.col("`partial_solutions-annotation`"), lambda a: a["result"]).alias("results"),
        F.col("`partial_solutions-chunks`").alias("chunks"), "trace",
    )
