"""Reasoning traces: tags, answers, chunks, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as t

# Phrases that open a new line of thought.
NEW_PATH = ["wait", "double-check", "alternatively", "make sure", "another way", "verify", "to confirm"]
# Phrases of a first paragraph that repeats the instructions, and where they must begin.
RECALL = ["let me recall", "adhere to these instructions"]
RECALL_WITHIN = 220
# Tokens at which generated text ends.
STOP_TOKENS = ["<pad>", "</s>", "<|im_end|>", "<|endoftext|>"]


def normalize_tags(text: Column) -> Column:
    """Marker tokens as think tags, with one line end inside and a blank line after them; no trailing line ends."""
    for a, b in (("<|begin_of_thought|>", "<think>"), ("<|end_of_thought|>", "</think>"), ("<|begin_of_solution|>", ""), ("<|end_of_solution|>", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r"<think>\n+", "<think>\n")
    text = F.regexp_replace(text, r"\n+</think>", "\n</think>")
    text = F.regexp_replace(text, r"</think>\n+", "</think>\n\n")
    return F.regexp_replace(text, r"\n+\z", "")


def split_thought(text: Column) -> Column:
    """Struct ``cot, response`` of a text with one think block; null where it does not have one."""
    after = F.split(text, "<think>")
    inner = F.split(F.get(after, F.lit(1)), "</think>")
    return F.when(F.size(inner) == 2, F.struct(t.strip(F.get(inner, F.lit(0))).alias("cot"), t.strip(F.get(inner, F.lit(1))).alias("response")))


def split_thought_strict(text: Column) -> Column:
    """As :func:`split_thought`, for the exact layout ``<think>\\n ... </think>\\n\\n``; rows without it get an error."""
    after = F.split(text, "<think>\n")
    inner = F.split(F.get(after, F.lit(1)), "</think>\n\n")
    ok = (F.size(after) == 2) & (F.size(inner) == 2)
    return F.struct(
        F.when(ok, F.get(inner, F.lit(0))).alias("cot"), F.when(ok, F.get(inner, F.lit(1))).alias("response"),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("layout")).alias("error"),
    )


def thought(text: Column) -> Column:
    """What follows the first opening tag (or all), up to the last closing tag."""
    rest = F.regexp_replace(text, r"(?s)\A.*?<think>", "")
    return F.regexp_replace(rest, r"(?s)</think>(?!.*</think>).*\z", "")


def reasoning(text: Column) -> Column:
    """What precedes the first closing tag, without a first paragraph that recalls the instructions."""
    head = F.substring_index(text, "</think>", 1)
    opening = F.substring(F.lower(head), 1, RECALL_WITHIN)
    recalls = F.lit(False)
    for phrase in RECALL:
        recalls = recalls | opening.contains(phrase)
    parts = t.paragraphs(head)
    return F.when(recalls & (F.size(parts) > 1), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "\n\n")).otherwise(head)


def boxed_answer(text: Column) -> Column:
    """After the closing tag, the first box with its braces balanced (two levels); empty where there is none."""
    return F.regexp_extract(text, r"(?s)</think>.*?\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}", 1)


def boxed_answer_compat(text: Column) -> Column:
    """Older behaviour: through the last closing brace of the text, that brace included."""
    return F.regexp_extract(text, r"(?s)</think>.*?\\boxed\{(.*\})", 1)


def last_box(text: Column) -> Column:
    """After the last ``boxed{`` up to the next closing brace."""
    return F.substring_index(F.substring_index(text, "boxed{", -1), "}", 1)


def same_answer(response: Column, gt: Column) -> Column:
    return (F.lower(last_box(response)) == F.lower(last_box(gt))).cast("int").cast("double")


def cut_at_stop(text: Column, tokens: list[str] | None = None) -> Column:
    for token in tokens or STOP_TOKENS:
        text = F.substring_index(text, token, 1)
    return text


def trace_paragraphs(text: Column) -> Column:
    """Paragraphs, trimmed, without empty ones."""
    return F.filter(F.transform(t.paragraphs(text), t.strip), lambda p: p != "")


def chunks(text: Column, keywords: list[str] | None = None) -> Column:
    """Paragraphs joined into chunks; a paragraph with a keyword begins a new one.

    Paragraphs of a document stay in its row, so nothing is shuffled.
    """
    words = keywords or NEW_PATH

    def begins(p: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.lower(p).contains(w.lower())
        return out

    # a separator that no text has goes before paragraphs that begin a chunk
    joined = F.array_join(F.transform(trace_paragraphs(text), lambda p, i: F.when(i == 0, p).when(begins(p), F.concat(F.lit("\x02"), p)).otherwise(F.concat(F.lit("\n\n"), p))), "")
    return F.filter(F.split(joined, "\x02"), lambda c: c != "")


def merge_by_nearest_answer(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks without an answer join the nearest one with an answer; ties go to the earlier.

    ``parts``: ``id, ix, chunk, answer``.  Result: ``id, ix`` (of the chunk
    with the answer), ``text``.  Documents without any answer give nothing.
    Windows are per document.
    """
    w = Window.partitionBy(id_col).orderBy("ix")
    at = F.when(F.col("answer").isNotNull(), F.col("ix"))
    before = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    placed = parts.select("*", before.alias("b"), after.alias("a"))
    target = F.when(F.col("a").isNull() | (F.col("ix") - F.col("b") <= F.col("a") - F.col("ix")), F.col("b")).otherwise(F.col("a"))
    return (
        placed.withColumn("target", target)
        .where("target is not null")
        .groupBy(id_col, F.col("target").alias("ix"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("ix").alias("i"), "chunk"))), lambda s: s["chunk"]), "\n\n").alias("text"))
    )


def splice_tag(chunk: Column, result: Column, tag: str = "partial_solution") -> Column:
    """The first occurrence of the result wrapped in a tag; the chunk as it is where there is none."""
    at = F.position(result, chunk)
    ok = (at > 0) & (F.length(result) > 0)
    wrapped = F.concat(
        chunk.substr(F.lit(1), at - 1), F.lit(f"<{tag}>"), result, F.lit(f"</{tag}>"), chunk.substr(at + F.length(result), F.length(chunk))
    )
    return F.when(F.coalesce(ok, F.lit(False)), wrapped).otherwise(chunk)


def zip_shorter(a: Column, b: Column) -> Column:
    """Pairs of two arrays, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def annotated_trace(chunks_: Column, annotation: Column, raw_answer: Column, tag: str = "partial_solution") -> Column:
    """Chunks with their results spliced in, then the text after the last closing tag; null with fewer than two annotations or where no result was found."""
    n = F.least(F.size(chunks_), F.size(annotation))
    spliced = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: splice_tag(F.element_at(chunks_, i), F.element_at(annotation, i)["result"], tag))
    text = F.concat(F.array_join(spliced, "\n\n"), F.lit("</think>"), F.substring_index(raw_answer, "</think>", -1))
    return F.when((F.size(annotation) > 1) & (n > 0) & text.contains(f"<{tag}>"), text)


def fenced_json(text: Column) -> Column:
    """What stands in a fenced JSON block: after the first opening, before the last closing fence."""
    rest = F.regexp_replace(text, r"(?s)\A.*?```json", "")
    return F.when(text.contains("```json"), t.strip(F.regexp_replace(rest, r"(?s)```(?!.*```).*\z", "")))
