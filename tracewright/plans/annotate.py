"""Chunks of traces annotated by a model: prompt, answer, default, join back by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.external import ChunkAnnotator, Generator, generated
from tracewright.functions.text import strip
from tracewright.operators.instruct import prompt

ANNOTATION = "array<struct<id:string,result:string,correct:boolean>>"


def numbered_chunks(chunks: Column) -> Column:
    """One line per chunk, with its number; line ends inside a chunk become blanks."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.regexp_replace(c, r"\s*\n\s*", " "))), "\n")


def annotation_of(answer: Column, chunks: Column) -> Column:
    """The list in the fenced block; if there is none, an entry without result for each chunk."""
    found = F.from_json(strip(F.regexp_extract(answer, r"(?s)```json(.*?)```", 1)), ANNOTATION)
    default = F.transform(chunks, lambda c, i: F.struct(i.cast("string").alias("id"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("boolean").alias("correct")))
    return F.coalesce(found, default)


def annotated(traces: DataFrame, annotator: Callable[[], Generator] = ChunkAnnotator, id_col: str = "trace_id", chunks_col: str = "chunks") -> DataFrame:
    """``id, annotation`` of every row with chunks; answers carry the id of their prompt."""
    asked = traces.where(F.size(chunks_col) > 0).select(id_col, chunks_col, prompt("annotate", chunks=numbered_chunks(F.col(chunks_col))).alias("prompt"))
    return generated(asked, annotator).select(id_col, annotation_of(F.col("answer"), F.col(chunks_col)).alias("annotation"))
