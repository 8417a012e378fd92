"""Listing, lookup and display of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.dataset import numbered


def listing(samples: DataFrame, order: str = "sample_id") -> DataFrame:
    """``index`` from 0, ``preview`` (functions, or a default) and ``type`` of each sample."""
    rows = numbered(samples, order, name="_no")
    names = F.array_join(F.filter("applied_functions", lambda x: x.isNotNull()), ", ")
    return rows.select(
        order, (F.col("_no") - 1).alias("index"), F.coalesce(F.nullif(names, F.lit("")), F.lit("No function")).alias("preview"),
        F.coalesce("source", F.lit("unknown")).alias("type"),
    )


def item(listed: DataFrame, index: int) -> DataFrame:
    """The row with that index; none out of bounds."""
    return listed.where(F.col("index") == index)


def highlighted(text: Column) -> Column:
    """Text for a page: escaped, with thoughts and partial solutions in spans."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    for tag, name in (("think", "think"), ("partial_solution", "partial-solution")):
        text = F.regexp_replace(text, rf"(?s)&lt;{tag}&gt;(.*?)&lt;/{tag}&gt;", f'<span class="{name}">$1</span>')
    return text
