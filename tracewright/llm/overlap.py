"""Problem 1: same or nearly the same records across splits.

Edit-distance segment join.  Every text becomes a string over words
(:func:`tracewright.llm.sameproblem.search_string`).  An evaluation string of
n words may differ from a training string in k words
(:func:`tracewright.llm.sameproblem.edits`); it is cut into k + 1 segments of
one length, so at least one stands unchanged in the training string, shifted by
no more than the edits before and after it allow.  Segments and the training
substrings of that length meet in an equi-join with those places as a
condition, candidates are verified by a banded dynamic programme over the
strings, and what it keeps goes through the exact check of the whole texts
(:func:`tracewright.llm.sameproblem.same_problem`).

A segment that stands in more than ``hot`` training texts (a stock phrase with
a common number) is split: there the key also holds the hash of all quantities
of the text, which the exact check wants equal anyway, so no pair is lost and
no key joins more than that many texts of other quantities.  Texts with few
numbers have hardly any quantities to split by; their segments are five words
of prose.  A training text of n words gives fewer than 3 n keys.

Equal texts are one class from the start.  The result of the join is pairs of
classes and their members (:class:`Overlaps`); only :meth:`Overlaps.pairs`
multiplies them out.

Parsed rows, keys and kept candidates are written to the shared folder.
Defined results: null or blank texts, and rows whose split is null, are in no
pair; a repeated id counts once; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.sameproblem import WORDS_PER_EDIT, banded_distances, edits, parse, problem_text, same_problem, search_string
from tracewright.llm.shared import written

TRAIN = "train"
#: Training texts that share a segment, above which it is split by quantities.
HOT = 32
_BAR = "\x1f"


def segment_size(words: int, numeric: bool) -> int:
    """Length of the k + 1 segments that a string of so many words is cut into."""
    return words // (edits(words, numeric) + 1)


@lru_cache(maxsize=4096)
def segment_sizes(words: int, numeric: bool) -> list[int]:
    """Lengths of the segments of all strings that a training string of so many words may be within reach of."""
    if numeric:
        # strings around numbers meet only strings around as many numbers
        return [segment_size(words, numeric)]
    per = WORDS_PER_EDIT[numeric]
    near = [m for m in range(max(1, words - words // per - 1), words + words // (per - 1) + 2) if abs(m - words) <= edits(m, numeric)]
    return sorted({segment_size(m, numeric) for m in near})


_PARSED = (
    T.StructType().add("body", "string").add("quantities", "string").add("numeric", "boolean")
    .add("words", T.ArrayType(T.StringType())).add("sizes", T.ArrayType(T.IntegerType()))
)


@F.pandas_udf(_PARSED)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        body = problem_text(t) if t else ""
        p = parse(body)
        numeric, words = search_string(p)
        rows.append((body, _BAR.join(p.numbers), numeric, words, segment_sizes(len(words), numeric)))
    return pd.DataFrame(rows, columns=["body", "quantities", "numeric", "words", "sizes"])


def _key(size: Column, codes: Column, at: Column) -> Column:
    return F.xxhash64("table_name", "numeric", size, F.slice(codes, at + 1, size))


def evaluation_keys(texts: DataFrame) -> DataFrame:
    """``segment, eval_key, eval_quantities, no, at, n, k`` of the segments of evaluation strings."""
    n = F.size("codes")
    k = F.floor((n - 1) / F.when(F.col("numeric"), WORDS_PER_EDIT[True]).otherwise(WORDS_PER_EDIT[False])).cast("int")
    size = F.floor(n / (k + 1)).cast("int")
    cut = texts.select("*", n.alias("n"), k.alias("k"), size.alias("_size")).select("*", F.explode(F.sequence(F.lit(0), "k")).alias("no"))
    at = F.col("no") * F.col("_size")
    return cut.select(_key(F.col("_size"), F.col("codes"), at).alias("segment"), F.col("text_key").alias("eval_key"), F.col("quantities").alias("eval_quantities"), "no", at.alias("at"), "n", "k")


def training_keys(texts: DataFrame) -> DataFrame:
    """``segment, train_key, quantities, place, length`` of the substrings that may meet a segment."""
    sized = texts.select("*", F.size("codes").alias("length"), F.explode("sizes").alias("_size")).where(F.col("_size") <= F.col("length"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("_size"))).alias("place"))
    return placed.select(_key(F.col("_size"), F.col("codes"), F.col("place")).alias("segment"), F.col("text_key").alias("train_key"), "quantities", "place", "length")


def meet(evals: DataFrame, trains: DataFrame, hot: int) -> DataFrame:
    """Pairs ``eval_key, train_key`` with a common segment at allowed places; hot segments also want equal quantities."""
    # a segment may stand in a text several times; counted before the shuffle
    busy = trains.groupBy("segment").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("segment", F.lit(True).alias("busy"))

    def split(keys: DataFrame, quantities: str) -> DataFrame:
        return keys.join(busy, "segment", "left").withColumn("part", F.when(F.col("busy"), F.col(quantities)).otherwise(0)).drop("busy", quantities)

    moved = F.col("place") - F.col("at")
    behind = moved - (F.col("length") - F.col("n"))
    allowed = (F.abs(moved) <= F.col("no")) & (F.abs(behind) <= F.col("k") - F.col("no"))
    return (
        split(evals, "eval_quantities").join(split(trains, "quantities"), ["segment", "part"])
        .where(allowed & (F.col("eval_key") != F.col("train_key"))).select("eval_key", "train_key").distinct()
    )


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The candidates that the banded dynamic programme keeps."""
    for b in batches:
        n = b["eval_codes"].map(len).to_numpy()
        keep = np.zeros(len(b), dtype=bool)
        for numeric in (True, False):
            for size in np.unique(n[b["numeric"].to_numpy() == numeric]):
                at = np.flatnonzero((n == size) & (b["numeric"].to_numpy() == numeric))
                x = np.stack(b["eval_codes"].iloc[at].to_list())
                others = b["train_codes"].iloc[at].to_list()
                length = np.array([len(y) for y in others])
                y = np.zeros((len(at), length.max()), dtype=np.int64)
                for r, codes in enumerate(others):
                    y[r, : len(codes)] = codes
                k = edits(int(size), numeric)
                keep[at] = banded_distances(x, y, length, k) <= k
        yield b.loc[keep, ["eval_key", "train_key"]]


def _same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that the exact check keeps."""
    read = lru_cache(maxsize=4096)(parse)
    for b in batches:
        keep = [same_problem(read(x), read(y)) for x, y in zip(b["eval_body"], b["train_body"], strict=True)]
        yield b.loc[keep, ["eval_key", "train_key"]]


class Overlaps(NamedTuple):
    """Classes of equal texts and the links between them.

    ``members``: ``table_name, id, split, source, text_key``; ``links``:
    ``eval_key, train_key`` (a class with records on both sides is linked to
    itself); ``candidates`` and ``near``: the pairs of classes after the segment
    join and after the dynamic programme.
    """

    members: DataFrame
    links: DataFrame
    candidates: DataFrame
    near: DataFrame

    def pairs(self) -> DataFrame:
        """``table_name, eval_id, train_id, split, source`` (of the evaluation record), one row per pair of records."""
        train: Column = F.col("split") == TRAIN
        evaluation = self.members.where(~train).select("table_name", F.col("id").alias("eval_id"), "split", "source", F.col("text_key").alias("eval_key"))
        training = self.members.where(train).select(F.col("id").alias("train_id"), F.col("text_key").alias("train_key"))
        return (
            evaluation.join(self.links, "eval_key").join(training, "train_key")
            .select("table_name", "eval_id", "train_id", "split", "source").distinct()
        )

    def classes(self) -> DataFrame:
        """Every record with its class and the number of records of the other side it is linked to: ``table_name, id, split, class_id, links``."""
        train = F.col("split") == TRAIN
        sizes = self.members.groupBy("text_key").agg(F.countDistinct(F.when(train, F.col("id"))).alias("t"), F.countDistinct(F.when(~train, F.col("id"))).alias("e"), F.min("id").alias("class_id"))
        linked = self.links.join(sizes.select(F.col("text_key").alias("eval_key"), "e"), "eval_key").join(sizes.select(F.col("text_key").alias("train_key"), "t"), "train_key")
        of_eval = linked.groupBy(F.col("eval_key").alias("text_key")).agg(F.sum("t").alias("to_train"))
        of_train = linked.groupBy(F.col("train_key").alias("text_key")).agg(F.sum("e").alias("to_eval"))
        counted = sizes.join(of_eval, "text_key", "left").join(of_train, "text_key", "left")
        links = F.coalesce(F.when(train, F.col("to_eval")).otherwise(F.col("to_train")), F.lit(0))
        return self.members.join(counted, "text_key").select("table_name", "id", "split", "source", "class_id", links.alias("links"))

    def steps(self) -> DataFrame:
        """Pairs of different texts after each step: ``step, pairs``."""
        other = self.links.where("eval_key <> train_key")
        out = None
        for name, df in (("1 segment join", self.candidates), ("2 dynamic programme", self.near), ("3 exact check", other)):
            one = df.agg(F.lit(name).alias("step"), F.count("*").alias("pairs")).select("step", "pairs")
            out = one if out is None else out.unionByName(one)
        return out


def find_overlaps(rows: DataFrame, hot: int = HOT) -> Overlaps:
    """Overlaps of training and evaluation records; ``rows``: ``table_name, id, split, source, text``."""
    parsed = (
        rows.where(F.col("text").isNotNull() & F.col("split").isNotNull())
        .select("table_name", F.col("id").cast("long").alias("id"), "split", "source", _parsed("text").alias("p"))
        .where("p.body <> ''")
        .select(
            "table_name", "id", "split", "source", "p.numeric", "p.words", "p.sizes", "p.body",
            F.xxhash64("table_name", "p.body").alias("text_key"), F.xxhash64("p.quantities").alias("quantities"),
        )
    )
    parsed = written(parsed, "overlap")
    train: Column = F.col("split") == TRAIN
    sides = parsed.groupBy("text_key").agg(F.max(train).alias("t"), F.max(~train).alias("e"))
    codes = F.transform("words", lambda w: F.xxhash64(w)).alias("codes")
    strings = parsed.where("size(words) > 0").select("table_name", "text_key", "quantities", "numeric", "sizes", codes, train.alias("train"))
    # a text on both sides is a link as it stands, and takes part in the search on both sides
    evals = evaluation_keys(strings.where("not train").dropDuplicates(["text_key"]))
    trains = training_keys(strings.where("train").dropDuplicates(["text_key"]))
    candidates = written(meet(evals, trains, hot), "overlap")
    one = strings.select("text_key", "numeric", "codes").dropDuplicates(["text_key"])
    near = written(
        candidates.join(one.select(F.col("text_key").alias("eval_key"), "numeric", F.col("codes").alias("eval_codes")), "eval_key")
        .join(one.select(F.col("text_key").alias("train_key"), F.col("codes").alias("train_codes")), "train_key")
        .mapInPandas(_near, "eval_key long, train_key long"),
        "overlap",
    )
    bodies = parsed.select("text_key", "body").dropDuplicates(["text_key"])
    checked = (
        near.join(bodies.select(F.col("text_key").alias("eval_key"), F.col("body").alias("eval_body")), "eval_key")
        .join(bodies.select(F.col("text_key").alias("train_key"), F.col("body").alias("train_body")), "train_key")
        .mapInPandas(_same, "eval_key long, train_key long")
    )
    equal = sides.where("t and e").select(F.col("text_key").alias("eval_key"), F.col("text_key").alias("train_key"))
    members = parsed.select("table_name", "id", "split", "source", "text_key").distinct()
    return Overlaps(members, written(checked.unionByName(equal), "overlap"), candidates, near)


def split_overlaps(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs of a training and an evaluation record that pose one problem; see :meth:`Overlaps.pairs`."""
    return find_overlaps(rows, hot).pairs()


def overlap_report(rows: DataFrame, found: Overlaps) -> DataFrame:
    """Per table, evaluation split and source: records, records with a twin in train, pairs; counted over classes, not over pairs."""
    keys = ["table_name", "split", "source"]
    total = rows.where(F.col("split") != TRAIN).groupBy(*keys).agg(F.countDistinct("id").alias("records"))
    hit = (
        found.classes().where((F.col("split") != TRAIN) & (F.col("links") > 0)).groupBy(*keys)
        .agg(F.countDistinct("id").alias("overlapping"), F.sum("links").alias("pairs"))
    )
    same = [total[c].eqNullSafe(hit[c]) for c in keys]
    return total.join(hit, same[0] & same[1] & same[2], "left").select(
        total["table_name"], total["split"], total["source"], "records",
        F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("pairs", F.lit(0)).alias("pairs"),
    )
