"""Operators on whole datasets: order, slices, shards, splits, samples, duplicates.

Positions are numbered in two phases (counts per range partition, then
offsets), so that no single task sees all rows.
"""

from __future__ import annotations

import itertools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.shared import written


def seeded_key(key: Column, seed: int = 0) -> Column:
    """Order of a seeded shuffle; the same in every engine that has MD5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def numbered(df: DataFrame, *order: Column | str, name: str = "row_no") -> DataFrame:
    """Rows with their number from 1 in the given order.

    One range shuffle, written once with the place of each row: a second
    shuffle would draw other bounds, and counts would not fit the rows.  The
    counts of the partitions (one row each) come to the driver, and offsets
    go back as a literal map.
    """
    ranged = df.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    parts = written(placed, "numbered")
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    table = F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)])
    return parts.withColumn(name, (F.col("_at") + table[F.col("_part")] + 1).cast("long")).drop("_part", "_at")


def sample_n(df: DataFrame, n: int, key: Column | str, seed: int = 0) -> DataFrame:
    """The first ``n`` rows of a seeded shuffle (a top-n, not a full sort)."""
    col = F.col(key) if isinstance(key, str) else key
    return df.orderBy(seeded_key(col, seed), col).limit(n)


def row_range(df: DataFrame, start: int, stop: int, *order: Column | str) -> DataFrame:
    """Rows ``start`` (from 0) to before ``stop`` in the given order."""
    return numbered(df, *order, name="_no").where((F.col("_no") > start) & (F.col("_no") <= stop)).drop("_no")


def batched(df: DataFrame, size: int, *order: Column | str, name: str = "batch") -> DataFrame:
    return numbered(df, *order, name="_no").withColumn(name, F.floor((F.col("_no") - 1) / size).cast("long")).drop("_no")


def positional_split(df: DataFrame, share: float, *order: Column | str, name: str = "part") -> DataFrame:
    """``train`` for the first ``floor(share * n)`` rows, ``test`` for the rest."""
    n = df.count()
    return numbered(df, *order, name="_no").withColumn(name, F.when(F.col("_no") <= int(share * n), "train").otherwise("test")).drop("_no")


def shard_bounds(n: int, shards: int) -> list[tuple[int, int]]:
    """Contiguous shards; the first ``n % shards`` have one row more.  None for ``shards`` below 1."""
    if shards < 1:
        return []
    small, more = divmod(n, shards)
    ends = list(itertools.accumulate([small + (i < more) for i in range(shards)], initial=0))
    return list(zip(ends, ends[1:], strict=False))


def sharded(df: DataFrame, shards: int, *order: Column | str, name: str = "shard") -> DataFrame:
    """Rows with the number (from 0) of their contiguous shard."""
    if shards < 1:
        return df.withColumn(name, F.lit(None).cast("int")).limit(0)
    small, more = divmod(df.count(), shards)
    no = F.col("_no") - 1
    big = more * (small + 1)
    rank = F.when(no < big, F.floor(no / (small + 1))).otherwise(more + F.floor((no - big) / max(small, 1)))
    return numbered(df, *order, name="_no").withColumn(name, rank.cast("int")).drop("_no")


def concatenated(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, in the columns that all have, by the first one's order."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*common)
    for f in frames[1:]:
        out = out.unionByName(f.select(*common))
    return out


def fan_out_rows(df: DataFrame, array: Column, name: str = "item") -> DataFrame:
    """One row per element; rows with an empty or null array disappear."""
    return df.withColumn(name, F.explode(array))


def members(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(names))


def first_per_value(df: DataFrame, values: list[str], *order: str) -> DataFrame:
    """The first row of each combination of values; nulls are a value.

    A minimum over the order, aggregated before the shuffle, so a value that
    fills a third of the table costs one row per task.  Long values are moved
    as a 128-bit digest and come along with the row they belong to.
    """
    key = [*order, *[c for c in df.columns if c not in order]]
    digest = F.struct(*[F.md5(F.col(c).cast("string")) if c in _texts(df) else F.col(c) for c in values])
    best = df.groupBy(digest.alias("_d")).agg(F.min(F.struct(*key)).alias("_first"))
    return best.select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])


def _texts(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(_canonical)


def canonical_json(column: Column) -> Column:
    """JSON text in which the keys of objects are sorted, for comparison; null where the text is no JSON."""
    return _canonical_json(column)


def first_per_json(df: DataFrame, column: str, *order: str) -> DataFrame:
    """The first row of each JSON value, whatever the order of its keys; texts that are no JSON count as they stand."""
    keyed = df.withColumn("_value", F.coalesce(canonical_json(F.col(column)), F.col(column)))
    return first_per_value(keyed, ["_value"], *order).drop("_value")


def new_values(candidates: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct candidates that are not known yet."""
    return candidates.dropDuplicates([column]).join(known.select(column).distinct(), column, "left_anti")


def with_turns(df: DataFrame, n: int = 2, column: str = "messages") -> DataFrame:
    return df.where(F.size(column) == n)


def well_formed_pair(messages: Column, role: str = "role", content: str = "content") -> Column:
    """The first two turns are a user's and an assistant's, both with content."""
    a, b = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    return F.coalesce((a[role] == "user") & (b[role] == "assistant") & (a[content] != "") & (b[content] != ""), F.lit(False))


def assistant_turns(df: DataFrame, id_col: str, column: str = "messages") -> DataFrame:
    """``id, turn, content`` of assistant turns."""
    rows = df.select(id_col, F.posexplode(column).alias("turn", "m"))
    return rows.where("m.role = 'assistant'").select(id_col, F.col("turn").cast("long").alias("turn"), F.col("m.content").alias("content"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int = 30) -> DataFrame:
    """Counts in equal bins over ``low..high``; the last bin holds ``high``."""
    b = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where((value >= low) & (value <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of small lists, numbered in order."""
    rows = [(*x, i) for i, x in enumerate(itertools.product(*axes.values()))]
    first = [type(v[0]) for v in axes.values()]
    kinds = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}
    schema = T.StructType([T.StructField(n, kinds[k]) for n, k in zip(axes, first, strict=True)]).add("ordinal", "long")
    return spark.createDataFrame(rows, schema)


def length_buckets(df: DataFrame, text: Column, batch: int, width: int = 20_000) -> DataFrame:
    """Bucket by length and the batch size for it: longer texts go in smaller batches."""
    bucket = F.floor(F.length(text) / width).cast("int")
    return df.withColumn("bucket", bucket).withColumn("batch_size", F.greatest(F.lit(1), F.floor(F.lit(batch) / (1 + F.col("bucket"))).cast("int")))


def cut_at(text: Column, stops: list[str]) -> Column:
    """The text before the first of the stop marks."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text
