"""Readers and writers of JSON lines, text lines, vectors and single documents."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.functions.text import strip
from tracewright.operators.dataset import numbered

#: Endings of files that may be taken in, and the largest size of one.
ALLOWED = (".json", ".jsonl")
MAX_BYTES = 16 << 20
CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line, by a declared schema; a line that does not parse stands in ``_corrupt_record``."""
    full = schema if CORRUPT in schema.fieldNames() else StructType(schema.fields).add(CORRUPT, "string")
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_jsonl_skipping_blank(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of a file, without blank lines and lines that do not parse."""
    full = StructType([f for f in schema.fields if f.name != CORRUPT]).add(CORRUPT, "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON where the name says so, else Parquet."""
    if path.rstrip("/").endswith(ALLOWED):
        if schema is None:
            raise ValueError("JSON needs a declared schema")
        return read_jsonl(spark, path, schema)
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """Trimmed lines as ``instruction``; empty ones only on request."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("instruction"))
    return lines if keep_empty else lines.where("instruction <> ''")


def read_numbered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of one file with ``id`` (``sample_`` and the line's number from 1, blank lines counted) and ``index`` (from 0, blank lines not counted)."""
    lines = numbered(spark.read.text(path).withColumn("_place", F.monotonically_increasing_id()), "_place", name="_line")
    kept = numbered(lines.where(F.trim("value") != "").drop("_place"), "_line", name="_index")
    rows = kept.select(F.concat(F.lit("sample_"), F.col("_line").cast("string")).alias("id"), (F.col("_index") - 1).alias("index"), F.from_json("value", schema).alias("r"))
    return rows.select("id", "index", "r.*")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Vectors and labels, by ending: Parquet, or lines ``{"features": [...], "label": n}``."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith(".jsonl"):
        return spark.read.schema("features array<float>, label int").json(path)
    raise ValueError(f"no features in {path}")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per line; other letters than ASCII stay as they are."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_jsonl_ascii(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per line with every other letter than ASCII as ``\\uXXXX``; for readers that know ASCII only."""
    line = F.to_json(F.struct(*df.columns))
    # characters above U+FFFF are two surrogates
    unit = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(c)), 4, "0"))
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")

    def one(c):
        n = code(c)
        pair = F.concat(unit(F.floor((n - 0x10000) / 1024) + 0xD800), unit((n - 0x10000) % 1024 + 0xDC00))
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(pair)

    escaped = F.when(line.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(line, ""), one), "")).otherwise(line)
    df.select(escaped.alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_document(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """A small report as one indented JSON document; more than ``most_rows`` rows are refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in rows], f, ensure_ascii=False, indent=2, default=str)


def ingest(spark: SparkSession, path: str, schema: StructType) -> str:
    """Checks ending and size of a file and makes it a temporary view; gives its id."""
    if not path.endswith(ALLOWED):
        raise ValueError(f"only {', '.join(ALLOWED)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getLen() > MAX_BYTES:
        raise ValueError(f"more than {MAX_BYTES} bytes")
    name = f"file_{uuid.uuid4().hex}"
    read_jsonl_skipping_blank(spark, path, schema).createOrReplaceTempView(name)
    return name


def merged_shards(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All part files of a folder, without lines that do not parse."""
    return read_jsonl_skipping_blank(spark, folder, schema)
