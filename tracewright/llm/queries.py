"""Queries of the llm subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import cube, fold, leak, lookalike, mixing, overlap, packing, pairs, truncation


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """User turns of samples and questions of traces, with the table's name."""
    samples = _t(spark, d, "samples").select(
        F.lit("samples").alias("table_name"), F.col("sample_id").alias("id"), "split", "source",
        F.get("messages", F.lit(0))["content"].alias("text"),
    )
    traces = _t(spark, d, "annotated_traces").select(
        F.lit("annotated_traces").alias("table_name"), F.col("trace_id").alias("id"), "split", "source", F.col("question").alias("text")
    )
    return samples.unionByName(traces)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(_prompts(spark, d)).select(
        "table_name", F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")
    ).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompts(spark, d)
    return overlap.overlap_report(rows, overlap.find_overlaps(rows))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.find_overlaps(_prompts(spark, d)).classes().select("table_name", "id", "split", "class_id", "links")


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.find_overlaps(_prompts(spark, d)).steps()


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cut_records(pairs.output_pairs(_t(spark, d, "model_outputs")), pairs.trace_results(_t(spark, d, "annotated_traces")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("truncated").select("table_name", "record_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(_cuts(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.sample_pairs(_t(spark, d, "samples")).unionByName(pairs.output_pairs(_t(spark, d, "model_outputs")))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(_pairs(spark, d), _t(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("defect is not null").select("table_name", "record_id", "defect")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).groupBy("table_name", "source", "defect", "signal").agg(F.count("*").alias("records"))


def _packing(spark: SparkSession, d: str) -> packing.Packing:
    samples = _t(spark, d, "samples")
    length = F.aggregate(F.coalesce("messages", F.array()), F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    packs = _t(spark, d, "pack_limits")
    other = packs.where("unit is null or unit <> 'chars'").select("unit").first()
    if other is not None:
        raise ValueError(f"lengths are in chars, not in {other.unit}")
    return packing.pack_items(samples.select(F.col("sample_id").alias("id"), length.alias("length")), packs)


def p4_packs(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).placed


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).report


def _sample(spark: SparkSession, d: str) -> cube.CubeSample:
    return cube.cube_sample(_t(spark, d, "samples"), _t(spark, d, "function_targets"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).drawn


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(_t(spark, d, "documents"), _t(spark, d, "benchmark_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leak.leak_report(_passages(spark, d), _t(spark, d, "benchmark_items"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return leak.without_leaks(_t(spark, d, "documents").select("doc_id", "text", "source"), _passages(spark, d))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix_sources(_t(spark, d, "documents"), _t(spark, d, "source_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).drawn


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_t(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_forms(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_classes": p1_classes,
    "p1_steps": p1_steps,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_packs": p4_packs,
    "p4_report": p4_report,
    "p5_sample": p5_sample,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_clean": p6_clean,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
}

# DuckDB statements for the queries that SQL can express over whole tables.


def _folded(t: str) -> str:
    pairs = fold.PAIRS
    out = f"translate({t}, '{''.join(pairs).replace(chr(39), chr(39) * 2)}', '{''.join(pairs.values()).replace(chr(39), chr(39) * 2)}')"
    for a, b in fold.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    invisible = "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in fold.INVISIBLE)
    return f"regexp_replace({out}, '[\\p{{Cf}}{invisible}]+', '', 'g')"


ORACLE: dict[str, str] = {
    "p8_found": f"""
WITH d AS (SELECT DISTINCT doc_id, text, nfc_normalize({_folded('text')}) AS f FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.f = b.f AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p8_forms": f"""
WITH d AS (SELECT doc_id, text, {_folded('text')} AS m FROM documents),
k AS (SELECT *, nfc_normalize(m) AS f FROM d),
c AS (SELECT f, min(doc_id) AS class_id, arg_min(m, ROW(text <> m, length(m), m)) AS canonical FROM k WHERE text IS NOT NULL GROUP BY f HAVING count(DISTINCT text) > 1)
SELECT doc_id, class_id, coalesce(canonical, m) AS canonical_text FROM k LEFT JOIN c USING (f)""",
    "p6_found": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(replace(nfc_normalize({_folded("regexp_replace(text, '</?(?:p|br|div)(?:[ \\n][^<>]*)?/?>', chr(10), 'gi')")}), 'ß', 'ss')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(replace(nfc_normalize({_folded('problem')}), 'ß', 'ss')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark_items),
g AS (SELECT DISTINCT item_id, hash(w[k:k + 11]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
h AS (SELECT doc_id, hash(w[k:k + 11]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM w))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (h)""",
}
ORACLE["p6_clean"] = f"SELECT doc_id, text, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({ORACLE['p6_found']}))"
