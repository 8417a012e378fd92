"""Problem 8: visually identical text with different characters.

Texts are mapped (:mod:`tracewright.llm.fold`) and grouped under the
accent-sensitive ``UNICODE`` collation, in which canonically equivalent
sequences are equal and case, accents, raised figures and fractions are not.

Plan.  A first scan gives each row two 64-bit hashes, of the accent-blind
mapped text (``bucket``) and of the raw text (``variant``), which go to the
shared folder with the id.  Buckets with two or more variants are few; one id
for each of their variants is written too, so that its size is known when the
texts are fetched by a second scan, and only those texts go through the
collation.  Copies of one text share a variant and meet the rest only in the
final join, so a text that makes up a third of all rows costs one row.

Defined results: null text has no partner and a null form; an empty text is
its own form; exact copies share a class and are no pair; extra columns are
ignored; a repeated id counts once in pairs and gives a form for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.fold import blind_column, fold_column
from tracewright.llm.shared import written

COLLATION = "UNICODE"


def _hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, bucket, variant`` of each row with a text, written to the shared folder."""
    # two projections, so that the mapped text is made once
    folded = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("variant"), fold_column(F.col(text_col)).alias("_folded"))
    return written(folded.select("_id", F.xxhash64(blind_column(F.col("_folded"))).alias("bucket"), "variant"), "lookalike")


def _classes(docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    crowded = (
        keyed.groupBy("bucket").agg(F.min("variant").alias("lo"), F.max("variant").alias("hi")).where("lo <> hi").select("bucket")
    )
    crowded = written(crowded, "lookalike")
    chosen = written(keyed.join(crowded, "bucket", "left_semi").groupBy("bucket", "variant").agg(F.min("_id").alias("_id")), "lookalike")
    texts = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .where("_text is not null")
        .join(chosen, "_id")
        .where(F.xxhash64("_text") == F.col("variant"))
        .withColumn("_mapped", fold_column(F.col("_text")))
    )
    # one row per text; the ids of a text may name it twice
    forms = texts.dropDuplicates(["bucket", "variant"]).withColumn("_form", F.collate("_mapped", COLLATION))
    plain = F.struct((F.col("_text") != F.col("_mapped")).alias("n"), F.length("_mapped").alias("l"), F.col("_mapped").alias("t"))
    grouped = (
        forms.groupBy("bucket", "_form")
        .agg(F.min("_id").alias("class_id"), F.min(plain)["t"].alias("canonical"), F.min("variant").alias("lo"), F.max("variant").alias("hi"))
        .where("lo <> hi")
    )
    return forms.select("bucket", "_form", "variant").join(grouped, ["bucket", "_form"]).select("bucket", "variant", "class_id", "canonical")


def lookalike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text that looks like another, different text.

    Columns: ``bucket``, ``variant`` (the hashes that name the text),
    ``class_id`` (smallest id of the class), ``canonical`` (the class's form:
    the mapped text of the member that is written the most plainly, ties by
    code points).
    """
    return _classes(docs, _hashes(docs, id_col, text_col), id_col, text_col)


def lookalike_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, variant, class_id, canonical`` of every row whose text looks like another, different one."""
    keyed = _hashes(docs, id_col, text_col)
    return keyed.join(_classes(docs, keyed, id_col, text_col), ["bucket", "variant"]).drop("bucket").distinct()


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (``doc_a`` < ``doc_b``) that look the same and differ in code points.

    The texts of a class are paired first, then each side is replaced by its
    rows, so copies of one text are never compared with one another.
    """
    keyed = _hashes(docs, id_col, text_col)
    texts = written(_classes(docs, keyed, id_col, text_col).select("bucket", "variant", "class_id"), "lookalike")
    a, b = texts.alias("a"), texts.alias("b")
    same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.variant") < F.col("b.variant"))
    linked = a.join(b, same).select("a.bucket", F.col("a.variant").alias("va"), F.col("b.variant").alias("vb"))
    rows = keyed.join(texts.select("bucket", "variant"), ["bucket", "variant"], "left_semi").distinct()
    left = rows.select("bucket", F.col("variant").alias("va"), F.col("_id").alias("x"))
    right = rows.select("bucket", F.col("variant").alias("vb"), F.col("_id").alias("y"))
    found = linked.join(left, ["bucket", "va"]).join(right, ["bucket", "vb"]).where("x <> y")
    return found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def canonical_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its form: ``doc_id, class_id, canonical_text``.

    ``class_id`` is null where no other text looks the same.
    """
    members = written(lookalike_members(docs, id_col, text_col), "lookalike").select(F.col("_id").alias("doc_id"), F.col("variant").alias("_v"), "class_id", "canonical")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_v"), fold_column(F.col(text_col)).alias("_mapped"))
    return rows.join(members, ["doc_id", "_v"], "left").select("doc_id", "class_id", F.coalesce("canonical", "_mapped").alias("canonical_text"))
