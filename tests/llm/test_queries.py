from __future__ import annotations

import os

import pytest

from tracewright.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# Columns that the test tables' description gives.
COLUMNS = {
    "p1_found": {"table_name", "id_a", "id_b"}, "p2_found": {"table_name", "record_id"}, "p3_found": {"table_name", "record_id", "defect"},
    "p6_found": {"doc_id", "item_id"}, "p8_found": {"doc_a", "doc_b"},
}
DEFECTS = {"empty", "truncated", "refusal", "copy", "other_language"}


@pytest.fixture(scope="module")
def results(spark):
    done = {}

    def of(name):
        if name not in done:
            done[name] = QUERIES[name](spark, FOLDER).toPandas()
        return done[name]

    return of


def size(spark, name, key):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").select(key).distinct().count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, name):
    df = results(name)
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name] and not df.duplicated().any() and not df.isna().any().any() and len(df)
    if name == "p3_found":
        assert set(df.defect) <= DEFECTS and not df.duplicated(["table_name", "record_id"]).any()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_reports_agree_with_what_is_found(spark, results):
    assert results("p1_report").pairs.sum() == len(results("p1_found"))
    classes = results("p1_classes")
    assert classes[classes.split != "train"].links.sum() == len(results("p1_found")) == classes[classes.split == "train"].links.sum()
    assert results("p2_report").truncated.sum() == len(results("p2_found"))
    p3 = results("p3_report")
    assert p3[p3.defect.notna()].records.sum() == len(results("p3_found"))
    assert p3.records.sum() == size(spark, "samples", "sample_id") + size(spark, "model_outputs", "output_id")
    assert results("p6_report").documents.sum() == len(results("p6_found"))
    docs = size(spark, "documents", "doc_id")
    assert len(results("p6_clean")) == docs - results("p6_found").doc_id.nunique() and len(results("p8_forms")) == docs


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_draws_agree_with_their_reports(spark, results):
    packs = results("p4_packs")
    used = packs.groupby(["pack_name", "capacity", "shard", "container"]).length.sum().reset_index()
    assert (used.length <= used.capacity).all()
    assert dict(used.groupby("pack_name").size()) == dict(results("p4_report").set_index("pack_name").containers)
    drawn = results("p5_sample").names.explode().value_counts()
    assert all(drawn.get(r.function_name, 0) == r.drawn for r in results("p5_report").itertuples())
    mix = results("p7_mix")
    total = (mix.tokens * mix.repeats).groupby(mix.source).sum()
    assert all(total.get(r.source, 0) == r.drawn_tokens for r in results("p7_report").itertuples())
