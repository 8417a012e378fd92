from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.operators import transforms
from tracewright.sources import jsonl
from tracewright.streaming import files


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ü", "b"), ("c", None)], "instruction string, response string")
    jsonl.write_jsonl(df, str(tmp_path / "x.jsonl"))
    back = jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), schemas.schema(schemas.INSTRUCTION_RESPONSE))
    assert sorted((r.instruction, r.response) for r in back.collect()) == [("c", None), ("ü", "b")]
    jsonl.write_jsonl(df, str(tmp_path / "x.jsonl"), append=True)
    assert jsonl.merged_shards(spark, str(tmp_path / "x.jsonl"), schemas.schema(schemas.INSTRUCTION_RESPONSE)).count() == 4


def test_bad_and_blank_lines(spark, tmp_path):
    path = tmp_path / "y.jsonl"
    path.write_text('{"problem": "1", "answer": "2"}\n\n{broken\n')
    kind = schemas.schema(schemas.MATH_ITEM)
    assert jsonl.merged_shards(spark, str(path), kind).count() == 1
    assert jsonl.read_jsonl_skipping_blank(spark, str(path), kind).where("problem is not null").count() == 1
    name = jsonl.ingest(spark, str(path), kind)
    assert spark.table(name).where("answer = '2'").count() == 1
    with pytest.raises(ValueError):
        jsonl.ingest(spark, str(tmp_path / "y.txt"), kind)


def test_lines_and_document(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_text(" a \n\n b \n")
    assert [r.instruction for r in jsonl.read_lines(spark, str(path)).collect()] == ["a", "b"]
    jsonl.write_document(spark.range(2), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        jsonl.write_document(spark.range(3), str(tmp_path / "r.json"), most_rows=2)


def test_features(spark, tmp_path):
    with pytest.raises(ValueError):
        jsonl.read_features(spark, "x.npz")
    (tmp_path / "f.jsonl").write_text('{"features": [1.0, 2.0], "label": 1}\n')
    assert jsonl.read_features(spark, str(tmp_path / "f.jsonl")).first().label == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "abc"}\n{"text": "x"}\n')
    stream = files.stream_jsonl(spark, str(tmp_path / "in"), schemas.schema("text string"))
    files.saved(files.transformed(stream, transforms.upper_case), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.new_text for r in spark.read.json(str(tmp_path / "out")).collect()) == ["ABC", "X"]


def test_windowed_accuracy_in_batch(spark):
    rows = spark.createDataFrame([("2025-01-01 00:01:00", "f", 1.0), ("2025-01-01 00:02:00", "f", 0.0)], "t string, function_name string, score double")
    got = files.windowed_accuracy(rows.withColumn("t", F.to_timestamp("t")), "t").first()
    assert (got.accuracy, got.examples) == (0.5, 2)


def test_numbered_lines(spark, tmp_path):
    path = tmp_path / "v.jsonl"
    path.write_text('{"text": "a"}\n\n{"text": "b"}\n')
    got = jsonl.read_numbered(spark, str(path), schemas.schema("text string")).orderBy("index").collect()
    assert [(r.id, r["index"], r.text) for r in got] == [("sample_1", 0, "a"), ("sample_3", 1, "b")]


def test_ascii_lines(spark, tmp_path):
    df = spark.createDataFrame([("ü \U0001f600 \u20ac", 1), ("plain", 2), (None, 3)], "a string, b int")
    jsonl.write_jsonl_ascii(df, str(tmp_path / "a.jsonl"))
    lines = [x for f in (tmp_path / "a.jsonl").glob("part-*") for x in f.read_bytes().decode("ascii").splitlines()]
    assert sorted((json.loads(x) for x in lines), key=lambda x: x["b"]) == [{"a": "ü \U0001f600 \u20ac", "b": 1}, {"a": "plain", "b": 2}, {"b": 3}]
