from __future__ import annotations

import pytest

from tracewright.llm import shared


def test_written_and_released(spark):
    shared.release(spark)
    df = shared.written(spark.range(3), "x")
    assert df.count() == 3
    assert shared.release(spark) == 1 and shared.release(spark) == 0
    with pytest.raises(Exception):
        shared.written(spark.range(3), "x").sparkSession.read.parquet(f"{shared.shared_folder(spark)}/none").count()
