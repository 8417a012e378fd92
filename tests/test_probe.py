"""The probe on points that a line, and on points that only a hidden layer can part."""

from __future__ import annotations

import random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewright.operators import probe


def points(spark, label, n=400):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(n)]
    return spark.createDataFrame([(i, x, int(label(*x))) for i, x in rows], "vec_id long, embedding array<double>, label int")


def test_grid(spark):
    found = probe.grid_search(points(spark, lambda x, y: x + y > 0.6), hidden=(0,), decay=(0.0, 5.0), alpha=(1.0,)).collect()
    assert [(r.hidden, r.decay) for r in found] == [(0, 0.0), (0, 5.0)] and found[0].accuracy > 0.9


def test_hidden_layer_and_weights(spark):
    rows = points(spark, lambda x, y: (x > 0) != (y > 0)).select("vec_id", array_to_vector(F.col("embedding")).alias("features"), F.col("label").cast("double").alias("label"))
    train, held = probe.split(rows)
    model, accuracy = probe.fit_hidden(train, held, 8, rounds=100, step=50)
    assert accuracy > 0.8 and probe._accuracy(probe.fit(train), held) < 0.75
    rare = train.where("label = 0 or vec_id % 10 = 0")
    heavy, _ = probe.fit_hidden(rare, held, 4, alpha=3.0, rounds=20, step=20)
    light, _ = probe.fit_hidden(rare, held, 4, alpha=0.01, rounds=20, step=20)
    share = lambda m: m.transform(held).agg(F.avg("prediction")).first()[0]
    assert share(heavy) > share(light)
