"""Packing, balanced sampling and mixing."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import cube, mixing, packing


def test_pack_respects_capacity_and_keeps_items():
    rng = np.random.default_rng(0)
    for capacity, high in ((100, 100), (1000, 300), (50, 20)):
        lengths = rng.integers(1, high + 1, 500)
        c = packing.pack(lengths, capacity, groups=12)
        used = np.bincount(c, weights=lengths)
        assert len(c) == 500 and c.min() >= 0 and used.max() <= capacity
        assert c.max() + 1 <= 1.1 * np.ceil(lengths.sum() / capacity) + 12


def test_pack_small_cases():
    assert packing.pack(np.array([], dtype=int), 10).tolist() == []
    assert packing.pack(np.array([10, 10]), 10).tolist() in ([0, 1], [1, 0])
    assert len(set(packing.pack(np.array([5, 5, 5, 5]), 10).tolist())) == 2


def test_configurations_solve_the_cutting_stock():
    # 60 + 40 fill a container; the best is 10 containers for 10 of each
    plan = packing.configurations(np.array([60, 40]), np.array([10, 10]), 100)
    assert sum(n for _, n in plan) == pytest.approx(10)


PACKS = "pack_name string, capacity long, unit string"


def test_packing_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 130), "x") for i in range(300)] + [(400, 0, "x"), (401, None, "x"), (402, 1000, "x"), (0, 5, "x")]
    first = {i: n for i, n, _ in rows[:300]}
    items = spark.createDataFrame(rows[:-1] + [(1, first[1], "x")], "id long, length long, pack_name string")
    made = packing.pack_items(items, spark.createDataFrame([("p", 100, "chars"), ("q", 300, "chars"), ("bad", 0, "chars"), ("null", None, "chars")], PACKS), groups=10, shard_rows=100)
    placed = made.placed.toPandas()
    assert set(placed.pack_name) == {"p", "q"}
    for name, capacity in (("p", 100), ("q", 300)):
        p = placed[placed.pack_name == name]
        assert p.groupby(["shard", "container"]).length.sum().max() <= capacity
        assert p.groupby("id").length.sum().to_dict() == {**first, 402: 1000}
        pieces = p.groupby("id").size()
        assert all(n == 1 or first.get(i, 1000) > capacity for i, n in pieces.items())
        assert all((g.sort_values("piece").start.tolist() == np.cumsum([0, *g.sort_values("piece").length])[:-1].tolist()) for _, g in p.groupby("id"))
    report = {r.pack_name: r for r in made.report.collect()}
    assert report["p"].items == 301 and report["p"].used_share > 0.85


def test_packing_empty(spark):
    none = spark.createDataFrame([], "id long, length long")
    packs = spark.createDataFrame([("p", 10)], "pack_name string, capacity long")
    assert packing.pack_items(none, packs).placed.count() == 0
    some = spark.createDataFrame([(1, 2)], "id long, length long")
    assert packing.pack_items(some, packs.limit(0)).report.count() == 0


# Cube.


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    patterns = cube.Patterns.of([[0], [1], [2], [0, 1], [1, 2]], 3)
    rows = patterns.dense(np.arange(5)).T
    pattern = rng.integers(0, 5, 400)
    first = np.array([0.3, 0.2, 0.5, 0.45, 0.7])[pattern]
    p = cube.flight(first, first, pattern, patterns, rng)
    assert ((p > 0) & (p < 1)).sum() <= 4
    for j in range(3):
        x = rows[pattern, j]
        assert (x * p).sum() == pytest.approx((x * first).sum(), abs=1e-6) or (x * p / first).sum() == pytest.approx(x.sum(), abs=1e-6)
    landed = cube.flight(p, first, pattern, patterns, rng, np.array([0, 1, 2]))
    assert set(np.unique(landed)) <= {0.0, 1.0}


def test_flight_is_fair():
    rng = np.random.default_rng(1)
    rows = cube.Patterns.of([[0], [1]], 2)
    pattern, first = np.array([0, 0, 1, 1, 1]), np.array([0.2, 0.8, 0.5, 0.25, 0.75])
    mean = np.mean([cube.flight(first, first, pattern, rows, rng, np.array([0, 1])) for _ in range(4000)], axis=0)
    assert np.allclose(mean, first, atol=0.03)


TARGETS = "function_name string, target_share double, min_rows long"


def samples(spark, rows):
    return spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "sample_id long, applied_functions array<string>, function_name string")


def test_sample_follows_targets(spark):
    rng = random.Random(2)
    rows = [[rng.choice(["a", "A ", " a", "a"])] for _ in range(2000)] + [["b"]] * 300 + [["c", "a"]] * 200 + [["rare"]] * 4 + [["other"]] * 100 + [None, [], [None], [""]] * 5
    targets = spark.createDataFrame([("a", 0.5, 10), ("b", 0.3, 10), ("c", 0.15, 5), ("rare", 0.05, 6), ("absent", 0.0, 3)], TARGETS)
    made = cube.cube_sample(samples(spark, rows), targets, fraction=0.1, shard_rows=300)
    got = {r.function_name: r for r in made.report.collect()}
    assert abs(got["a"].residual) <= 3 and abs(got["b"].residual) <= 3 and abs(got["c"].residual) <= 3
    assert got["rare"].drawn == 4 and got["rare"].minimum_met and not got["rare"].share_met
    assert got["absent"].drawn == 0
    drawn = made.drawn.collect()
    assert Counter(n for r in drawn for n in r.names)["a"] == got["a"].drawn
    assert all("other" not in r.names for r in drawn) and len({r.id for r in drawn}) == len(drawn)


def test_sample_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert cube.cube_sample(samples(spark, []), targets).report.first().drawn == 0
    assert cube.cube_sample(samples(spark, [["a"]]), targets).report.first().drawn == 1
    assert cube.cube_sample(samples(spark, [["a"]]), targets.limit(0)).drawn.count() == 0


# Mixing.


def test_water_filling():
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 60) == {"a": 10, "b": 50}
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}, 60) == {"a": 10, "b": 20}
    assert mixing.water_fill({"a": 0.0, "b": 1.0}, {"a": 10, "b": 0}, 60) == {"a": 0, "b": 0}
    assert mixing.water_fill({}, {}, 5) == {}


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, source string, text string, tokens int")


def test_mix(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["house", "tree", "river"]) for _ in range(rng.randrange(5, 40)))
    rows = [("big", text()) for _ in range(600)] + [("small", text()) for _ in range(40)] + [(None, "x y"), ("other", "x"), ("big", None), ("big", "")]
    targets = spark.createDataFrame([("big", 0.7, 1, "x"), ("small", 0.3, 2, "x"), ("none", 0.0, 5, "x")], "source string, target_share double, max_repeats long, tokens string")
    docs = documents(spark, rows)
    made = mixing.mix_sources(docs.unionByName(docs.limit(30)), targets)
    report = {r.source: r for r in made.report.collect()}
    assert report["small"].repeats_most == 2 and report["small"].drawn_tokens == 2 * report["small"].available_tokens
    assert report["big"].repeats_most == 1 and abs(report["big"].drawn_tokens - report["big"].due_tokens) <= 40
    assert report["none"].drawn_tokens == 0
    drawn = made.drawn.collect()
    assert len({r.id for r in drawn}) == len(drawn) and all(r.source in ("big", "small") for r in drawn)
    again = mixing.mix_sources(docs, targets).drawn
    assert sorted((r.id, r.repeats) for r in again.collect()) == sorted((r.id, r.repeats) for r in drawn)


def test_fractional_repeats_hit_the_total(spark):
    docs = documents(spark, [("a", "one two three four")] * 200 + [("b", "one two three four")] * 200)
    targets = spark.createDataFrame([("a", 0.75, 3), ("b", 0.25, 3)], "source string, target_share double, max_repeats long")
    report = {r.source: r for r in mixing.mix_sources(docs, targets).report.collect()}
    assert report["a"].actual_share == pytest.approx(0.75, abs=0.01) and report["a"].repeats_most == 2


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats long")
    assert mixing.mix_sources(documents(spark, []), targets).report.first().drawn_tokens == 0


def test_repeated_marks(spark):
    df = spark.createDataFrame([(["x-Y", " x y ", None, ""],)], "n array<string>")
    assert df.select(cube.clean_names(F.col("n")).alias("v")).first().v == ["x_y"]


def test_minimum_that_only_mixed_records_could_fill(spark):
    targets = spark.createDataFrame([("a", 0.9, 0), ("rare", 0.1, 4)], TARGETS)
    rows = [["a"]] * 50 + [["rare"]] * 2 + [["rare", "other"]] * 5
    got = {r.function_name: r for r in cube.cube_sample(samples(spark, rows), targets, fraction=0.2).report.collect()}
    assert (got["rare"].available, got["rare"].alone, got["rare"].minimum_met) == (7, 2, True) and got["rare"].drawn >= 4
    assert got["a"].minimum_met and got["a"].alone == 50


def test_mixed_records_are_left_where_nothing_needs_them(spark):
    targets = spark.createDataFrame([("a", 0.9, 0), ("b", 0.1, 2)], TARGETS)
    made = cube.cube_sample(samples(spark, [["a"]] * 50 + [["b"]] * 20 + [["b", "other"]] * 30), targets, fraction=0.5)
    assert all("other" not in r.names for r in made.drawn.collect())


def test_many_patterns_need_no_dense_table():
    lists = [[i % 1000, (i * 7 + 1) % 1000] for i in range(20_000)]
    patterns = cube.Patterns.of(lists, 1000)
    p = cube.rake(patterns, np.ones(20_000), np.full(1000, 8.0), rounds=20)
    assert np.allclose(patterns.totals(p), 8, atol=0.5)
