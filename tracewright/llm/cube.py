"""Problem 5: a sample that matches target shares of categories (cube method).

1. Categories of a record are cleaned (blanks, case, hyphens).  A record that
   also has a category without target is drawn only where a minimum cannot be
   filled without it; that category is then no constraint.  Records without
   any targeted category are left out.
2. Inclusion probabilities: due counts come from the targets by capped
   water-filling (at least ``min_rows`` where so many exist, at most what
   exists); probabilities are raked to them over the patterns of categories
   (one row per pattern on the driver, checked against ``MAX_PATTERNS``).
3. Flight: in each shard, probabilities move along directions that change no
   weighted total of a category, until they are 0 or 1.  Records of one
   pattern are settled in pairs first, which is such a direction; the rest
   take the general step.  At most as many records as categories stay open.
4. Open records of ``FAN`` shards meet in one task for the next flight, level
   by level, so that no task holds more than ``FAN`` times that many.
5. Landing: the last open records are settled by giving up one category after
   the other, the least wanted first.  The residual imbalance is reported.

Shards are made by a hash of the id, so a category that holds a third of all
rows is spread evenly.  Defined results: null, empty or blank categories are no
category; a repeated id counts once; a target without records is reported as
not met; empty tables give an empty sample and a report of zeros.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.mixing import water_fill
from tracewright.llm.shared import written

SHARD_ROWS = 50_000
FAN = 64
MAX_TARGETS = 1_000
MAX_PATTERNS = 200_000
#: Added to a minimum, so that rounding at the landing does not undercut it.
MARGIN = 2
EPS = 1e-9
_STATE = "id long, pattern int, p double, first double, shard long"


def clean_names(names: Column) -> Column:
    """Distinct category names: trimmed, lower case, words joined by underscores; null becomes empty."""
    one = lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), r"[\s\-]+", "_")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array()), one), lambda x: x.isNotNull() & (x != ""))))


class Patterns(NamedTuple):
    """Which categories each pattern has, as index lists (a dense table would grow with both)."""

    start: np.ndarray
    which: np.ndarray
    width: int

    @staticmethod
    def of(lists: list[list[int]], width: int) -> Patterns:
        start = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
        return Patterns(start, np.array([j for x in lists for j in x], dtype=np.int64), width)

    def dense(self, ids: np.ndarray) -> np.ndarray:
        """Categories (rows) of the given patterns (columns), 0 or 1."""
        out = np.zeros((self.width, len(ids)))
        for c, i in enumerate(ids):
            out[self.which[self.start[i] : self.start[i + 1]], c] = 1
        return out

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sum of the patterns' values for each category."""
        return np.bincount(self.which, weights=np.repeat(values, np.diff(self.start)), minlength=self.width)


def rake(patterns: Patterns, size: np.ndarray, due: np.ndarray, spare: np.ndarray | None = None, rounds: int = 500) -> np.ndarray:
    """Probability per pattern so that expected counts of categories are as due, as far as 0..1 allows.

    ``spare`` patterns serve only categories that the others cannot fill.
    """
    spare = np.zeros(len(size), dtype=bool) if spare is None else spare
    owner = np.repeat(np.arange(len(size)), np.diff(patterns.start))
    alone, others = patterns.totals(np.where(spare, 0, size)), patterns.totals(np.where(spare, size, 0))
    short = due > alone + EPS
    rate = np.where(alone > 0, np.minimum(due / np.maximum(alone, 1), 1), 0.0)
    fill = np.where(short & (others > 0), np.minimum((due - alone) / np.maximum(others, 1), 1), 0.0)
    p = np.zeros(len(size))
    np.maximum.at(p, owner, np.where(spare[owner], fill[patterns.which], rate[patterns.which]))
    order = np.argsort(patterns.which, kind="stable")
    members = np.split(owner[order], np.cumsum(np.bincount(patterns.which, minlength=patterns.width))[:-1])
    for _ in range(rounds):
        worst = 0.0
        for j, has in enumerate(members):
            now = (p[has] * size[has]).sum()
            if now > 0 and due[j] > 0:
                p[has] = np.minimum(1.0, p[has] * due[j] / now)
                worst = max(worst, abs(now - due[j]))
            elif len(has) and due[j] == 0:
                p[has] = 0.0
        if worst < 0.01:
            break
    return p


def _move(p: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One step of the flight along u: to one of the two walls, so that the mean stays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(u > EPS, (1 - p) / u, np.where(u < -EPS, -p / u, np.inf)))
        down = np.min(np.where(u > EPS, p / u, np.where(u < -EPS, (p - 1) / u, np.inf)))
    p = p + up * u if rng.random() < down / (up + down) else p - down * u
    p[p < EPS] = 0.0
    p[p > 1 - EPS] = 1.0
    return p


def _kernel(a: np.ndarray) -> np.ndarray | None:
    """A direction that a maps to 0, or null."""
    _, s, v = np.linalg.svd(a)
    rank = int((s > 1e-9 * max(s[0], 1.0)).sum()) if len(s) else 0
    return v[-1] if rank < a.shape[1] else None


def flight(p: np.ndarray, first: np.ndarray, pattern: np.ndarray, patterns: Patterns, rng: np.random.Generator, land: np.ndarray | None = None) -> np.ndarray:
    """Flight phase; with ``land`` (order in which categories are given up) until nothing is open.

    ``first``: the inclusion probabilities before any flight, by which the
    constraints (one for each category, and the number of records) are weighted.
    """
    p = p.copy()
    # pairs of one pattern and one first probability: any exchange keeps every total
    key = pd.MultiIndex.from_arrays([pattern, np.round(first, 12)])
    for members in pd.Series(np.arange(len(p))).groupby([key.get_level_values(0), key.get_level_values(1)]).indices.values():
        held = -1
        for i in members:
            if not 0 < p[i] < 1:
                continue
            if held < 0:
                held = i
                continue
            a, b = p[held], p[i]
            if a + b < 1:
                keep = rng.random() < a / (a + b)
                p[held], p[i] = (a + b, 0.0) if keep else (0.0, a + b)
            else:
                keep = rng.random() < (1 - b) / (2 - a - b)
                p[held], p[i] = (1.0, a + b - 1) if keep else (a + b - 1, 1.0)
            for k in (held, i):
                if p[k] < EPS or p[k] > 1 - EPS:
                    p[k] = round(p[k])
            held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else -1
    keep = list(range(patterns.width + 1))
    drop = [*land, patterns.width] if land is not None else []
    waiting = [i for i in range(len(p)) if 0 < p[i] < 1]
    while waiting:
        window = waiting[: len(keep) + 1]
        # only the columns in the window are made, one more than there are constraints
        balanced = np.vstack([patterns.dense(pattern[window]) / np.maximum(first[window], EPS), np.ones(len(window))])
        u = _kernel(balanced[keep]) if keep else np.eye(1, len(window))[0]
        if u is None:
            if not drop:
                break
            keep.remove(drop.pop(0))
            continue
        p[window] = _move(p[window], u, rng)
        waiting = [i for i in window if 0 < p[i] < 1] + waiting[len(window) :]
    return p


class CubeSample(NamedTuple):
    drawn: DataFrame
    report: DataFrame


def cube_sample(
    records: DataFrame, targets: DataFrame, *, id_col: str = "sample_id", names_col: str = "applied_functions",
    fraction: float = 0.2, seed: int = 0, shard_rows: int = SHARD_ROWS,
) -> CubeSample:
    """Sample ``fraction`` of the category marks with the target shares.

    ``targets``: ``function_name, target_share, min_rows``.  ``drawn``: ``id,
    names``.  ``report``: ``function_name, target_share, min_rows, available,
    alone, due, drawn, actual_share, residual, share_met, minimum_met``
    (``alone``: of the available records those without any untargeted category).
    """
    spark = records.sparkSession
    wanted = targets.select("function_name", "target_share", "min_rows").limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    names = [r.function_name for r in wanted]
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    named = records.select(F.col(id_col).cast("long").alias("id"), clean_names(F.col(names_col)).alias("names"))
    aimed = F.array_intersect("names", listed)
    units = written(
        named.where(F.size(aimed) > 0)
        .dropDuplicates(["id"])
        .select("id", "names", F.array_join(aimed, "\x1f").alias("key"), (F.size("names") > F.size(aimed)).alias("mixed")),
        "cube",
    )
    found = units.groupBy("key", "mixed").agg(F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of categories")
    found.sort(key=lambda r: (r.key, r.mixed))
    at = {n: j for j, n in enumerate(names)}
    patterns = Patterns.of([[at[n] for n in r.key.split("\x1f")] for r in found], len(names))
    size = np.array([r.n for r in found], dtype=float)
    mixed = np.array([r.mixed for r in found], dtype=bool)
    available = patterns.totals(size)
    alone = patterns.totals(np.where(mixed, 0, size))
    weights = {n: float(r.target_share or 0) for n, r in zip(names, wanted, strict=True)}
    caps = {n: float(a) for n, a in zip(names, alone, strict=True)}
    minimum = np.array([min(float(r.min_rows or 0) + MARGIN, a) for r, a in zip(wanted, available, strict=True)])
    filled = water_fill(weights, caps, fraction * alone.sum())
    due = np.maximum(np.array([filled[n] for n in names]), minimum) if names else np.zeros(0)
    p = rake(patterns, size, due, mixed) if len(found) else np.zeros(0)
    chances = spark.createDataFrame([(r.key, r.mixed, i, float(p[i])) for i, r in enumerate(found)], "key string, mixed boolean, pattern int, p double")
    held = spark.sparkContext.broadcast(patterns)  # at most MAX_PATTERNS index lists
    shards = max(1, math.ceil(size.sum() / shard_rows))
    order = np.argsort([weights[n] for n in names])
    fly = _flyer(held, seed, None)
    state = written(
        units.join(F.broadcast(chances), ["key", "mixed"])  # at most MAX_PATTERNS rows
        .select("id", "pattern", "p", F.col("p").alias("first"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).alias("shard"))
        .where("p > 0")
        .groupBy("shard")
        .applyInPandas(fly, _STATE),
        "cube",
    )
    done = [state.where("p = 1").select("id")]
    rest = state.where("p < 1")
    level = shards
    while level > 1:
        level = math.ceil(level / FAN)
        rest = written(rest.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("shard").applyInPandas(fly, _STATE), "cube")
        done.append(rest.where("p = 1").select("id"))
        rest = rest.where("p < 1")
    landed = written(rest.withColumn("shard", F.lit(0).cast("long")).groupBy("shard").applyInPandas(_flyer(held, seed, order), _STATE), "cube")
    chosen = landed.where("p = 1").select("id")
    for d in done:
        chosen = chosen.unionByName(d)
    drawn = units.join(chosen, "id", "left_semi").select("id", "names")
    facts = spark.createDataFrame(
        [(n, weights[n], int(r.min_rows or 0), int(a), int(o), float(d)) for n, r, a, o, d in zip(names, wanted, available, alone, due, strict=True)],
        "function_name string, target_share double, min_rows long, available long, alone long, due double",
    )
    # marks without target count in the shares
    got = drawn.select(F.explode("names").alias("function_name")).groupBy("function_name").agg(F.count("*").alias("n"))
    got = got.withColumn("marks", F.sum("n").over(_everything()))
    share = F.coalesce(F.col("n") / F.col("marks"), F.lit(0.0))
    report = facts.join(got, "function_name", "left").select(
        "function_name", "target_share", "min_rows", "available", "alone", "due", F.coalesce("n", F.lit(0)).alias("drawn"), share.alias("actual_share"),
        (F.coalesce("n", F.lit(0)) - F.col("due")).alias("residual"),
        (F.abs(share - F.col("target_share")) <= 0.01).alias("share_met"),
        (F.coalesce("n", F.lit(0)) >= F.least("min_rows", "available")).alias("minimum_met"),
    )
    return CubeSample(drawn, report)


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def _flyer(held, seed: int, land: np.ndarray | None):
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        rng = np.random.default_rng([seed, int(group["shard"].iloc[0]), len(group)])
        p = flight(group["p"].to_numpy(), group["first"].to_numpy(), group["pattern"].to_numpy(), held.value, rng, land)
        out = group.assign(p=p)
        return out[out["p"] > 0][["id", "pattern", "p", "first", "shard"]]

    return fly
