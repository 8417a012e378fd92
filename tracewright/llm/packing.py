"""Problem 4: filling containers of fixed capacity (linear grouping scheme).

Items go to shards of at most about ``shard_rows`` by a hash of their id, and
each shard is packed on its own, so no task grows with the input; only ids and
lengths are shuffled.  In a shard:

1. An item longer than the capacity is cut into full containers and a rest.
2. Items above ``eps`` of the capacity are sorted into ``groups`` groups of
   equal cardinality and rounded up to the longest of their group.
3. With so few sizes, the best use of configurations (which sizes share a
   container) is a linear programme, solved by column generation with a
   knapsack as the pricing step; whole containers are taken from it.
4. Actual items of the planned groups replace the rounded ones, the longest of
   a group first; in the last place of a container an item of a longer group, if
   rounding left the room for it.
5. What is left over, and then the small items, go where they fit best.

Defined results: items without text (null or length 0) take no room and are
left out; a repeated id counts once; capacities below 1 and null capacities
are ignored; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import written

SHARD_ROWS = 20_000
GROUPS = 128
EPS = 0.15
#: Resolution of the capacity in the pricing knapsack.
UNITS = 2048
#: Configurations that a pricing step gives besides the best one.
EXTRA = 24
#: How far the plan may be from the optimum.
GAP = 5e-4
MAX_PACKS = 1_000
#: Most partitions that shards are spread over.
MAX_TASKS = 20_000
_PLACED = "pack_name string, capacity long, id long, piece int, start long, length long, shard long, container long"


def _columns(sizes: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """Unbounded knapsack over all sizes at once: the best configuration of all, first, and the best with each size."""
    # of sizes in rising order only those that are worth more than all smaller ones
    rising = np.argsort(sizes, kind="stable")
    worth = np.concatenate([[0.0], np.maximum.accumulate(values[rising])[:-1]])
    rising = rising[values[rising] > worth + 1e-12]
    best = np.zeros(room + 1)
    choice = np.full(room + 1, -1)
    if len(rising):
        s, v = sizes[rising], values[rising]
        upto = np.searchsorted(s, np.arange(room + 1), "right")
        for r in range(int(s[0]), room + 1):
            tried = best[r - s[: upto[r]]] + v[: upto[r]]
            g = int(tried.argmax())
            if tried[g] > best[r - 1] + 1e-12:
                best[r], choice[r] = tried[g], rising[g]
            else:
                best[r] = best[r - 1]

    def use(at: int, first: int | None = None) -> np.ndarray:
        out = np.zeros(len(sizes))
        if first is not None:
            out[first] += 1
            at -= int(sizes[first])
        while at > 0:
            if choice[at] < 0:
                at -= 1
                continue
            out[choice[at]] += 1
            at -= int(sizes[choice[at]])
        return out

    found = [use(room)]
    starts = values + best[room - sizes]
    found += [use(room, int(g)) for g in np.argsort(-starts)[:EXTRA]]
    return np.unique(np.array(found), axis=0)


def configurations(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in an optimal fractional packing.

    Column generation: the knapsack is solved only when no configuration found
    before still improves the plan, and gives several at a time.  It ends where
    the plan is proved to be within ``GAP`` of the best: a best configuration
    worth v at the present duals bounds the optimum by the plan's size over v.
    """
    m = len(sizes)
    basis = np.diag(np.floor(room / sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ counts
    pool = np.zeros((0, m))
    while True:
        duals = inverse.sum(axis=0)
        worth = pool @ duals
        if not len(worth) or worth.max() <= 1 + GAP:
            pool = np.unique(np.vstack([pool, _columns(sizes, np.maximum(duals, 0), room)]), axis=0)
            worth = pool @ duals
            if worth.max() <= 1 + GAP:
                break
        column = pool[int(worth.argmax())]
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            # a little more than 0 instead of 0, so that no step stands still
            ratio = np.where(step > 1e-9, np.maximum(amount, 1e-9 * (1 + np.arange(m) / m)) / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        amount = inverse @ counts
        amount[np.abs(amount) < 1e-9] = 0.0
    return [(basis[:, j], float(amount[j])) for j in range(m) if amount[j] > 0]


def pack(lengths: np.ndarray, capacity: int, groups: int = GROUPS, eps: float = EPS) -> np.ndarray:
    """Container number of each item; every length must be from 1 to the capacity."""
    n = len(lengths)
    container = np.full(n, -1)
    room: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > eps * capacity]
    left: list[int] = []
    if len(large):
        parts = np.array_split(large, min(groups, len(large)))
        tops = np.array([lengths[p[0]] for p in parts])
        unit = max(1.0, capacity / UNITS)
        whole = int(capacity / unit)
        sizes = np.minimum(np.ceil(tops / unit).astype(int), whole)
        counts = np.array([len(p) for p in parts])
        # of each group the items in rising order
        pool = [[(int(lengths[i]), int(i)) for i in reversed(p)] for p in parts]
        shortest = [-int(lengths[p[-1]]) for p in parts]
        plan = configurations(sizes, counts, whole)
        # the fullest configurations first, while there are items to choose from
        plan.sort(key=lambda x: -float(x[0] @ tops))
        for config, amount in plan:
            slots = [int(g) for g in np.flatnonzero(config) for _ in range(int(config[g]))]
            for _ in range(int(amount + 1e-9)):
                space = capacity
                for at, g in enumerate(slots):
                    # the longest item of the planned group that fits, none being longer than the group was rounded to;
                    # in the last place a longer one, if rounding has left the room for it
                    longer = range(bisect.bisect_left(shortest, -space), g) if at == len(slots) - 1 else ()
                    h = next((h for h in longer if pool[h] and pool[h][0][0] <= space), g)
                    k = bisect.bisect_right(pool[h], (space, n)) - 1
                    if k >= 0:
                        size, i = pool[h].pop(k)
                        container[i] = len(room)
                        space -= size
                if space < capacity:
                    room.append(space)
        pool = sorted(x for group in pool for x in group)
        left = [i for _, i in reversed(pool)]
    # best fit: the container with the least room that suffices
    free = sorted((r, b) for b, r in enumerate(room))
    for i in [*left, *order[lengths[order] <= eps * capacity].tolist()]:
        size = int(lengths[i])
        k = bisect.bisect_left(free, (size, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        container[i] = b
        if r - size > 0:
            bisect.insort(free, (r - size, b))
    return container


def _pack_shard(groups: int, eps: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        capacity = int(pdf["capacity"].iloc[0])
        length = pdf["length"].to_numpy()
        full = length // capacity
        rest = length - full * capacity
        item = np.repeat(np.arange(len(pdf)), full + (rest > 0))
        piece = np.arange(len(item)) - np.repeat(np.cumsum(full + (rest > 0)) - (full + (rest > 0)), full + (rest > 0))
        size = np.minimum(length[item] - piece * capacity, capacity)
        out = pdf.loc[item, ["pack_name", "capacity", "id"]].reset_index(drop=True)
        out["piece"] = piece.astype(np.int32)
        out["start"] = piece * capacity
        out["length"] = size
        out["shard"] = pdf["shard"].iloc[0]
        out["container"] = pack(size, capacity, groups, eps)
        return out

    return run


class Packing(NamedTuple):
    placed: DataFrame
    report: DataFrame


def pack_items(
    items: DataFrame, packs: DataFrame, *, groups: int = GROUPS, eps: float = EPS, shard_rows: int = SHARD_ROWS
) -> Packing:
    """Pack ``items`` (``id, length``) into containers of each of ``packs`` (``pack_name, capacity``).

    ``placed``: ``pack_name, capacity, id, piece, start, length, shard,
    container``; a container is one ``(pack_name, shard, container)``.
    ``report``: per pack the items, divided items, containers, the least number
    possible and the share of room used.
    """
    one = items.where("length > 0").select(F.col("id").cast("long").alias("id"), F.col("length").cast("long").alias("length")).dropDuplicates(["id"])
    limits = packs.where("capacity >= 1").select("pack_name", F.col("capacity").cast("long").alias("capacity")).distinct().limit(MAX_PACKS + 1).collect()
    if len(limits) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs")
    held = written(one, "packing")
    shards = max(1, math.ceil(held.count() / shard_rows))
    each = F.explode(F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity).alias("capacity")) for r in limits])) if limits else None
    if each is None:
        rows = held.select(F.lit("").alias("pack_name"), F.lit(1).cast("long").alias("capacity"), "id", "length").limit(0)
    else:
        rows = held.select(each.alias("p"), "id", "length").select("p.pack_name", "p.capacity", "id", "length")
    tasks = min(max(1, len(limits) * shards), MAX_TASKS)
    placed = (
        rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
        # a given number, since shards are small to move and long to pack: they are not to be put together
        .repartition(tasks, "pack_name", "shard")
        .groupBy("pack_name", "shard")
        .applyInPandas(_pack_shard(groups, eps), _PLACED)
    )
    per = placed.groupBy("pack_name", "capacity", "shard", "container").agg(
        F.sum("length").alias("used"), F.count_if(F.col("start") == 0).alias("items"), F.count_if(F.col("piece") == 1).alias("divided")
    )
    report = per.groupBy("pack_name", "capacity").agg(
        F.sum("items").alias("items"), F.sum("divided").alias("divided_items"), F.count("*").alias("containers"),
        F.ceil(F.sum("used") / F.first("capacity")).alias("least_containers"),
        (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("used_share"), F.max("used").alias("fullest"),
    )
    return Packing(placed, report)
