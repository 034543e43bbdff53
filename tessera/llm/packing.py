"""Filling containers of fixed capacity: a configuration linear program over the histogram.

How many items there are of each size is all that matters, and there are at most as many
sizes as the capacity. So the histogram (never the items) comes to the driver. A
configuration is a multiset of sizes that fits one container; the program asks for the
fewest containers whose configurations cover the histogram. Multiplicative weights hold a
price per size; a knapsack by dynamic programming over the prices yields, for every size,
the best configuration that holds it; prices of sizes covered too much fall, of others
rise. The averaged solution is rounded to whole containers, and what rounding leaves is
filled by exact subset sums. Items then find their container by their rank in their size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import DEFAULT_TOKENIZER, token_counts
from tessera.runtime import materialize

CAPACITY = 2048
ROUNDS = 60
STEP = 0.5


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per space: the best total price, and the size taken first (-1: leave one unit empty)."""
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for space in range(1, capacity + 1):
        best[space] = best[space - 1]
        k = fits[space]
        if k:
            value = best[space - sizes[:k]] + prices[:k]
            j = int(value.argmax())
            if value[j] > best[space] + 1e-12:
                best[space], first[space] = value[j], j
    return best, first


Config = tuple[tuple[int, int], ...]


def _configurations(sizes: np.ndarray, first: np.ndarray, capacity: int) -> list[Config]:
    """For each size, that size and the knapsack's best filling of the space left."""
    fillings: dict[int, Counter] = {}

    def filling(space: int) -> Counter:
        trail = []
        while space not in fillings and space > 0:
            trail.append(space)
            space -= int(sizes[first[space]]) if first[space] >= 0 else 1
        have = fillings.get(space, Counter())
        for at in reversed(trail):
            if first[at] >= 0:
                have = have.copy()
                have[int(first[at])] += 1
            fillings[at] = have
        return have

    out = []
    for j, size in enumerate(sizes):
        c = filling(capacity - int(size)).copy()
        c[j] += 1
        out.append(tuple(sorted(c.items())))
    return out


def solve_fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[Config, float], float]:
    """Configurations with their fractional numbers, and the best lower bound met.

    The bound is the dual's: no container is worth more than the knapsack's optimum, so
    the histogram's worth divided by it needs at least that many containers.
    """
    prices = sizes / capacity
    amounts: Counter = Counter()
    bound = 0.0
    for _ in range(rounds):
        best, first = _knapsack(sizes, prices, capacity)
        bound = max(bound, float(demand @ prices) / max(best[capacity], 1e-12))
        configs = _configurations(sizes, first, capacity)
        covered = np.zeros(len(sizes))
        for j, c in enumerate(configs):
            own = dict(c)[j]
            amount = demand[j] / own
            amounts[c] += amount
            for k, a in c:
                covered[k] += a * amount
        share = covered / demand
        share /= share @ (demand * sizes) / (demand @ sizes)
        prices = prices * np.exp(-step * (np.minimum(share, 4) - 1))
        prices *= (demand @ sizes) / capacity / (demand @ prices)
        step *= 0.97
    total = np.zeros(len(sizes))
    for c, x in amounts.items():
        for k, a in c:
            total[k] += a * x
    scale = float(demand.sum() / total.sum())
    return {c: x * scale for c, x in amounts.items()}, bound


def _fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> Config:
    """The largest size left, and a subset of the rest that fills its container best."""
    big = int(np.flatnonzero(left)[-1])
    left = left.copy()
    left[big] -= 1
    space = capacity - int(sizes[big])
    mask = (1 << (space + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    sums = 1
    for j in np.flatnonzero((left > 0) & (sizes <= space))[::-1].tolist():
        size, copies, chunk = int(sizes[j]), min(int(left[j]), space // int(sizes[j])), 1
        while copies:
            take = min(chunk, copies)
            steps.append((j, take, sums))
            sums = (sums | (sums << (take * size))) & mask
            copies -= take
            chunk *= 2
        if sums >> space & 1:
            break
    at = sums.bit_length() - 1
    held = Counter({big: 1})
    for j, take, had in reversed(steps):
        if not had >> at & 1:
            held[j] += take
            at -= take * int(sizes[j])
    return tuple(sorted(held.items()))


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Whole configurations (size -> items, and how many such containers) holding every
    item of ``histogram`` once, and the lower bound on containers."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes lie between 1 and the capacity")
    full = histogram.get(capacity, 0)
    plan: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    rest = sorted((s, n) for s, n in histogram.items() if s < capacity and n > 0)
    if not rest:
        return plan, float(full)
    sizes, demand = np.array([s for s, _ in rest]), np.array([n for _, n in rest], np.int64)
    amounts, bound = solve_fractional(sizes, demand.astype(float), capacity, rounds)
    left = demand.copy()
    waste = {c: capacity - sum(int(sizes[j]) * a for j, a in c) for c in amounts}
    chosen: Counter = Counter()
    order = sorted(amounts, key=lambda c: (waste[c], -amounts[c], c))
    for whole in (False, True):
        for c in order:
            if waste[c] and whole:
                break
            most = min(int(left[j]) // a for j, a in c)
            most = most if whole else min(most, round(amounts[c]))
            if most:
                chosen[c] += most
                for j, a in c:
                    left[j] -= a * most
    while left.any():
        c = _fill(sizes, left, capacity)
        most = min(int(left[j]) // a for j, a in c)
        chosen[c] += most
        for j, a in c:
            left[j] -= a * most
    plan += [({int(sizes[j]): a for j, a in c}, n) for c, n in chosen.items()]
    return plan, full + max(bound, float(demand @ sizes) / capacity)


@dataclass(frozen=True)
class Slots:
    """Where the items of each size go, by rank: from ``low`` on, ``each`` to a container."""

    size: np.ndarray
    low: np.ndarray
    base: np.ndarray
    each: np.ndarray


def slots_of(plan: list[tuple[dict[int, int], int]]) -> Slots:
    rows, seen, base = [], Counter(), 0
    for config, n in plan:
        for size, each in sorted(config.items()):
            rows.append((size, seen[size], base, each))
            seen[size] += each * n
        base += n
    rows.sort()
    return Slots(*(np.array(x, np.int64) for x in zip(*rows))) if rows else Slots(*(np.zeros(0, np.int64),) * 4)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number, and each item's rank among the task's items of its size."""
    seen = np.zeros(1, np.int64)
    task = TaskContext.get().partitionId()
    for batch in batches:
        size = batch.column(2).to_numpy()
        if not len(size):
            continue
        if size.max() >= len(seen):
            seen = np.concatenate((seen, np.zeros(size.max() + 1 - len(seen), np.int64)))
        order = np.argsort(size, kind="stable")
        grouped = size[order]
        heads = np.flatnonzero(np.concatenate(([True], np.diff(grouped) != 0)))
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size)) - np.repeat(heads, np.diff(np.append(heads, len(size)))) + seen[grouped]
        seen += np.bincount(size, minlength=len(seen))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), task, np.int64)), pa.array(rank)], names=["key", "part", "n_tokens", "task", "local"])


def _placer(slots: Slots) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = int(slots.low.max() + 1) if len(slots.low) else 1
        places = slots.size * shift + slots.low
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = np.searchsorted(places, size * shift + np.minimum(rank, shift - 1), side="right") - 1
            at = np.maximum(at, 0)
            box = slots.base[at] + (rank - slots.low[at]) // slots.each[at] if len(places) else np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(box, pa.int64(), mask=size == 0)], names=["key", "part", "n_tokens", "container"])

    return run


def pack(counts: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """(key, part, n_tokens, container): every item in exactly one container.

    Only an item larger than ``capacity`` is split: full containers first, part by part,
    then its rest as an item. An item of size 0 (or null) takes no space and no container
    (null). No rows give no rows. Ranks within a size are counted per task and then shifted
    by the tasks before, so that a size held by a third of all items is no single task's.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    last = F.greatest(F.floor((n - 1) / capacity), F.lit(0)).cast("long")
    items = counts.select(F.col(key).alias("key"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    items = items.select("key", "part", F.when(F.col("part") < F.floor((F.col("n") - 1) / capacity), F.lit(capacity).cast("long")).otherwise(F.col("n") - F.col("part") * capacity).alias("n_tokens"))
    kind = counts.schema[key].dataType
    fields = [T.StructField("key", kind), T.StructField("part", T.LongType()), T.StructField("n_tokens", T.LongType())]
    ranked = materialize(items.mapInArrow(_ranked, T.StructType([*fields, T.StructField("task", T.LongType()), T.StructField("local", T.LongType())])), "pack-items")
    per = materialize(ranked.groupBy("task", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "pack-histogram")
    histogram = {r["n_tokens"]: r["n"] for r in per.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect() if r["n_tokens"]}
    plan, _ = plan_containers(histogram, capacity, rounds)
    ahead = W.partitionBy("n_tokens").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    shifts = per.select("task", "n_tokens", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = ranked.join(shifts.hint("merge"), ["task", "n_tokens"]).select("key", "part", "n_tokens", (F.col("ahead") + F.col("local")).alias("rank"))
    # the shifts grow with the number of tasks, so they are joined, never broadcast
    return placed.mapInArrow(_placer(slots_of(plan)), T.StructType([*fields, T.StructField("container", T.LongType())])).withColumnRenamed("key", key)


def pack_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``pack`` over the token counts of every text."""
    return pack(token_counts(df, key, text, tokenizer), key, "n_tokens", capacity)
