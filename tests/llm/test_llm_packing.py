"""Filling of containers: everything once, nothing too full, little left over."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


def check_plan(histogram, capacity, rounds=8):
    plan, bound = packing.plan_containers(histogram, capacity, rounds)
    held = Counter()
    for config, n in plan:
        assert sum(s * a for s, a in config.items()) <= capacity and n > 0
        for s, a in config.items():
            held[s] += a * n
    assert held == Counter({s: n for s, n in histogram.items() if n})
    used = sum(n for _, n in plan)
    assert used >= math.ceil(bound - 1e-6) >= math.ceil(sum(s * n for s, n in histogram.items()) / capacity - 1e-6)
    return used, bound


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 12), max_size=10))
def test_plans_hold_everything_once(histogram):
    check_plan(histogram, 30)


def test_plans_are_tight():
    assert check_plan({10: 30, 20: 30}, 30)[0] == 30
    assert check_plan({6: 20, 5: 20, 4: 20}, 15, 40)[0] == 20
    rng = random.Random(2)
    used, bound = check_plan(Counter(min(2047, max(1, int(rng.lognormvariate(6.7, 0.7)))) for _ in range(5000)), 2048, 30)
    assert used <= 1.005 * bound
    assert check_plan({}, 10) == (0, 0.0) and check_plan({10: 4}, 10) == (4, 4.0)


def test_sizes_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.plan_containers({11: 1}, 10)


def packed(spark, rows, capacity):
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], "doc_id long, n_tokens long, part int, container string").repartition(5)
    return [tuple(r) for r in packing.pack(df, capacity=capacity, rounds=6).collect()]


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([7, 7, 7, 7, 7, rng.randint(0, 40), None])) for i in range(400)] + [(500, 20), (501, 21), (502, 60), (503, 0), (None, 5)]
    got = packed(spark, rows, 20)
    full, parts = defaultdict(int), defaultdict(list)
    for key, part, size, box in got:
        assert (box is None) == (size == 0)
        if box is not None:
            full[box] += size
        parts[key].append((part, size))
    assert max(full.values()) <= 20 and sorted(full) == list(range(len(full)))
    for key, size in rows:
        pieces = [s for _, s in sorted(parts[key])]
        assert sum(pieces) == (size or 0) and [p for p, _ in sorted(parts[key])] == list(range(len(pieces)))
        assert len(pieces) == max(1, math.ceil((size or 0) / 20)) and all(s == 20 for s in pieces[:-1])
    assert len(got) == len(set(got))


def test_nothing_to_pack(spark):
    assert packed(spark, [(1, 0), (2, None)], 20) and {r[3] for r in packed(spark, [(1, 0), (2, None)], 20)} == {None}
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(df).count() == 0
