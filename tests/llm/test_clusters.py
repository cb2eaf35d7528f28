"""Clusters with Elkan's bounds against assignment by all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from repolith.llm import clusters
from tests.llm.conftest import same

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v string, `sums` int, distance long"


def brute(rows, k=40, rounds=5, n=64):
    whole = lambda x: int(x) * 256 if abs(x) > 2**60 else math.floor(256 * x)
    kept = [(i, [whole(x) for x in e]) for i, e, *_ in rows if e is not None and len(e) == n and all(x is not None and math.isfinite(x) for x in e)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((squared(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    last, total = [(i, *near(v)) for i, v in kept], {}
    for _, d, j in last:
        total[j] = total.get(j, 0) + d
    fits = lambda x: x if x < 2**63 else None
    return [(i, j, fits(d), fits(total[j]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in last]


def vectors(seed=1, large=False):
    """Groups, ties, repeats, equal first centroids, wrong lengths, nulls and values that aren't finite."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)]) for i in range(250)]
    rows += [(i, list(middles[0])) for i in range(250, 330)] + [(i, [rng.choice([0.0, 1 / 256, -1 / 256]) for _ in range(64)]) for i in range(330, 380)]
    rows += [(400, [0.5] * 63), (401, [0.5] * 65), (402, None), (403, [None] + [0.5] * 63), (404, [math.nan] + [0.5] * 63), (405, [math.inf] * 64), (406, []), (None, [0.25] * 64), (None, [0.5] * 64)]
    rows += rows[:5]
    if large:
        rows += [(500 + i, [1e7 * i] * 64) for i in range(4)] + [(510, [1e300] + [0.0] * 63), (511, [-3.5e15 + 0.5] * 64)]
    return [(*r, 1, 2, "v", 3, 4) for r in rows]


@pytest.mark.parametrize("large", [False, True])
def test_against_brute_force(spark, large):
    rows = vectors(large=large)
    same(clusters.clustered(spark.createDataFrame(rows, SCHEMA).repartition(5)), brute(rows))


def test_few_vectors_and_none(spark):
    rows = vectors()[:3]
    same(clusters.clustered(spark.createDataFrame(rows, SCHEMA)), brute(rows))
    assert clusters.clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clusters.clustered(spark.createDataFrame([(1, [0.5], 1, 1, "", 1, 1)], SCHEMA)).count() == 0


def test_bounds_hold_and_spare_most_distances():
    rng = np.random.default_rng(4)
    x = (rng.integers(-300, 300, (20, 64))[rng.integers(0, 20, 2000)] + rng.integers(-20, 20, (2000, 64))).astype(np.int64)
    centres, before = x[:30].tolist(), None
    cluster, upper, lower = np.full(len(x), -1), np.zeros(len(x), np.float32), np.zeros((len(x), 30), np.float32)
    for turn in range(5):
        _, computed = clusters.Round(centres, before).pruned(x, cluster, upper, lower)
        every = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all()
        assert (upper.astype(np.float64) >= np.sqrt(every[np.arange(len(x)), cluster])).all()
        assert (lower.astype(np.float64) <= np.sqrt(every)).all()
        assert turn == 0 or computed < 0.2 * every.size
        before, centres = centres, [(x[cluster == j].sum(0) // (cluster == j).sum()).tolist() if (cluster == j).any() else c for j, c in enumerate(centres)]


@pytest.mark.parametrize("number", [0, 5, -5, 2**40, -(2**40), 10**80, -(10**80), 2**63])
def test_limbs(number):
    sums = clusters._Sums()
    sums.add(1, 2, number)
    assert sum(e["n"] << 32 * e["limb"] for e in sums.entries()) == number
