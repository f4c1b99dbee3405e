"""Supersteps against sequential best fit, for sizes of every kind."""

from bisect import bisect_left, insort

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.llm import packing


def best_fit(sizes, capacity):
    """Sequences that best fit of falling sizes needs."""
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect_left(gaps, size)
        if at == len(gaps):
            gap, opened = capacity, opened + 1
        else:
            gap = gaps.pop(at)
        insort(gaps, gap - size)
    return opened


def kinds(rng):
    yield "uniform", rng.integers(1, 257, 3000)
    yield "one size", np.full(1500, 60)
    yield "tiny", np.concatenate([np.ones(2000, int), rng.integers(1, 4, 500)])
    yield "small", rng.integers(20, 40, 1500)
    yield "hot", np.concatenate([np.full(700, 100), rng.integers(1, 257, 1400)])
    yield "full", np.full(300, 256)


@pytest.mark.parametrize("rows_per_task", [200_000, 400])
def test_supersteps_need_about_as_many_as_best_fit(spark, rows_per_task):
    for name, sizes in kinds(np.random.default_rng(8)):
        rows = spark.createDataFrame([(i * 3, int(n)) for i, n in enumerate(sizes)], "id long, size long")
        found = packing.places(rows, 256, rows_per_task).join(rows, "id").collect()
        assert sorted(r.id for r in found) == [i * 3 for i in range(len(sizes))], name
        sequences = {}
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == sequences.get(r.sequence_id, 0), name
            sequences[r.sequence_id] = r.offset + r.size
        assert max(sequences.values()) <= 256
        best = best_fit(sizes.tolist(), 256)
        assert len(sequences) <= best + (0 if rows_per_task > len(sizes) else 2 + best // 50), (name, len(sequences), best)


def test_one_task_gives_best_fit_itself(spark):
    sizes = np.random.default_rng(2).integers(1, 65, 800)
    rows = spark.createDataFrame(list(enumerate(sizes.tolist())), "id long, size long")
    n = packing.places(rows, 64).agg(F.countDistinct("sequence_id")).first()[0]
    assert n == best_fit(sizes.tolist(), 64)


def test_claims_by_rank():
    ranges = {0: {packing.GAP: (3, 200, 250)}, 1: {packing.PIECE: (2, 90, 100), packing.GAP: (1, 95, 95)}, 2: {packing.PIECE: (9, 10, 20)}}
    runs, settled, used = packing.claims(ranges)
    assert runs == [(1, 0, 2, 0, 0, 2), (2, 0, 4, 1, 0, 4), (2, 4, 5, 0, 1, 10)]
    assert settled == {0: 0, 1: 2, 2: 9} and used == {0: 2, 1: 1}
