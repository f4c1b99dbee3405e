"""Components over tiles and links against a search voxel by voxel."""

import itertools
import random

import pytest

from voluma.operators import grid as G

SPAN = [(-3, 5), (-1, 4), (-4, 6)]


def volume(seed, share):
    rng = random.Random(seed)
    return {p for p in itertools.product(*[range(a, b) for a, b in SPAN]) if rng.random() < share}


def searched(points, connectivity):
    """Voxel -> the smallest voxel that it reaches."""
    found = {}
    for p in sorted(points):
        todo = [] if p in found else [p]
        while todo:
            q = todo.pop()
            if q in points and q not in found:
                found[q] = p
                todo += [tuple(a + b for a, b in zip(q, o)) for o in G.offsets(connectivity)]
    return found


@pytest.mark.parametrize(("tile", "at_once"), [({"z": 2, "y": 3, "x": 2}, 500_000), ({"z": 2, "y": 3, "x": 2}, 0), ({"z": 32, "y": 32, "x": 512}, 500_000)])
@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components_are_those_of_a_search(spark, monkeypatch, connectivity, tile, at_once):
    monkeypatch.setattr(G, "TILE", tile)
    monkeypatch.setattr(G, "AT_ONCE", at_once)
    wholes = {("a", 1): volume(connectivity, 0.3), ("b", 1): volume(connectivity + 1, 0.55), ("b", 2): volume(connectivity + 2, 0.15)}
    rows = [(*k, *p) for k, points in wholes.items() for p in points]
    got = G.components(spark.createDataFrame(rows, "v string, w int, z int, y int, x int"), ["v", "w"], connectivity).collect()
    want = {(*k, *p): q for k, points in wholes.items() for p, q in searched(points, connectivity).items()}
    assert len(got) == len(want) and {(r.v, r.w, r.z, r.y, r.x): tuple(r.component) for r in got} == want


def test_links_of_a_long_column_take_few_tables(spark, monkeypatch):
    """A column of 3,000 planes; rounds over tables doubled what they reach, each with tables of its own."""
    stored = []
    monkeypatch.setattr(G, "saved", lambda df, name, own=G.saved: stored.append(name) or own(df, name))
    rows = spark.range(3000).selectExpr("0 as v", "cast(id as int) as z", "0 as y", "0 as x")
    assert G.components(rows, ["v"], 26).select("component").distinct().count() == 1
    assert len(stored) <= 3
