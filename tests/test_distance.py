"""Distances and morphology against comparing every voxel with every other."""

import itertools
import random

from pyspark.sql import functions as F

from voluma.operators import distance

SIZE = (5, 6, 4)
GRID = list(itertools.product(*map(range, SIZE)))


def l1(a, b):
    return sum(abs(x - y) for x, y in zip(a, b))


def fixture(spark, seed, part=0.4):
    rng = random.Random(seed)
    labels = {p: rng.randint(1, 3) if rng.random() < part else 0 for p in GRID}
    rows = spark.createDataFrame([("v", *p, k) for p, k in labels.items()], "volume_id string, z int, y int, x int, label int")
    sizes = spark.createDataFrame([("v", *SIZE)], "volume_id string, nz int, ny int, nx int")
    return rows, distance.boxes_of(sizes, ["volume_id"], {"z": "nz", "y": "ny", "x": "nx"}), labels


def around(p, reach):
    return [q for q in itertools.product(*[range(a - reach, a + reach + 1) for a in p]) if l1(p, q) <= reach]


def depth_of(p, mine, labels):
    return min(l1(p, q) for q in around(p, 7) if not mine(labels.get(q, 0)))


def test_distances(spark):
    rows, boxes, labels = fixture(spark, 1, 0.1)
    own = {k: [p for p in GRID if labels[p] == k] for k in sorted(set(labels.values()) - {0})}
    for bound in (2, distance.FAR):
        got = {(r.label, r.z, r.y, r.x): r.d for r in distance.distances(rows.where("label > 0"), boxes, ["volume_id"], bound=bound).collect()}
        assert got == {(k, *p): d for k in own for p in GRID if (d := min(l1(p, q) for q in own[k])) <= bound}
    near = {(r.z, r.y, r.x): (r.d, r.label) for r in distance.distances(rows.where("label > 0"), boxes, ["volume_id"], each=False).collect()}
    assert near == {p: min((l1(p, q), k) for k in own for q in own[k]) for p in GRID}
    assert distance.distances(rows.where("label > 9"), boxes, ["volume_id"]).count() == 0
    beyond = spark.createDataFrame([("v", -2, 1, 1, 5), ("v", 1, 1, 9, 4)], rows.schema)
    out = {(r.z, r.y, r.x): (r.d, r.label) for r in distance.distances(beyond, boxes, ["volume_id"], each=False).collect()}
    assert out == {p: min((l1(p, (-2, 1, 1)), 5), (l1(p, (1, 1, 9)), 4)) for p in GRID}


def test_depths(spark):
    rows, boxes, labels = fixture(spark, 2, 0.95)
    got = {(r.z, r.y, r.x): r.depth for r in distance.depths(rows.where("label > 0"), boxes, ["volume_id"]).collect()}
    assert got == {p: depth_of(p, lambda k, m=labels[p]: k == m, labels) for p in GRID if labels[p]}


def test_morphology(spark):
    rows, boxes, labels = fixture(spark, 3, 0.5)
    radius = {1: 3.0, 2: -2.5, 3: 0.5}
    column = F.when(F.col("label") == 1, 3.0).when(F.col("label") == 2, -2.5).otherwise(0.5)
    got = {(r.z, r.y, r.x): r.label for r in distance.morph_labels(rows, boxes, ["volume_id"], lambda r: r.withColumn("radius", column), -2.5, 3.0).collect()}
    want = {}
    for p in GRID:
        signed = {k: -depth_of(p, lambda x, m=k: x == m, labels) if labels[p] == k else min(l1(p, q) for q in GRID if labels[q] == k) for k in radius}
        ground = depth_of(p, lambda x: x > 0, labels) if labels[p] else -min(l1(p, q) for q in GRID if labels[q])
        score, k = min((signed[k] - radius[k], k) for k in radius)
        if score < ground:
            want[p] = k
    assert got == want and any(labels[p] != k for p, k in want.items()) and any(labels[p] and p not in want for p in GRID)


def test_hollows_are_refilled_with_the_nearest(spark):
    rows, boxes, labels = fixture(spark, 4, 1.0)
    rows = rows.withColumn("label", F.when(F.col("z") == 0, 3).when(F.col("x") == 3, 2).otherwise(1))
    labels = {p: 3 if p[0] == 0 else 2 if p[2] == 3 else 1 for p in GRID}
    got = {(r.z, r.y, r.x): r.label for r in distance.hollow_and_refill(rows, boxes, ["volume_id"], lambda r: r.withColumn("width", F.lit(2.0)), F.col("label") == 1).collect()}
    want = dict(labels)
    for p in GRID:
        if labels[p] == 1 and depth_of(p, lambda k: k == 1, labels) >= 2:
            want[p] = min((l1(p, q), labels.get(q, 0)) for q in around(p, 6) if labels.get(q, 0) != 1)[1]
    assert got == want and want != labels
