"""Labels, thresholds, curves and model outputs with answers known by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.functions.scalar import at_least, resampled_size, split_of
from voluma.operators import intensity as I
from voluma.operators import labels as L
from voluma.operators import learning as N
from voluma.operators import raster as R


def test_shell_and_interior_of_a_cube(spark):
    cube = [(0, z, y, x, 7 if all(1 <= c <= 3 for c in (z, y, x)) else 0) for z, y, x in itertools.product(range(5), repeat=3)]
    out = L.class_totals(L.shell_interior(spark.createDataFrame(cube, "v int, z int, y int, x int, label int"), ["v"]), ["v"]).first()
    assert (out.shell, out.interior) == (26, 1)


def test_inclusive_single_precision_threshold(spark):
    for t in (0.47, 0.46):
        exact = np.float32(t)
        values = [float(np.nextafter(exact, np.float32(0))), float(exact), float(np.nextafter(exact, np.float32(1)))]
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s float")
        assert [r.m for r in rows.orderBy("i").select(at_least("s", t).alias("m")).collect()] == [False, True, True]


def test_normalise(spark):
    rows = spark.createDataFrame([(0, float(i)) for i in range(200)] + [(1, 17.0)] * 4, "v int, value float")
    out = I.percentile_normalise(rows, ["v"])
    got = sorted(r.score for r in out.where("v = 0").collect())
    x = np.arange(200.0)
    lo, hi = np.percentile(x, [0.5, 99.5])
    assert got == pytest.approx(sorted((np.clip(x, lo, hi) - lo) / (hi - lo)))
    assert {r.score for r in out.where("v = 1").collect()} == {0.0}
    with pytest.raises(Exception, match="finite"):
        I.checked(spark.createDataFrame([(float("nan"),)], "value double")).collect()


def test_softmax_collapse(spark):
    rows = spark.createDataFrame([([0.0, math.log(2), math.log(3)],)], "logits array<double>")
    row = N.class_output(rows, threshold=0.8).first()
    assert row.probability == pytest.approx(5 / 6) and (row["class"], row.shell, row.interior, row.mask) == (2, False, True, True)
    assert not N.class_output(rows, threshold=0.94).first().mask


def test_selection_score(spark):
    target, predicted = [0, 1, 2, 0, 1, 2, 0, 0], [0, 1, 1, 0, 1, 2, 0, 0]
    rows = spark.createDataFrame([(0, p, t) for p, t in zip(predicted, target)], "v int, predicted int, target int")
    row = N.selection_score(rows, ["v"]).first()
    assert (row.foreground_dice, row.shell_dice, row.interior_dice) == pytest.approx((1.0, 0.8, 2 / 3))


def test_resume(spark):
    rows = spark.createDataFrame([("a", 17, True, "p17"), ("a", 18, False, "p18"), ("b", 17, False, "p17")], "run string, epoch int, complete boolean, path string")
    out = {r.run: (r.path, r.start_epoch) for r in N.resume_pick(rows, ["run"], "epoch", "complete", "path").collect()}
    assert out == {"a": ("p17", 18), "b": ("p17", 17)}


def test_sizes_and_splits(spark):
    rows = spark.createDataFrame([(3, 1.6), (4, 0.4), (5, 0.8)], "n int, s double")
    assert [r.m for r in rows.orderBy("n").select(resampled_size("n", "s", 0.8).alias("m")).collect()] == [5, 3, 5]
    with pytest.raises(Exception, match="no split"):
        spark.createDataFrame([(600,)], "v int").select(split_of("v")).collect()


def test_resampling_keeps_a_ramp(spark):
    rows = spark.createDataFrame([(0, z, y, x, float(z)) for z in range(5) for y in range(2) for x in range(2)], "v int, z int, y int, x int, value double")
    out = I.trilinear_resample(rows, ["v"], {"z": 5, "y": 2, "x": 2}, {"z": 1.0, "y": 1.0, "x": 1.0}, 0.5)
    assert [r.value for r in out.where("y = 0 and x = 0").orderBy("z").collect()] == pytest.approx([i / 2 for i in range(9)])


def test_raster_of_a_straight_line(spark):
    points = spark.createDataFrame([(3, 0, 8.0, 8.0, 2.0, 1.5), (3, 1, 8.0, 8.0, 12.0, 1.5)], "curve int, ord int, z double, y double, x double, radius double")
    out = R.rasterise(R.tessellate(points, "curve", "ord", "radius", 2.0), (16, 16, 16), "curve")
    row = out.where("z = 8 and y = 8 and x = 7").first()
    assert (row.label, row.dist) == (3, 0) and row.prob == pytest.approx(1, abs=1e-6)
    assert out.where("label > 0 and dist > 2.1").count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "v int, z int, y int, x int, label int, prob double")
    assert L.shell_interior(empty, ["v"]).count() == 0
    assert L.subset_fixed_fraction(empty, ["v"], 0.5).count() == 0
    assert R.scatter(empty, ["v"], F.lit(0.0), F.col("prob"), F.col("label")).count() == 0
