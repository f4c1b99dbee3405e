"""Prepared volumes and curves at equal steps, against numpy and answers known by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.operators import raster, resample

HEAD = "volume_id string, nz int, ny int, nx int, zooms array<double>, affine array<double>, unit int"


def rows_of(spark, name, array):
    return spark.createDataFrame([(name, *map(int, p), float(array[tuple(p)])) for p in np.argwhere(np.ones(array.shape))], "volume_id string, z int, y int, x int, value double")


def reference(array, zooms, target):
    """Gaussian with reflected ends and linear reading along each axis, by numpy."""
    for axis, s in enumerate(zooms):
        n = array.shape[axis]
        sigma = max(target / s - 1, 0) / 2
        if sigma:
            reach = int(4 * sigma + 0.5)
            w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
            at = [[(j if (j := (i + k) % (2 * n)) < n else 2 * n - 1 - j) for k in range(-reach, reach + 1)] for i in range(n)]
            array = np.moveaxis((np.moveaxis(array, axis, -1)[..., at] * (w / w.sum())).sum(-1), -1, axis)
        m = int(np.rint((n - 1) * s / target)) + 1
        p = np.clip((n - 1) / 2 + (np.arange(m) - (m - 1) / 2) * target / s, 0, n - 1)
        array = np.apply_along_axis(lambda v: np.interp(p, np.arange(n), v), axis, array)
    return array


def test_chain_against_numpy(spark):
    """Axes 2, 0, 1 of (4, 5, 3) voxels of 0.4, 0.8, 1.6 give a grid of (5, 3, 5) at 0.8, smoothed along one axis, with the same centre."""
    array, zooms = np.arange(60, dtype=float).reshape(4, 5, 3), [0.4, 0.8, 1.6]
    affine = np.diag([*zooms, 1.0])
    affine[:3, 3] = (10, 20, 30)
    other = np.random.default_rng(0).random((9, 2, 1))
    heads = spark.createDataFrame([("a", 4, 5, 3, zooms, affine.ravel().tolist(), 3), ("b", 9, 2, 1, [0.2, 3.0, 0.5], np.diag([0.2, 3.0, 0.5, 1]).ravel().tolist(), 3)], HEAD)
    voxels = rows_of(spark, "a", array).union(rows_of(spark, "b", other))
    order = (2, 0, 1)
    out, new = resample.prepare_volumes(voxels, heads, order, 0.8)
    new = {r.volume_id: r for r in new.collect()}
    assert (new["a"].nz, new["a"].ny, new["a"].nx) == (5, 3, 5)
    sigma = resample.target_headers(resample.permuted(heads, order), 0.8).where("volume_id = 'a'").first().sigma
    assert sigma == pytest.approx([0, 0.5, 0])
    matrix = np.array(new["a"].affine).reshape(4, 4)
    assert np.allclose(matrix @ [2, 1, 2, 1], affine @ [1.5, 2, 1, 1]) and np.allclose(np.sqrt((matrix[:3, :3] ** 2).sum(axis=0)), 0.8)
    got = {(r.volume_id, r.z, r.y, r.x): r.value for r in out.collect()}
    for name, a, z in (("a", array, zooms), ("b", other, [0.2, 3.0, 0.5])):
        want = reference(a.transpose(order), [z[i] for i in order], 0.8)
        assert want.shape == (new[name].nz, new[name].ny, new[name].nx)
        assert all(got[name, *p] == pytest.approx(want[tuple(p)], abs=1e-9) for p in np.argwhere(np.ones(want.shape)).tolist())
    assert len(got) == 75 + math.prod((new["b"].nz, new["b"].ny, new["b"].nx))


@pytest.mark.parametrize(
    "change,message",
    [({"unit": "2"}, "not micron"), ({"zooms": "array(0D, 1D, 1D)"}, "positive and finite"), ({"affine": "array_repeat(1D, 16)"}, "independent"), ({"nz": "3"}, "lacks voxels")],
)
def test_wrong_sources_are_errors(spark, change, message):
    heads = spark.createDataFrame([("a", 2, 2, 2, [1.0] * 3, np.eye(4).ravel().tolist(), 3)], HEAD)
    voxels = rows_of(spark, "a", np.ones((2, 2, 2)))
    with pytest.raises(Exception, match=message):
        resample.prepare_volumes(voxels, heads.withColumns({k: F.expr(v) for k, v in change.items()}), (0, 1, 2), 0.8)[0].collect()
    assert resample.prepare_volumes(voxels, heads.withColumn("unit", F.lit(2)), (0, 1, 2), 0.8, assume_micron=True)[0].count() == 8
    with pytest.raises(Exception, match="must be finite"):
        resample.prepare_volumes(voxels.withColumn("value", F.lit(float("nan"))), heads, (0, 1, 2), 0.8)[0].collect()


def test_points_at_equal_steps(spark):
    curves = {
        1: [(0, 0, 0, 1), (0, 3, 0, 1), (0, 3, 4, 3)],  # length 7
        2: [(0, 0, 0, 1), (0, 0, 0, 2)],  # no length
        3: [(5, 5, 5, 1)],  # one point
        4: [(0, 0, 0, 1), (0, 0, 2, 1), (0, 0, 2, 1), (0, 0, 4, 2)],  # a point that repeats, a step that falls on it
        5: [(0, 0, 0, 1), (0, 0, 0.25, 1)],  # shorter than a step
    }
    rows = [(c, i, *map(float, p)) for c, points in curves.items() for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "curve long, ord int, z double, y double, x double, radius double")
    got = {}
    for r in raster.arc_points(df, "curve", "ord", "radius", 2.0).orderBy("curve", "point").collect():
        got.setdefault(r.curve, []).append((r.point, r.z, r.y, r.x, r.radius))
    assert [p[0] for p in got[1]] == [0, 1, 2, 3, 4] and got[1][2][1:] == pytest.approx((0, 3, 0.5, 1.25)) and got[1][4][1:] == pytest.approx((0, 3, 4, 3))
    assert [p[:4] for p in got[2]] == [(0, 0, 0, 0), (1, 0, 0, 0)] and 3 not in got
    assert [p[3] for p in got[4]] == pytest.approx([0, 2, 4]) and [p[3] for p in got[5]] == pytest.approx([0, 0.25])
    segments = raster.tessellate_arcs(df, "curve", "ord", "radius", 2.0).where("curve = 1").orderBy("seg").collect()
    assert len(segments) == 4 and segments[3].r == pytest.approx((got[1][3][4] + 3) / 2) and segments[3].x1 == pytest.approx(4)
