"""Registered queries read whole tables, and volumes of any depth."""

import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from voluma.operators import intensity as I
from voluma.operators import labels as L
from voluma.operators import raster as R
from voluma.plans.oracle import ORACLES
from voluma.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
WHOLE = ["tessellate", "rasterize", "running_best", "resume_pick", "argument_differences", "grow_labels", "trilinear_resample", "tile_blend", "random_smooth_field"]


@pytest.mark.parametrize("name", WHOLE)
def test_query_is_its_sql(spark, name):
    sf = SF
    db = duckdb.connect()
    for t in ("orders", "lineitem", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = QUERIES[name](spark, sf)
    expected = db.execute(ORACLES[name])
    order = [c[0] for c in expected.description]
    def shown(rows):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    got, want = shown(map(tuple, found.select(*order).collect())), shown(expected.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6)


def grid(spark, depths):
    rows = [(v, z, y, x, n, float((z * 7 + y * 3 + x * 5 + v) % 11)) for v, n in enumerate(depths) for z, y, x in itertools.product(range(n), range(4), range(3))]
    return spark.createDataFrame(rows, "v int, z int, y int, x int, nz int, value double")


@pytest.mark.parametrize("depths", [(5, 50, 1, 83)])
def test_sizes_from_the_data(spark, depths):
    rows = grid(spark, depths)
    spacing = {"z": 1.0, "y": 0.5, "x": 0.5}
    calls = {
        "resample": lambda r, n: I.trilinear_resample(r, ["v"], {"z": n, "y": 4, "x": 3}, spacing, 0.8),
        "tiles": lambda r, n: I.blend_tiles(I.tiles_of(r, {"z": n, "y": 4, "x": 3}, 8, 0.5), ["v"], 8, F.col("value") * (1 + F.col("tz"))),
        "field": lambda r, n: L.random_field(r, r["v"], 4, {"z": n, "y": 4, "x": 3}, 17).drop("nz", "value"),
    }
    for call in calls.values():
        whole = sorted(map(tuple, call(rows, "nz").collect()))
        single = sorted(tuple(r) for v, n in enumerate(depths) for r in call(rows.where(f"v = {v}"), n).collect())
        assert len(whole) == len(single)
        for a, b in zip(whole, single):
            assert a == pytest.approx(b, abs=1e-9)
    planes = {v: max(r.z for r in call_rows) + 1 for v, call_rows in itertools.groupby(sorted(calls["resample"](rows, "nz").collect()), lambda r: r.v)}
    assert planes == {v: round((n - 1) / 0.8) + 1 for v, n in enumerate(depths)}


@pytest.mark.parametrize("name, planes", [("tile_blend", 50), ("random_smooth_field", 50)])
def test_all_planes(spark, name, planes):
    sf = SF.replace("0.001", "0.01")
    voxels = spark.read.parquet(f"{sf}/embeddings.parquet").count() * 64
    assert QUERIES[name](spark, sf).count() == voxels


def test_labels_without_a_bound(spark):
    rows = spark.createDataFrame([(0, 0, 0, 10_000, 0.2), (0, 0, 0, 3, 0.2), (0, 0, 1, 7, 0.3), (0, 0, 1, 2_000_000, 0.2), (0, 0, 2, 5_000_000_000, 0.1)], "z int, y int, x int, id long, p double")
    out = {r.x: r.label for r in R.scatter(rows, [], F.lit(0.0), F.col("p"), F.col("id")).collect()}
    assert out == {0: 10_000, 1: 7, 2: 5_000_000_000}
    points = spark.createDataFrame([(12_345, 0, 4.0, 4.0, 2.0, 2.0), (12_345, 1, 4.0, 4.0, 12.0, 2.0)], "curve long, ord int, z double, y double, x double, radius double")
    found = R.rasterise(R.tessellate(points, "curve", "ord", "radius", 2.0), (16, 16, 16), "curve")
    assert {r.label for r in found.collect()} == {0, 12_345}


def test_ridge_against_numpy(spark):
    """A bright line: responses are those of numpy's differences and eigenvalues, and the largest stand on the line."""
    import numpy as np

    from voluma.operators import ridge

    points = [(v, z, y, x, 1.0 * ((y, x) == (5, 4)) + 0.01 * ((z * 7 + y * 3 + x) % 5)) for v in (0, 1) for z in range(14 + v) for y in range(11) for x in range(9)]
    rows = spark.createDataFrame(points, "v int, z int, y int, x int, value double")
    got = {(r.v, r.z, r.y, r.x): r.ridge for r in ridge.ridge_score(rows, ["v"], sigmas=(0.5, 1.0, 4.0)).collect()}
    for v in (0, 1):
        image = np.zeros((14 + v, 11, 9))
        for w, z, y, x, value in points:
            if w == v:
                image[z, y, x] = value
        want = np.zeros(image.shape)
        for sigma in (0.5, 1.0, 4.0):
            smooth, reach = image, int(4 * sigma + 0.5)
            w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
            for axis in range(3):
                pad = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
                smooth = np.apply_along_axis(np.convolve, axis, np.pad(smooth, pad, mode="symmetric"), w / w.sum(), "valid")
            h = sigma**2 * np.stack([np.stack([np.gradient(np.gradient(smooth, axis=i), axis=j) for j in range(3)], -1) for i in range(3)], -2)
            e = np.linalg.eigvalsh(h)
            e = np.take_along_axis(e, np.argsort(np.abs(e), axis=-1), -1)
            s = np.sqrt((e**2).sum(-1))
            ra, rb = np.abs(e[..., 1]) / np.maximum(np.abs(e[..., 2]), 1e-10), np.abs(e[..., 0]) / np.sqrt(np.maximum(np.abs(e[..., 1] * e[..., 2]), 1e-10))
            response = (1 - np.exp(-(ra**2) / 0.5)) * np.exp(-(rb**2) / 0.5) * (1 - np.exp(-(s**2) / (2 * (s.max() / 2) ** 2)))
            want = np.maximum(want, np.where((e[..., 1] < 0) & (e[..., 2] < 0), response, 0))
        assert all(got[v, *p] == pytest.approx(want[tuple(p)], abs=1e-6) for p in np.argwhere(want >= 0).tolist())
        assert max((got[v, 7, y, x], y, x) for y in range(11) for x in range(9))[1:] == (5, 4)
    with pytest.raises(Exception, match="no domain mouse"):
        ridge.ridge_masks(rows, ["v"], "value", F.lit("mouse")).collect()


def test_percentiles_by_range_are_exact(spark):
    import numpy as np

    groups = {"a": np.random.default_rng(0).normal(0, 1, 501), "b": np.array([3.0] * 40 + [1e9]), "c": np.array([2.5]), "d": np.arange(10.0)}
    groups |= {"e": np.array([-1e300, *np.linspace(-1, 1, 3000), 1e300]), "f": np.array([-2.5, -0.0, 0.0, -1e-310, 1e-310]), "g": 1e6 + np.arange(2000) * 1e-9}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", float("nan"))], "g string, v double")
    asked = (0.0, 0.005, 0.5, 0.77, 0.995, 1.0)
    out = {r.g: r.p for r in I.percentiles_by_range(rows, ["g"], "v", asked).collect()}
    for g, vs in groups.items():
        assert out[g] == pytest.approx(np.quantile(vs, asked).tolist(), rel=1e-12)


def test_arc_points_at_an_end_that_repeats(spark):
    """Lengths for which (n - 1) * (length / (n - 1)) is rounded either way; the end stands three times."""
    lengths = [k * 0.7 for k in range(1, 400)]
    rows = [(k, o, z, 0.0, 0.0, 1.0) for k, length in enumerate(lengths) for o, z in enumerate((0.0, length, length, length))]
    points = R.arc_points(spark.createDataFrame(rows, "c int, o int, z double, y double, x double, r double"), "c", "o", "r", 2.5)
    got = {r.c: (r.n, r.d) for r in points.groupBy("c").agg(F.count("*").alias("n"), F.countDistinct("point").alias("d")).collect()}
    assert got == {k: (max(2, math.ceil(length / 2.5) + 1),) * 2 for k, length in enumerate(lengths)}
