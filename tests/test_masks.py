"""Small masks with answers known by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from voluma.operators import evaluation as E
from voluma.operators import grid as G

V = ["v"]


def voxels(spark, points):
    return spark.createDataFrame([(0, *p) for p in points], "v int, z int, y int, x int")


def dense(spark, prediction, target, valid=None):
    rows = [(0, 0, 0, x, bool(p), bool(t), True if valid is None else bool(valid[x])) for x, (p, t) in enumerate(zip(prediction, target))]
    return spark.createDataFrame(rows, "v int, z int, y int, x int, prediction boolean, target boolean, valid boolean")


def test_metrics_of_empty_and_full_masks(spark):
    row = E.voxel_metrics(dense(spark, [0, 0, 0], [0, 0, 0]), V).first()
    assert (row.dice, row.iou, row.precision, row.recall, row.fdr, row.accuracy) == (1, 1, 0, 0, 0, 1)
    row = E.voxel_metrics(dense(spark, [1, 1, 1], [0, 0, 0]), V).first()
    assert (row.tp, row.fp, row.fn, row.dice, row.fdr) == (0, 3, 0, 0, 1)


def test_valid_mask(spark):
    row = E.voxel_metrics(dense(spark, [1, 1], [0, 0], [0, 1]), V, valid="valid").first()
    assert (row.fp, row.tn, row.fp_fraction) == (1, 0, 1)
    row = E.voxel_metrics(dense(spark, [1, 1], [0, 0], [0, 0]), V, valid="valid").first()
    assert (row.dice, row.accuracy, row.valid_voxels) == (1, 0, 0)


def corrected(spark, prediction, target, rounds, valid=None):
    out = E.neighbour_correction(dense(spark, prediction, target, valid), V, rounds, valid="valid")
    return [int(r.corrected) for r in out.orderBy("x").collect()]


def test_tolerance_fronts(spark):
    assert corrected(spark, [1, 0, 0], [1, 1, 1], 1) == [1, 1, 0]
    assert corrected(spark, [1, 0, 0], [1, 1, 1], 2) == [1, 1, 1]
    assert corrected(spark, [1, 1, 1], [1, 0, 0], 1) == [1, 0, 1]
    assert corrected(spark, [1, 1, 1], [1, 0, 0], 2) == [1, 0, 0]
    assert corrected(spark, [1, 0, 0], [1, 1, 1], 2, [1, 0, 1]) == [1, 0, 0]


CUBE = list(itertools.product(range(3), repeat=3))


@pytest.mark.parametrize(
    ("points", "expected"),
    [
        (CUBE, (1, 0, 0, 1)),
        ([p for p in CUBE if p != (1, 1, 1)], (1, 0, 1, 2)),
        ([(z, y, 0) for z in range(3) for y in range(3) if (z, y) != (1, 1)], (1, 1, 0, 0)),
        ([(0, 0, 0), (1, 1, 1)], (2, 0, 0, 2)),
    ],
)
def test_betti(spark, points, expected):
    groups = spark.createDataFrame([(0,)], "v int")
    row = G.topology(voxels(spark, points), groups, V).first()
    assert (row.betti0, row.betti1, row.betti2, row.euler) == expected


def test_betti26_and_empty(spark):
    groups = spark.createDataFrame([(0,), (1,)], "v int")
    rows = {r.v: r for r in G.topology(voxels(spark, [(0, 0, 0), (1, 1, 1)]), groups, V, 26).collect()}
    assert (rows[0].betti0, rows[0].betti1, rows[0].betti2, rows[0].euler) == (1, 0, 0, 1)
    assert (rows[1].betti0, rows[1].euler) == (0, 0)


def test_connectivity(spark):
    edge, corner = [(0, 0, 0), (0, 1, 1)], [(0, 0, 0), (1, 1, 1)]
    n = {(k, name): G.components(voxels(spark, p), V, k).select("component").distinct().count() for k in (6, 18, 26) for name, p in (("edge", edge), ("corner", corner))}
    assert n == {(6, "edge"): 2, (6, "corner"): 2, (18, "edge"): 1, (18, "corner"): 2, (26, "edge"): 1, (26, "corner"): 1}
    with pytest.raises(ValueError):
        G.offsets(7)


def test_split_and_merge(spark):
    whole, parts = [(0, 0, 0), (0, 0, 1), (0, 0, 2)], [(0, 0, 0), (0, 0, 2)]
    groups = spark.createDataFrame([(0,)], "v int")
    a, b = E.labelled(voxels(spark, whole), V), E.labelled(voxels(spark, parts), V)
    row = E.component_metrics(b, a, groups, V).first()
    assert (row.prediction_components, row.target_components, row.split_count, row.merge_count, row.matched_pair_count) == (2, 1, 1, 0, 2)
    assert row.matched_iou_mean == pytest.approx(1 / 3)
    row = E.component_metrics(a, b, groups, V).first()
    assert (row.component_count_difference, row.merge_count) == (-1, 1)


def test_cube_uses_grouping_not_nulls(spark):
    rows = spark.createDataFrame([("m", None, "a", 1.0), ("m", "s", "a", 3.0)], "method string, split string, domain string, dice double")
    out = {(r.split, r.domain): r.mean_dice for r in E.macro_cube(rows).collect()}
    assert out[("all", "all")] == 2.0 and out[("s", "all")] == 3.0 and out[(None, "a")] == 1.0


def test_composite_joins_by_faces_and_stays_within_the_valid_mask(spark):
    """Voxels that touch at a corner are two components by default; nothing outside the valid mask counts."""
    points = [(0, 0, 0), (1, 1, 1), (1, 1, 2), (3, 0, 0)]
    rows = [(0, z, y, x, (z, y, x) in points, (z, y, x) in points[:3], not (z == 3)) for z in range(4) for y in range(2) for x in range(3)]
    rows = spark.createDataFrame(rows, "v int, z int, y int, x int, prediction boolean, target boolean, valid boolean")
    whole, part = E.evaluate_masks(rows, V).first(), E.evaluate_masks(rows, V, valid="valid").first()
    assert (whole.raw_component_prediction_components, whole.raw_component_target_components, whole.raw_component_false_components) == (3, 2, 1)
    assert (whole.raw_topology_prediction_betti0, whole.raw_topology_betti_error) == (3, 1)
    assert (part.raw_component_prediction_components, part.raw_topology_betti_error, part.raw_valid_voxels, part.raw_fp) == (2, 0, 18, 0)
    loose = E.evaluate_masks(rows, V, connectivity=26).first()
    assert loose.raw_component_prediction_components == 2 and loose.raw_topology_prediction_betti0 == 2
    assert len(whole) == 82 and (whole.neighbor_correction_rounds, whole.neighbor_correction_connectivity, whole.neighbor_correction_uses_target_to_modify_prediction) == (2, 6, True)


def test_background_runs_are_the_complement(spark):
    points = [(z, y, x) for z in range(3) for y in range(3) for x in range(4) if (z * 5 + y * 3 + x * 7) % 4]
    rows = voxels(spark, points)
    runs = G.background_runs(G.runs_of(rows, V), V)
    listed = runs.select("v", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x")).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, G.complement(rows, V).select("v", "z", "y", "x").collect()))
