"""Registered queries: each applies operators to a whole derived volume table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import density
from ..functions.scalar import antialias_sigma, at_least, bce_with_logits, clipped, error_code, log_sum_exp, resampled_size, split_of
from ..operators import cases
from ..operators import cohort as K
from ..operators import constraints as C
from ..operators import distance, documents
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import intensity as I
from ..operators import labels as L
from ..operators import learning as N
from ..operators import raster as R
from ..operators import resample, ridge, synthesis
from ..sources import bundles, images, planes
from ..sources import volumes as S
from .fixtures import METHODS, f1, f1_values, f2, f2_contributions, f3, f4, f5, table

V, ZYX = ["volume_id"], ["z", "y", "x"]
KEYS = [*V, *ZYX]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# Intensities


@query
def normalize_percentile(spark, sf):
    return _rounded(I.percentile_normalise(f1_values(spark, sf), V, "v", single=False, by_range=True).select(*KEYS, "score"))


@query
def normalize_inference(spark, sf):
    out = I.percentile_normalise(f1_values(spark, sf), V, "v", single=False)
    return _rounded(out.select(*KEYS, F.col("score").cast("float").cast("double").alias("score")), 6)


@query
def minmax_rescale(spark, sf):
    return _rounded(I.minmax_rescale(f1_values(spark, sf), V, "v", 0.25, 0.75).select(*KEYS, "rescaled"))


@query
def intensity_summary(spark, sf):
    return _rounded(I.intensity_summary(f4(spark, sf), V))


@query
def threshold_mask(spark, sf):
    rows = f1(spark, sf)
    return rows.select(*KEYS, at_least("s", 0.55).alias("mask"))


@query
def multi_threshold_masks(spark, sf):
    rows = I.multi_threshold(f1(spark, sf), {"low": 0.4, "mid": 0.5, "high": 0.6}, "s")
    return rows.groupBy(*V, "label", "threshold").agg(F.count_if("mask").alias("n_positive"), F.avg(F.col("mask").cast("double")).alias("fraction")).transform(_rounded)


@query
def error_overlay_counts(spark, sf):
    return I.error_histogram(f1(spark, sf), V, error_code("prediction", "target"))


@query
def mid_slice_planes(spark, sf):
    rows = f1(spark, sf).withColumns({"ny": F.lit(8), "nx": F.lit(8)})
    out = I.mid_slices(rows, {"z": "nz", "y": "ny", "x": "nx"})
    return _rounded(out.select(*V, "axis", "row", "column", "s"))


@query
def slice_overlay_rgb(spark, sf):
    rows = f1(spark, sf).where(F.col("z") == F.floor(F.col("nz") / 2)).withColumn("code", error_code("prediction", "target"))
    return I.overlay_rgb(rows, V, "s").select(*KEYS, "r", "g", "b")


@query
def gaussian_smooth(spark, sf):
    return _rounded(I.gaussian_smooth(f1(spark, sf), V, "z", 1.0, "nz", "s"), 8)


@query
def trilinear_resample(spark, sf):
    rows = f1(spark, sf)
    return _rounded(I.trilinear_resample(rows, V, {"z": "nz", "y": 8, "x": 8}, {"z": 1.0, "y": 0.5, "x": 0.5}, 0.8, "s"), 8)


@query
def resample_plan(spark, sf):
    volumes = f1(spark, sf).groupBy(*V).agg(F.max("nz").alias("nz")).withColumn("spacing", 0.25 + F.col("volume_id") * 0.15)
    return _rounded(volumes.select(*V, resampled_size("nz", "spacing", 0.8).alias("new_nz"), antialias_sigma("spacing", 0.8).alias("sigma")))


@query
def tile_blend(spark, sf):
    """Every tile says of a voxel its value less the tile's mean."""
    tiles = I.tiles_of(f1(spark, sf), {"z": "nz", "y": 8, "x": 8}, 8, 0.5)
    own = [*V, "tz", "ty", "tx"]
    mean = tiles.groupBy(*own).agg(F.avg("s").alias("mean"))
    return _rounded(I.blend_tiles(tiles.join(mean, own), V, 8, F.col("s") - F.col("mean")), 8)


@query
def percentiles_by_range(spark, sf):
    out = I.percentiles_by_range(f1_values(spark, sf), V, "v", (0.005, 0.5, 0.995))
    return _rounded(out.select(*V, F.col("p")[0].alias("p0_5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p99_5")))


@query
def ridge_score(spark, sf):
    return _rounded(ridge.ridge_score(f1(spark, sf), V, "s", (1.0, 2.0)), 5)


@query
def ridge_masks(spark, sf):
    """Each volume by the scales of its domain."""
    domain = F.when(F.col("volume_id") < 5, "human").otherwise("macaque")
    return _rounded(ridge.ridge_masks(f1(spark, sf), V, "s", domain).select(*KEYS, "domain", "ridge", "mask"), 5)


# Evaluation


@query
def confusion_counts(spark, sf):
    return E.confusion_counts(f1(spark, sf), V)


@query
def voxel_metrics(spark, sf):
    return _rounded(E.voxel_metrics(f1(spark, sf), V))


@query
def voxel_metrics_valid_mask(spark, sf):
    return _rounded(E.voxel_metrics(f1(spark, sf).withColumn("valid", F.col("h") % 3 != 0), V, valid="valid"))


@query
def sparse_mask_metrics(spark, sf):
    rows = f1(spark, sf)
    volumes = rows.groupBy(*V).agg(F.max("nz").alias("nz")).withColumns({"ny": F.lit(8), "nx": F.lit(8)})
    return _rounded(E.sparse_metrics(rows.where("prediction"), rows.where("target"), volumes, V))


def _case_metrics(spark, sf):
    return E.voxel_metrics(f3(spark, sf), ["method", "domain", "split", *V])


@query
def macro_metrics_cube(spark, sf):
    return _rounded(E.macro_cube(_case_metrics(spark, sf).drop(*V)))


@query
def heldout_summary(spark, sf):
    return _rounded(E.heldout_summary(_case_metrics(spark, sf)))


def _changed(spark, sf, rounds):
    out = E.neighbour_correction(f1(spark, sf), V, rounds)
    return out.where("changed_in is not null").select(*KEYS, "changed_in", "corrected")


@query
def neighbor_correction_round1(spark, sf):
    return _changed(spark, sf, 1)


@query
def neighbor_correction_round2(spark, sf):
    return _changed(spark, sf, 2)


@query
def correction_counts(spark, sf):
    return E.correction_counts(E.neighbour_correction(f1(spark, sf), V, 2), V)


@query
def corrected_metrics(spark, sf):
    return _rounded(E.voxel_metrics(E.neighbour_correction(f1(spark, sf), V, 2), V, "corrected"))


@query
def neighbor_stencil(spark, sf):
    rows = f1(spark, sf)
    return G.touching(rows.where("target and not prediction"), rows.where("target and prediction"), V).groupBy(*V).agg(F.count("*").alias("n_touching"))


@query
def depth_slab_metrics(spark, sf):
    return _rounded(E.depth_slab_metrics(f1(spark, sf), V))


@query
def depth_slab_corrected(spark, sf):
    return _rounded(E.depth_slab_metrics(f1(spark, sf), V, rounds=1))


@query
def depth_trends(spark, sf):
    return _rounded(E.depth_trends(E.depth_slab_metrics(f3(spark, sf), ["method", *V]), ["method", *V]), 8)


@query
def euler_cells(spark, sf):
    return G.euler_cells(f1(spark, sf).where("prediction"), V)


@query
def bbox_crop(spark, sf):
    rows = f1(spark, sf)
    box = G.bounding_box(rows.where("s >= 0.9"), V)
    inside = rows.join(box, V).where("z between z0 and z1 and y between y0 and y1 and x between x0 and x1")
    return inside.groupBy(*V, "z0", "z1", "y0", "y1", "x0", "x1").agg(F.count("*").alias("n_inside"))


def _components(spark, sf, connectivity):
    found = G.components(f1(spark, sf).where("prediction"), V, connectivity)
    return found.select(*KEYS, F.col("component.z").alias("cz"), F.col("component.y").alias("cy"), F.col("component.x0").alias("cx"))


@query
def components6(spark, sf):
    return _components(spark, sf, 6)


@query
def components18(spark, sf):
    return _components(spark, sf, 18)


@query
def components26(spark, sf):
    return _components(spark, sf, 26)


def _both_labelled(spark, sf):
    """Distinct volumes and both masks' labelled voxels; the masks are read once and labelled in one go."""
    runs = E.labelled_sides(E.masked_sides(f1(spark, sf), V), V, 6)
    return f1_values(spark, sf), E.side_of(runs, V, "prediction"), E.side_of(runs, V, "target")


@query
def component_overlap(spark, sf):
    _, p, t = _both_labelled(spark, sf)
    found = E.component_overlap(p, t, V)
    names = [F.col(f"{side}_component.{a}").alias(f"{side[0]}{a[0]}") for side in ("prediction", "target") for a in ("z", "y", "x0")]
    return found.select(*V, *names, "overlap")


@query
def component_metrics(spark, sf):
    rows, p, t = _both_labelled(spark, sf)
    return _rounded(E.component_metrics(p, t, rows, V))


@query
def topology_betti(spark, sf):
    return G.topology(f1(spark, sf).where("prediction"), f1_values(spark, sf), V, 6)


@query
def topology_comparison(spark, sf):
    sides = E.masked_sides(f1(spark, sf), V)
    both = f1_values(spark, sf).select(*V).distinct().select(*V, F.explode(F.array(F.lit("prediction"), F.lit("target"))).alias("side"))
    found = G.saved(G.topology(sides, both, [*V, "side"], 6), "topology")
    return G.topology_comparison(found.where("side = 'prediction'"), found.where("side = 'target'"), V)


@query
def topology_betti26(spark, sf):
    return G.topology(f1(spark, sf).where("prediction"), f1_values(spark, sf), V, 26)


@query
def evaluate_masks(spark, sf):
    return _rounded(E.evaluate_masks(f1(spark, sf), V, 2))


@query
def evaluate_masks_valid(spark, sf):
    rows = f1(spark, sf).withColumn("valid", F.col("h") % 3 != 0)
    return _rounded(E.evaluate_masks(rows, V, 2, valid="valid"))


CASE = ["method", "domain", "split", *V]


def _case_rows(spark, sf):
    return E.evaluate_masks(f3(spark, sf), CASE, 2)


@query
def case_macro_cube(spark, sf):
    """The means of all 80 real-valued columns of the case rows."""
    return _rounded(E.macro_cube(_case_rows(spark, sf).drop(*V)), 8)


@query
def depth_rows(spark, sf):
    return _rounded(E.depth_rows(f3(spark, sf), CASE, rounds=2))


@query
def depth_trend_rows(spark, sf):
    rows = E.depth_rows(f3(spark, sf), CASE, rounds=2)
    return _rounded(E.depth_trends(rows, CASE, prefixes=("raw_", f"{E.CORRECTED}_"), depth="depth_fraction_midpoint"), 8)


# Labels


@query
def shell_interior(spark, sf):
    return L.shell_interior(f2(spark, sf).withColumn("label", F.col("label") % 5), V, prob="prob").select(*KEYS, "label", "class")


@query
def class_totals(spark, sf):
    return L.class_totals(L.shell_interior(f2(spark, sf).withColumn("label", F.col("label") % 5), V, prob="prob"), V)


def _field():
    return density.linear("z", F.lit(32), 0.2, 0.8)


@query
def label_field_mean(spark, sf):
    return _rounded(L.label_field_mean(f2(spark, sf), V, _field()))


@query
def subset_fixed_fraction(spark, sf):
    return L.subset_fixed_fraction(f2(spark, sf), V, 0.3, 7).where("label > 0").groupBy(*V, "label").agg(F.count("*").alias("n_voxels"))


@query
def subset_bernoulli(spark, sf):
    return L.subset_bernoulli(f2(spark, sf), V, _field(), 3).where("label > 0").groupBy(*V, "label").agg(F.count("*").alias("n_voxels"))


@query
def subset_info(spark, sf):
    rows = f2(spark, sf)
    return _rounded(L.subset_info(rows, L.subset_bernoulli(rows, V, _field(), 3), V))


@query
def collapse_labels(spark, sf):
    return L.collapse_labels(f2(spark, sf), 8, 5).groupBy(*V, "group").agg(F.count("*").alias("n_voxels"), F.countDistinct("label").alias("n_labels"))


@query
def level_lookup(spark, sf):
    levels = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("label"), F.col("s_nationkey").cast("int").alias("level"))
    return L.mapped(f2(spark, sf), levels, "label", "level", F.lit(-1)).groupBy(*V, "level").agg(F.count("*").alias("n_voxels"))


@query
def intensity_classes(spark, sf):
    rows = L.intensity_classes(f2(spark, sf), V, 5, 11)
    out = rows.withColumn("blend", L.blended(rows, F.col("intensity"), F.lit(0.1)))
    return _rounded(out.groupBy(*V, "class").agg(F.count("*").alias("n_voxels"), F.max("intensity").alias("intensity"), F.avg("blend").alias("mean_blend")))


@query
def foreground_redraw(spark, sf):
    return L.redraw(f2(spark, sf), V, 6, 700, 13, 0.15)


@query
def grow_labels(spark, sf):
    return L.grow_labels(f2(spark, sf), V, 0.5 + (F.col("label") % 3), 2).groupBy(*V, "label").agg(F.count("*").alias("n_voxels"))


@query
def hollow_labels(spark, sf):
    rows = f2(spark, sf).withColumn("label", F.when(F.col("prob") > 0.05, 1).otherwise(0))
    out = L.hollow_labels(rows, V, 1, F.lit(True))
    return out.groupBy(*V, "label").agg(F.count("*").alias("n_voxels"))


@query
def random_smooth_field(spark, sf):
    return _rounded(L.random_field(f1(spark, sf), F.col("volume_id"), 4, {"z": "nz", "y": 8, "x": 8}, 17).select(*KEYS, "field"))


@query
def flip_and_reorder(spark, sf):
    rows = L.reordered(L.flipped(f1(spark, sf), "z", "nz"), [1, 2, 0])
    return _rounded(rows.select(*KEYS, "s"))


def _lumps(spark, sf):
    """The instance volumes with labels that are blocks of 8 voxels a side, with holes where the probability is low; and their boxes."""
    block = 1 + F.floor(F.col("z") / 8) * 4 + F.floor(F.col("y") / 8) * 2 + F.floor(F.col("x") / 8)
    rows = f2(spark, sf).select(*KEYS, F.when(F.col("prob") > 0.05, block).otherwise(0).cast("int").alias("label"))
    sizes = rows.select(*V).distinct().withColumns({"nz": F.lit(32), "ny": F.lit(16), "nx": F.lit(16)})
    return rows, distance.boxes_of(sizes, V, {"z": "nz", "y": "ny", "x": "nx"})


@query
def label_distances(spark, sf):
    rows, boxes = _lumps(spark, sf)
    return distance.distances(rows.where("label > 0"), boxes, V, bound=3).groupBy(*V, "label", "d").agg(F.count("*").alias("n_voxels"), F.sum(F.col("z") * 10_000 + F.col("y") * 100 + F.col("x")).alias("places"))


@query
def label_depths(spark, sf):
    rows, boxes = _lumps(spark, sf)
    return distance.depths(rows.where("label > 0"), boxes, V).select(*KEYS, "label", "depth")


@query
def nearest_labels(spark, sf):
    """Every voxel's nearest label, however far."""
    rows, boxes = _lumps(spark, sf)
    return distance.distances(rows.where("label > 0 and z % 8 = 3 and y % 8 < 2"), boxes, V, each=False).select(*KEYS, "label", "d")


@query
def morphed_labels(spark, sf):
    rows, boxes = _lumps(spark, sf)
    radius = distance.smooth_radius(V, -4.0, 4.0, 4, {"z": 32, "y": 16, "x": 16}, 31, 0.7)
    return distance.morph_labels(rows, boxes, V, radius, -4.0, 4.0).select(*KEYS, "label")


@query
def hollow_and_refill(spark, sf):
    rows, boxes = _lumps(spark, sf)
    width = F.lit(1.25) + F.col("z") / 32.0
    return distance.hollow_and_refill(rows, boxes, V, lambda r: r.withColumn("width", width), F.col("label") % 3 != 0).select(*KEYS, "label")


def _dense_lumps(spark, sf):
    rows, _ = _lumps(spark, sf)
    sizes = rows.select(*V).distinct().withColumns({"nz": F.lit(32), "ny": F.lit(16), "nx": F.lit(16)})
    probs = f2(spark, sf).select(*KEYS, "prob")
    return R.dense(sizes, rows.join(probs, KEYS), V, {"label": 0, "prob": 0.0}).select(*KEYS, "label", "prob")


@query
def synthetic_images(spark, sf):
    """Images of the label volumes; the mean of each plane, as well as its extremes."""
    out = synthesis.synthesised(_dense_lumps(spark, sf), V, {"z": 32, "y": 16, "x": 16}, 7, shape=4)
    return _rounded(out.groupBy(*V, "z").agg(F.avg("image").alias("mean"), F.min("image").alias("low"), F.max("image").alias("high"), F.max("group").alias("groups")), 6)


@query
def hashed_draws(spark, sf):
    """Normal and gamma draws of every voxel of the instance volumes."""
    rows = f2(spark, sf).select(*KEYS)
    return _rounded(rows.select(*KEYS, synthesis.normal(5, "n", *KEYS).alias("normal"), synthesis.gamma(5, "g", 3, *KEYS).alias("gamma")), 8)


@query
def retried_subsets(spark, sf):
    """Subsets of labels, drawn again (10 times at most) until a volume keeps one of the first two of its blocks."""
    rows, _ = _lumps(spark, sf)
    rows = rows.where("label > 0")

    def step(left, attempt):
        return left.withColumn("label", F.when(synthesis.uniform(3, f"keep{attempt}", *V, "label") < 0.12, F.col("label")).otherwise(0))

    out, table = synthesis.first_that_holds(rows, V, step, lambda r: r.where("label between 1 and 2"))
    n = out.groupBy(*V).agg(F.count_if(F.col("label") > 0).alias("n_voxels"))
    return table.join(n, V)


def _density(field):
    def run(spark, sf):
        return _rounded(f1(spark, sf).select(*KEYS, field().alias("density")))

    return run


QUERIES["density_linear"] = _density(lambda: density.linear("z", F.col("nz"), 0.2, 0.8, False))
QUERIES["density_sigmoid"] = _density(lambda: density.sigmoid("z", F.col("nz"), 0.1, 0.9, 0.4, 12.0))
QUERIES["density_gaussian"] = _density(lambda: density.gaussian("z", F.col("nz"), 0.1, 0.9, 0.5, 0.25))
QUERIES["density_radial"] = _density(lambda: density.radial(ZYX, [F.col("nz"), F.lit(8), F.lit(8)], 0.1, 0.9, (0.5, 0.4, 0.6)))
QUERIES["density_uniform"] = _density(lambda: density.uniform(0.35))


@query
def random_density(spark, sf):
    rows = f1(spark, sf).withColumn("choice", density.random_choice(F.col("volume_id").cast("long"), 23))
    sizes = [F.col("nz"), F.lit(8), F.lit(8)]
    return _rounded(rows.select(*KEYS, F.col("choice.kind").alias("kind"), density.chosen("choice", ZYX, sizes).alias("density")), 8)


# Curves


@query
def raster_scatter(spark, sf):
    return _rounded(R.scatter(f2_contributions(spark, sf), V, F.col("distance"), F.col("p"), F.col("id")))


@query
def tessellate(spark, sf):
    return _rounded(R.tessellate(f5(spark, sf), "curve_id", "ord", "radius", 1.5))


@query
def tessellate_arcs(spark, sf):
    return _rounded(R.tessellate_arcs(f5(spark, sf), "curve_id", "ord", "radius", 4.0), 7)


@query
def arc_point_counts(spark, sf):
    """Points of each curve, and how evenly they lie along it."""
    points = R.arc_points(f5(spark, sf), "curve_id", "ord", "radius", 2.5)
    return _rounded(points.groupBy("curve_id").agg(F.count("*").alias("n_points"), F.avg("radius").alias("radius")))


@query
def rasterize(spark, sf):
    segments = R.tessellate(f5(spark, sf), "curve_id", "ord", "radius", 6.0)
    return _rounded(R.rasterise(segments, (32, 32, 32), "curve_id"), 7)


# Model outputs


def _logits(spark, sf):
    s, h = F.col("s"), F.col("h")
    rows = f1(spark, sf).withColumn("logits", F.array(2 - 4 * s, 4 * s - 2 + (h - 50) / 50.0, 6 * s - 4.0))
    return rows.withColumn("class_target", F.when(~F.col("target"), 0).when(h % 2 == 0, 1).otherwise(2))


@query
def logit_sigmoid(spark, sf):
    rows = N.binary_output(f1(spark, sf), 4 * F.col("s") - 2)
    return _rounded(rows.select(*KEYS, "probability", "mask"))


@query
def logit_softmax_post(spark, sf):
    return _rounded(N.class_output(_logits(spark, sf)).select(*KEYS, "probability", "mask", "class", "shell", "interior"))


@query
def hierarchical_logits(spark, sf):
    x = F.col("logits")
    rows = _logits(spark, sf).select(*KEYS, (log_sum_exp(x[1], x[2]) - x[0]).alias("foreground"), (x[2] - x[1]).alias("core"), F.when(F.col("target"), 1.0).otherwise(0.0).alias("t"))
    return _rounded(rows.select(*KEYS, "foreground", "core", bce_with_logits("foreground", "t").alias("bce")))


@query
def selection_score(spark, sf):
    rows = N.class_output(_logits(spark, sf)).withColumnRenamed("class", "predicted")
    return _rounded(N.selection_score(rows, V, target="class_target"))


@query
def nested_loss(spark, sf):
    return _rounded(N.nested_loss(_logits(spark, sf), V, target="class_target", w_core=0.5), 8)


def _epochs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 7).alias("run"), F.col("o_orderkey").alias("epoch"), F.round((F.col("o_orderkey") * 7919 % 1009) / 1009.0, 9).alias("score"))


@query
def running_best(spark, sf):
    return N.running_best(_epochs(spark, sf), ["run"], "epoch", "score")


@query
def resume_pick(spark, sf):
    rows = _epochs(spark, sf).withColumn("complete", F.col("epoch") % 3 == 0).withColumn("path", F.concat(F.lit("epoch_"), F.col("epoch").cast("string")))
    return N.resume_pick(rows, ["run"], "epoch", "complete", "path")


@query
def argument_differences(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    def args(shift):
        return F.create_map(F.lit("lr"), (F.col("o_orderkey") + shift) % 3, F.lit("batch"), (F.col("o_orderkey") + shift * 2) % 4, F.lit("seed"), F.col("o_orderkey") + shift)
    return o.select("o_orderkey", F.array_join(N.argument_differences(args(0), args(1), ["seed"]), ",").alias("changed")).distinct()


# Splits and checks


@query
def split_by_id(spark, sf):
    v = table(spark, sf, "part").select((F.col("p_partkey") % 600).cast("int").alias("volume")).distinct()
    return v.select("volume", split_of("volume").alias("split"))


@query
def split_prefix(spark, sf):
    names = table(spark, sf, "supplier").select(F.format_string("%05d_label", F.col("s_suppkey")).alias("name"))
    return L.prefix_split(names, "name", 0.2).select("name", F.col("position").cast("long").alias("position"), "split")


def _cases(spark, sf):
    volumes = f1_values(spark, sf).select("volume_id").distinct()
    methods = spark.createDataFrame([(m,) for m, _, _ in METHODS], "method string")
    return volumes.crossJoin(F.broadcast(methods))  # two small dimensions


@query
def missing_extra_pairs(spark, sf):
    actual = f3(spark, sf).where("not (method = 'm1' and volume_id = 3)").select("method", "volume_id").distinct()
    actual = actual.withColumn("method", F.when((F.col("method") == "m2") & (F.col("volume_id") == 4), "m9").otherwise(F.col("method")))
    return C.missing_extra(_cases(spark, sf), actual, ["method", "volume_id"])


@query
def mask_agreement(spark, sf):
    rows = f3(spark, sf).withColumn("score", F.col("score").cast("float"))
    rows = rows.withColumn("saved", F.when(F.col("h") == 100, ~at_least("score", F.col("threshold"))).otherwise(at_least("score", F.col("threshold"))))
    return C.mask_agreement(rows, ["method", *V], "saved", "score", F.col("threshold"))


@query
def score_range(spark, sf):
    return C.score_range(f3(spark, sf), ["method", *V])


@query
def not_binary(spark, sf):
    return C.not_binary(f1(spark, sf).withColumn("mask", F.when(F.col("h") == 7, 2).otherwise(F.col("prediction").cast("int"))), V, "mask")


@query
def unpaired_voxels(spark, sf):
    rows = f1(spark, sf)
    return C.unpaired(rows.where("h <> 3"), rows.where("h <> 5"), V)


@query
def repeated_keys(spark, sf):
    return C.repeated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def wrong_counts(spark, sf):
    return C.wrong_counts(table(spark, sf, "lineitem"), ["l_orderkey"], 4)


@query
def settings_differ(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 5).alias("roi"), (F.col("o_custkey") % 3).alias("mode")).distinct()
    recorded = o.withColumn("roi", F.when(F.col("job") % 50 == 0, None).otherwise(F.col("roi"))).withColumn("mode", F.when(F.col("job") % 70 == 0, -1).otherwise(F.col("mode")))
    return C.settings_differ(recorded, o, ["job"], ["roi", "mode"])


@query
def outdated_jobs(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 5).alias("setting")).distinct()
    records = jobs.where("job % 10 <> 0").withColumn("setting", F.when(F.col("job") % 25 == 0, 9).otherwise(F.col("setting")))
    return C.outdated(jobs, records, ["job"], ["setting"])


@query
def affine_check(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("a"))
    b = F.transform("a", lambda v, i: F.when((i == 3) & (F.col("vec_id") % 4 == 0), v.cast("double") + 0.001).otherwise(v.cast("double")))
    return e.select("vec_id", C.affine_differs(F.transform("a", lambda v: v.cast("double")), b).alias("differs"))


# Files and jobs


def _files(spark, sf):
    s = F.col("s_suppkey")
    label, prob = (F.format_string(f"data/%05d_{kind}.nii.gz", s) for kind in ("label", "prob"))
    found = F.array_compact(F.array(F.when(s % 11 != 3, label), F.when(s % 13 != 5, prob), F.format_string("data/%05d_meta.txt", s)))
    return table(spark, sf, "supplier").select(F.explode(found).alias("path"))


@query
def paired_files(spark, sf):
    return K.paired_files(_files(spark, sf))


@query
def first_files(spark, sf):
    return K.first_by_name(_files(spark, sf).where("path like '%_label.nii.gz'"), "path", 20)


@query
def numbered_jobs(spark, sf):
    return K.numbered_jobs(_cases(spark, sf), ["method", "volume_id"])


@query
def job_at(spark, sf):
    return K.job_at(_cases(spark, sf), ["method", "volume_id"], 17)


@query
def generation_plan(spark, sf):
    return _rounded(K.generation_plan(table(spark, sf, "part").select("p_partkey"), "p_partkey", (128, 128, 128), 0.001), 8)


@query
def merged_rows(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("level"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("score"))
    return K.merged_rows(a, b)


@query
def nifti_round_trip(spark, sf):
    """The scores as NIfTI files, one per volume, and the voxels that these files give back."""
    rows = f1(spark, sf).withColumn("volume_id", F.col("volume_id").cast("string"))
    affine = F.array(*[F.lit(float(v)) for v in (0.5, 0, 0, 1, 0, 0.5, 0, 2, 0, 0, 0.5, 3, 0, 0, 0, 1)])
    sizes = rows.groupBy("volume_id").agg(F.max("nz").alias("nz")).withColumns({"ny": F.lit(8), "nx": F.lit(8), "affine": affine})
    files = S.to_nifti(rows.select(*KEYS, "s"), sizes, "s")
    found = S.voxels_in(files.select(F.concat("volume_id", F.lit(".nii.gz")).alias("path"), "content", F.lit(None).cast("string").alias("sidecar")))
    return _rounded(found.select(*KEYS, F.col("value").cast("double").alias("value")), 6)


def _cohort_files(spark, sf):
    """The cohort of f3 as files in a shared folder: a target per volume, score, mask and metadata per case; the cases, and the folder."""
    rows = f3(spark, sf).withColumn("case", F.concat_ws("_", "method", "volume_id")).withColumn("score", clipped("score", 0.0, 1.0).cast("float"))
    rows = G.saved(rows.select("case", "method", "volume_id", "nz", *ZYX, "threshold", "target", "score"), "cohort")
    affine = F.array(*[F.lit(float(v)) for v in (0.5, 0, 0, 1, 0, 0.5, 0, 2, 0, 0, 0.5, 3, 0, 0, 0, 1)])
    sizes = rows.groupBy("case", "method", "volume_id", "threshold").agg(F.max("nz").alias("nz")).withColumns({"ny": F.lit(8), "nx": F.lit(8), "affine": affine})
    named = rows.drop("volume_id").withColumnRenamed("case", "volume_id")
    heads = sizes.drop("volume_id").withColumnRenamed("case", "volume_id")
    masks = named.select(*KEYS, at_least("score", F.col("threshold")).cast("int").alias("value"))
    path = G.shared_path(spark, "cohort_files")
    files = bundles.case_files(named.select(*KEYS, F.col("score").alias("value")), masks, heads, heads.select("volume_id", "method", "threshold"), path, planes=3)
    targets = rows.where("method = 'm0'").select("volume_id", *ZYX, F.col("target").cast("int").alias("value"))
    parts = bundles.volume_parts(targets, sizes.where("method = 'm0'"), "value", "u1", planes=3)
    files = files.unionByName(parts.select(F.concat(F.lit("target/"), F.col("volume_id").cast("string"), F.lit(".nii.gz")).alias("file"), "part", "content"))
    bundles.write_files(files, path)
    own = {r: F.concat(F.lit(f"{path}/"), F.col("case"), F.lit(f"_{r}.nii.gz")).alias(f"{r}_path") for r in ("score", "mask")}
    target = F.concat(F.lit(f"{path}/target/"), F.col("volume_id").cast("string"), F.lit(".nii.gz")).alias("target_path")
    return sizes.select("case", "threshold", target, *own.values()), path


@query
def cases_from_files(spark, sf):
    """Metrics of all cases after their files were written, published, read and checked."""
    found, path = _cohort_files(spark, sf)
    return _rounded(E.voxel_metrics(cases.load_cases(spark, found, path), ["case"]))


@query
def scanned_planes(spark, sf):
    """Two planes of each target, read from the files by their place."""
    found, path = _cohort_files(spark, sf)
    rows = planes.scan_voxels(spark, f"{path}/target", within={"z": (20, 21)})
    return rows.groupBy("volume_id", "z").agg(F.count("*").alias("n_voxels"), F.sum(F.col("value").cast("long")).alias("n_target"))


def _proxies(spark, sf):
    """The score volumes as sources of different spacing, and their headers."""
    rows = f1(spark, sf).select(*KEYS, F.col("s").alias("value"), "nz")
    zooms = [F.lit(0.35) + F.col("volume_id") * 0.07, F.lit(0.9) - F.col("volume_id") * 0.05, F.lit(0.5)]
    turned = [0.0, zooms[1], 0.0, 4.0, -zooms[0], 0.0, 0.0, 5.0, 0.0, 0.0, zooms[2], 6.0, 0.0, 0.0, 0.0, 1.0]
    affine = F.array(*[v if not isinstance(v, float) else F.lit(v) for v in turned])
    heads = rows.groupBy(*V).agg(F.max("nz").alias("nz")).withColumns({"ny": F.lit(8), "nx": F.lit(8), "zooms": F.array(*zooms), "affine": affine, "unit": F.lit(3)})
    return rows.drop("nz"), heads


@query
def prepared_volumes(spark, sf):
    """Axes permuted, smoothed against aliasing, resampled to 0.8: each volume by its own spacing."""
    voxels, _ = resample.prepare_volumes(*_proxies(spark, sf), (2, 0, 1), 0.8)
    return _rounded(voxels.select(*KEYS, "value"), 8)


@query
def prepared_headers(spark, sf):
    """Headers of the prepared volumes, written to files with their voxels and read from those."""
    voxels, heads = resample.prepare_volumes(*_proxies(spark, sf), (2, 0, 1), 0.8)
    named = F.concat(F.lit("volume"), F.col("volume_id").cast("string"))
    path = G.shared_path(spark, "prepared")
    bundles.write_prepared(G.saved(voxels.withColumn("volume_id", named), "prepared_voxels"), heads.withColumn("volume_id", named), path)
    found = planes.scan_headers(spark, path)
    affine = [F.round(F.col("affine")[i], 4).alias(f"a{i}") for i in range(12)]
    return found.select("volume_id", "nz", "ny", "nx", "dtype", "unit", "qform", "sform", *affine)


def _records(spark, sf):
    """A nested record of each event, as it is and as it should be."""
    e = table(spark, sf, "events")
    odd, kind = F.col("event_id") % 7 == 0, F.col("event_type")
    more = F.struct(F.parse_json("props").alias("props"), F.array(F.col("user_id") % 3, F.lit(2)).alias("sizes"))
    recorded = F.to_json(F.struct(kind.alias("type"), more.alias("more"), F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"})
    changed = F.struct(F.parse_json(F.when(odd, "{}").otherwise(F.col("props"))).alias("props"), F.array(F.col("user_id") % 3, F.when(F.col("event_id") % 5 == 0, 2.5).otherwise(2.0)).alias("sizes"))
    expected = F.to_json(F.struct(kind.alias("type"), changed.alias("more"), F.when(F.col("event_id") % 11 == 0, "x").alias("note"), F.when(odd, 1).alias("added")), {"ignoreNullFields": "false"})
    return e.select("event_id", recorded.alias("document")), e.select("event_id", expected.alias("document"))


@query
def record_paths(spark, sf):
    return documents.tree_paths(_records(spark, sf)[1], ["event_id"], "document")


@query
def record_differences(spark, sf):
    return documents.tree_differences(*_records(spark, sf), ["event_id"], "document", ignored=["$.added"])


@query
def record_columns(spark, sf):
    return documents.flattened(_records(spark, sf)[0], ["event_id"], "document")


@query
def prediction_paths(spark, sf):
    """The paths of every case's score and mask by their templates, and how often each stands."""
    rows = f3(spark, sf).select("method", "domain", "split", F.concat(F.lit("p"), F.col("volume_id").cast("string")).alias("patch_id")).distinct()
    each = [K.templated_path(f"{{split}}/{{domain}}/{{method}}/{{patch_id}}_{kind}.nii.gz", "/data/out").alias("path") for kind in ("score", "mask")]
    paths = rows.select("method", "patch_id", each[0]).union(rows.select("method", "patch_id", each[1]))
    return paths.groupBy("method", "patch_id", "path").agg(F.count("*").alias("n"))


@query
def overlay_images(spark, sf):
    """The middle planes with their errors marked as PNG files, one a volume, and the pixels that these files give back."""
    rows = f1(spark, sf).where(F.col("z") == F.floor(F.col("nz") / 2)).withColumn("code", error_code("prediction", "target"))
    pixels = I.overlay_rgb(rows, V, "s").select(*V, F.col("y").alias("row"), F.col("x").alias("column"), "r", "g", "b")
    path = G.shared_path(spark, "overlays")
    bundles.write_files(images.image_files(pixels, F.concat(F.col("volume_id").cast("string"), F.lit(".png"))), path)
    found = images.read_images(spark.read.format("binaryFile").load(path))
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int").alias("volume_id"), "row", "column", "r", "g", "b")
