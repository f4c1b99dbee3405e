"""Mask evaluation: voxel metrics, tolerance by neighbours, components, depth slabs and cohort summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide, slab_of
from .grid import AXES, components, merged, run_components, runs_of, saved, shifted, topology_comparison, voxels_of
from .grid import topology as topology_of

#: Fixed value: prefix of the metrics of a mask corrected with knowledge of the target.
CORRECTED = "target_informed_neighbor_corrected"
COUNTS = ["valid_voxels", "prediction_positive_voxels", "target_positive_voxels", "tp", "fp", "fn", "tn"]


def metric_columns(prefix: str = "") -> dict[str, Column]:
    """The 21 metrics of a row with tp, fp, fn and tn. Overlap of two empty masks is 1; other ratios over nothing are 0."""
    tp, fp, fn, tn = (F.col(c).cast("long") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    out = {
        "valid_voxels": n,
        "prediction_positive_voxels": tp + fp,
        "target_positive_voxels": tp + fn,
        "tp": tp,
        "fp": fp,
        "fn": fn,
        "tn": tn,
        "dice": F.when(2 * tp + fp + fn == 0, F.lit(1.0)).otherwise(2 * tp / (2 * tp + fp + fn)),
        "iou": F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(tp / (tp + fp + fn)),
        "precision": safe_divide(tp, tp + fp),
        "recall": safe_divide(tp, tp + fn),
        "specificity": safe_divide(tn, tn + fp),
        "accuracy": safe_divide(tp + tn, n),
        "fdr": safe_divide(fp, tp + fp),
        "fpr": safe_divide(fp, fp + tn),
        "tp_fraction": safe_divide(tp, n),
        "fp_fraction": safe_divide(fp, n),
        "fn_fraction": safe_divide(fn, n),
        "tn_fraction": safe_divide(tn, n),
        "prediction_foreground_fraction": safe_divide(tp + fp, n),
        "target_foreground_fraction": safe_divide(tp + fn, n),
    }
    return {prefix + k: v for k, v in out.items()}


def confusion_counts(rows: DataFrame, by: Sequence[str], prediction: str = "prediction", target: str = "target", valid: str | None = None) -> DataFrame:
    """by, tp, fp, fn, tn of a dense table with two boolean masks; rows whose ``valid`` is not true don't count, but keep their group."""
    p, t = F.coalesce(F.col(prediction), F.lit(False)), F.coalesce(F.col(target), F.lit(False))
    v = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count_if(v & p & t).alias("tp"), F.count_if(v & p & ~t).alias("fp"), F.count_if(v & ~p & t).alias("fn"), F.count_if(v & ~p & ~t).alias("tn")
    )


def voxel_metrics(rows: DataFrame, by: Sequence[str], prediction: str = "prediction", target: str = "target", valid: str | None = None, prefix: str = "") -> DataFrame:
    """by and the 21 metrics, one partial aggregation over the voxels."""
    counts = confusion_counts(rows, by, prediction, target, valid)
    return counts.select(*by, *[v.alias(k) for k, v in metric_columns(prefix).items()])


def joined_masks(prediction: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sparse masks side by side: by, z, y, x, prediction, target (absent: false)."""
    keys = [*by, *AXES]
    p = prediction.select(*keys).distinct().withColumn("prediction", F.lit(True))
    t = target.select(*keys).distinct().withColumn("target", F.lit(True))
    return p.join(t, keys, "full").fillna(False, ["prediction", "target"])


def sparse_metrics(prediction: DataFrame, target: DataFrame, volumes: DataFrame, by: Sequence[str], prefix: str = "") -> DataFrame:
    """Metrics of sparse masks: true negatives come from the sizes (nz, ny, nx) in ``volumes``, which also adds empty groups."""
    counts = confusion_counts(joined_masks(prediction, target, by), by).drop("tn")
    size = F.col("nz").cast("long") * F.col("ny") * F.col("nx")
    rows = volumes.select(*by, size.alias("size")).join(counts, list(by), "left").fillna(0, ["tp", "fp", "fn"])
    rows = rows.withColumn("tn", F.col("size") - F.col("tp") - F.col("fp") - F.col("fn"))
    return rows.select(*by, *[v.alias(k) for k, v in metric_columns(prefix).items()])


def neighbour_correction(rows: DataFrame, by: Sequence[str], rounds: int = 2, prediction: str = "prediction", target: str = "target", valid: str | None = None) -> DataFrame:
    """``rows`` with corrected (boolean) and changed_in (round, or null): a target-informed tolerance at borders.

    Two fronts start at the true positives, one through false negatives (which become positive) and one through false
    positives (which become negative), one face step a round, never through each other or outside ``valid``.
    """
    keys = [*by, *AXES]
    p, t = F.coalesce(F.col(prediction), F.lit(False)), F.coalesce(F.col(target), F.lit(False))
    v = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    state = F.when(v & p & t, 0).when(v & ~p & t, 1).when(v & p & ~t, 2)
    marked = saved(rows.select(*keys, state.alias("state")).where("state is not null"), "marked")  # both masks' voxels alone
    seeds = marked.where("state = 0").select(*keys)
    open_ = marked.where("state > 0")
    front = seeds.withColumn("state", F.lit(1)).union(seeds.withColumn("state", F.lit(2)))
    reached = None
    for i in range(1, rounds + 1):
        near = merged(shifted(front, [*by, "state"]))
        new = open_.join(near, [*keys, "state"], "left_semi")
        if reached is not None:
            new = new.join(merged(reached), [*keys, "state"], "left_anti")
        new = new.select(*keys, "state")
        if i < rounds:
            new = saved(new, "front")
        reached_now = new.withColumn("changed_in", F.lit(i))
        reached = reached_now if reached is None else reached.union(reached_now)
        front = new
    changed = reached.select(*keys, "changed_in") if reached is not None else seeds.where("false").withColumn("changed_in", F.lit(None).cast("int"))
    out = rows.join(merged(changed), keys, "left")
    return out.withColumn("corrected", F.when(F.col("changed_in").isNotNull(), ~p).otherwise(p))


def correction_counts(corrected: DataFrame, by: Sequence[str], target: str = "target") -> DataFrame:
    """by, fn_promoted_to_tp_voxels, fp_removed_voxels."""
    t, hit = F.coalesce(F.col(target), F.lit(False)), F.col("changed_in").isNotNull()
    return corrected.groupBy(*by).agg(F.count_if(hit & t).alias("fn_promoted_to_tp_voxels"), F.count_if(hit & ~t).alias("fp_removed_voxels"))


def component_overlap(prediction: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, prediction_component, target_component, overlap: the pairs of components that share voxels."""
    keys = [*by, *AXES]
    both = prediction.select(*keys, F.col("component").alias("prediction_component")).join(merged(target.select(*keys, F.col("component").alias("target_component"))), keys)
    return both.groupBy(*by, "prediction_component", "target_component").agg(F.count("*").alias("overlap"))


def component_metrics(prediction: DataFrame, target: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, matches, splits, merges and overlap of labelled masks (column component) for every row of ``groups``.

    A component is matched if it shares a voxel with the other side; a target met by several predictions is split, a prediction
    that meets several targets is a merge.  IoU statistics are over all pairs that meet, 0 if there are none.
    """
    by = list(by)

    def sizes(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*by, F.col("component").alias(name)).agg(F.count("*").alias(f"{name}_size"))

    p, t = sizes(prediction, "prediction_component"), sizes(target, "target_component")
    pairs = component_overlap(prediction, target, by).join(merged(p), [*by, "prediction_component"]).join(merged(t), [*by, "target_component"])
    pairs = pairs.withColumn("iou", F.col("overlap") / (F.col("prediction_component_size") + F.col("target_component_size") - F.col("overlap")))
    ps = pairs.groupBy(*by, "prediction_component").agg(F.count("*").alias("d")).groupBy(*by).agg(F.count("*").alias("matched_prediction_components"), F.count_if(F.col("d") > 1).alias("merge_count"))
    ts = pairs.groupBy(*by, "target_component").agg(F.count("*").alias("d")).groupBy(*by).agg(F.count("*").alias("matched_target_components"), F.count_if(F.col("d") > 1).alias("split_count"))
    stats = pairs.groupBy(*by).agg(F.count("*").alias("matched_pair_count"), F.avg("iou").alias("matched_iou_mean"), F.median("iou").alias("matched_iou_median"), F.min("iou").alias("matched_iou_min"), F.max("iou").alias("matched_iou_max"))
    out = groups.select(*by).distinct()
    for part in (p.groupBy(*by).agg(F.count("*").alias("prediction_components")), t.groupBy(*by).agg(F.count("*").alias("target_components")), ps, ts, stats):
        out = out.join(part, by, "left")
    out = out.fillna(0)
    n_p, n_t = F.col("prediction_components"), F.col("target_components")
    return out.select(
        *by,
        "prediction_components",
        "target_components",
        (n_p - n_t).alias("component_count_difference"),
        F.abs(n_p - n_t).alias("component_count_error"),
        "matched_prediction_components",
        "matched_target_components",
        safe_divide("matched_prediction_components", n_p).alias("component_precision"),
        safe_divide("matched_target_components", n_t).alias("component_recall"),
        (n_p - F.col("matched_prediction_components")).alias("false_components"),
        (n_t - F.col("matched_target_components")).alias("missed_components"),
        "split_count",
        "merge_count",
        "matched_pair_count",
        *[F.col(c).cast("double").alias(c) for c in ("matched_iou_mean", "matched_iou_median", "matched_iou_min", "matched_iou_max")],
    )


def labelled(voxels: DataFrame, by: Sequence[str], connectivity: int = 6) -> DataFrame:
    return components(voxels, by, connectivity)


def masked_sides(rows: DataFrame, by: Sequence[str], prediction: str = "prediction", target: str = "target", valid: str | None = None) -> DataFrame:
    """by, side, z, y, x: the voxels of both masks (within ``valid``) as one table, so that both are labelled in one go."""
    sides = F.array_compact(F.array(F.when(F.col(prediction), F.lit("prediction")), F.when(F.col(target), F.lit("target"))))
    rows = rows if valid is None else rows.where(F.col(valid))
    return saved(rows.select(*by, *AXES, F.explode(sides).alias("side")), "sides")


def labelled_sides(sides: DataFrame, by: Sequence[str], connectivity: int = 6) -> DataFrame:
    """The labelled runs of both masks of ``masked_sides``."""
    by = [*by, "side"]
    return saved(run_components(runs_of(sides, by), by, connectivity), "labelled")


def side_of(runs: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    """The labelled voxels of one mask."""
    return voxels_of(runs.where(F.col("side") == side), by)


def depth_slab_metrics(rows: DataFrame, by: Sequence[str], nz: str = "nz", slabs: int = 8, rounds: int = 0, **masks: str) -> DataFrame:
    """Metrics per depth slab, with slab and its middle as a part of the depth. Corrections never cross a slab border."""
    cut = rows.withColumn("slab", slab_of("z", nz, slabs))
    by = [*by, "slab"]
    if rounds:
        fixed = neighbour_correction(cut, by, rounds, **masks)
        out = voxel_metrics(fixed, by, "corrected", masks.get("target", "target"), masks.get("valid"))
    else:
        out = voxel_metrics(cut, by, **masks)
    edges = cut.groupBy(*by).agg(F.min("z").alias("z0"), (F.max("z") + 1).alias("z1"), F.max(nz).alias("_nz"))
    return out.join(edges.withColumn("depth_fraction", (F.col("z0") + F.col("z1")) / 2 / F.col("_nz")).drop("_nz"), by)


def depth_rows(rows: DataFrame, by: Sequence[str], nz: str = "nz", slabs: int = 8, rounds: int = 2, **masks: str) -> DataFrame:
    """Per depth slab its place and the raw and corrected metrics, under their prefixes."""
    cut = rows.withColumn("slab", slab_of("z", nz, slabs))
    keys = [*by, "slab"]
    fixed = neighbour_correction(cut, keys, rounds, **masks)
    target, valid = masks.get("target", "target"), masks.get("valid")
    raw = voxel_metrics(cut, keys, masks.get("prediction", "prediction"), target, valid, "raw_")
    corrected = voxel_metrics(fixed, keys, "corrected", target, valid, f"{CORRECTED}_")
    edges = cut.groupBy(*keys).agg(F.min("z").alias("slab_start"), (F.max("z") + 1).alias("slab_stop"), F.max(nz).alias("_nz"))
    edges = edges.withColumn("depth_fraction_midpoint", (F.col("slab_start") + F.col("slab_stop")) / 2 / F.col("_nz")).drop("_nz")
    return edges.join(raw, keys).join(corrected, keys)


def depth_trends(slabs: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("dice", "precision", "recall"), prefixes: Sequence[str] = ("",), depth: str = "depth_fraction") -> DataFrame:
    """Least-squares slope of each metric of each prefix over the depth, with the slabs it rests on; null where fewer than two are valid.

    A slab is valid for a metric by the counts of the same prefix.
    """
    parts = []
    for prefix in prefixes:
        p, t = F.col(f"{prefix}prediction_positive_voxels"), F.col(f"{prefix}target_positive_voxels")
        valid = {"dice": p + t > 0, "precision": p > 0, "recall": t > 0}
        for m in metrics:
            y = F.when(valid.get(m, F.lit(True)), F.col(prefix + m))
            parts += [F.regr_slope(y, F.col(depth)).alias(f"{prefix}{m}_slope_per_depth_fraction"), F.count(y).alias(f"{prefix}{m}_fit_slabs")]
    return slabs.groupBy(*by).agg(*parts)


def macro_cube(rows: DataFrame, method: str = "method", dims: Sequence[str] = ("split", "domain"), skip: Sequence[str] = ("threshold",)) -> DataFrame:
    """Per method, the mean of every numeric column over each part of the dimensions and over all of them ('all'), with n_patches."""
    numeric = [f.name for f in rows.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") and f.name not in (method, *dims, *skip)]
    cube = rows.withColumnsRenamed({d: f"_{d}" for d in dims}).withColumn("_method", F.col(method)).cube("_method", *[f"_{d}" for d in dims])
    out = cube.agg(F.grouping("_method").alias("_g"), *[F.grouping(f"_{d}").alias(f"_g{d}") for d in dims], F.count("*").alias("n_patches"), *[F.avg(c).alias(f"mean_{c}") for c in numeric])
    names = [F.when(F.col(f"_g{d}") == 1, F.lit("all")).otherwise(F.col(f"_{d}")).alias(d) for d in dims]
    return out.where("_g = 0").select(F.col("_method").alias(method), *names, "n_patches", *[f"mean_{c}" for c in numeric])


def heldout_summary(rows: DataFrame, metrics: Sequence[str] = ("dice", "iou", "precision", "recall"), split: str = "heldout") -> DataFrame:
    return rows.where(F.col("split") == split).groupBy("method").agg(F.count("*").alias("n_patches"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def evaluate_masks(rows: DataFrame, by: Sequence[str], rounds: int = 2, topology: bool = True, with_components: bool = True, valid: str | None = None, connectivity: int = 6, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Raw and corrected metrics, the correction, topology comparison and component metrics: 81 columns a group.

    Topology and components are those of the unmodified masks within ``valid``; both masks are labelled in one go, and their
    labels serve the components and the number of parts.
    """
    by = list(by)
    used = dict.fromkeys([*by, *AXES, prediction, target, *([valid] if valid else [])])
    rows = saved(rows.select(*used), "masks")
    groups = rows.select(*by).distinct()
    fixed = saved(neighbour_correction(rows, by, rounds, prediction, target, valid), "corrected")
    out = voxel_metrics(rows, by, prediction, target, valid, "raw_").join(voxel_metrics(fixed, by, "corrected", target, valid, f"{CORRECTED}_"), by)
    counts = correction_counts(fixed, by, target).withColumns({"rounds": F.lit(rounds), "connectivity": F.lit(6), "uses_target_to_modify_prediction": F.lit(True)})
    out = out.join(counts.withColumnsRenamed({c: f"neighbor_correction_{c}" for c in counts.columns if c not in by}), by)
    if not (topology or with_components):
        return out
    sides = masked_sides(rows, by, prediction, target, valid)
    runs = labelled_sides(sides, by, connectivity)
    if topology:
        both = groups.select(*by, F.explode(F.array(F.lit("prediction"), F.lit("target"))).alias("side"))
        found = saved(topology_of(sides, both, [*by, "side"], connectivity, labelled_runs=runs), "topology")
        found = topology_comparison(found.where("side = 'prediction'"), found.where("side = 'target'"), by)
        out = out.join(found.withColumnsRenamed({c: f"raw_topology_{c}" for c in found.columns if c not in by}), by)
    if with_components:
        found = component_metrics(side_of(runs, by, "prediction"), side_of(runs, by, "target"), groups, by)
        out = out.join(found.withColumnsRenamed({c: f"raw_component_{c.removeprefix('component_')}" for c in found.columns if c not in by}), by)
    return out
