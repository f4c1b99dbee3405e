"""City-block distances in sparse voxel tables, and the morphology that rests on them: labels that grow, shrink and are hollowed out.

A distance transform is three passes, one along each axis: within a line of voxels the distances are closed by running minima
from both ends, and the gaps beside the voxels are filled.  A pass needs the lines in one place and nothing else, so it costs one
shuffle and one sort whatever the reach, and no task holds more than lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import hashed_uniform
from .grid import AXES, shifted
from .labels import random_field

FAR = 1 << 24


def _pass(rows: DataFrame, line: Sequence[str], axis: str, bound: int) -> DataFrame:
    """rows (line, axis, box, near = (d, label)) with near closed along the axis, and the gaps filled within ``bound`` and the box."""
    order = Window.partitionBy(*line).orderBy(axis)
    below, above = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at, d, label = F.col(axis), F.col("near.d"), F.col("near.label")

    def near(distance: Column, name: Column) -> Column:
        return F.struct(distance.cast("int").alias("d"), name.alias("label"))

    rows = rows.withColumn("_b", F.min(near(d - at, label)).over(below)).withColumn("_a", F.min(near(d + at, label)).over(above))
    rows = rows.withColumn("near", F.least(near(F.col("_b.d") + at, F.col("_b.label")), near(F.col("_a.d") - at, F.col("_a.label")))).drop("_a", "_b")
    rows = rows.withColumns({"_next": F.lead(F.struct(axis, "near")).over(order), "_last": F.lag(F.struct(axis, "near")).over(order)})
    low, high = F.col(f"box.{axis}0"), F.col(f"box.{axis}1")
    free = F.coalesce(F.col(f"_next.{axis}") - 1, high)
    right = F.least(F.lit(bound) - d, free - at, high - at)
    taken = F.coalesce(F.col(f"_last.{axis}") + F.greatest(F.lit(bound) - F.col("_last.near.d"), F.lit(0)), low - 1)  # the row before fills up to here
    left = F.least(F.lit(bound) - d, at - 1 - taken, at - low)
    steps = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    ahead = F.transform(
        steps(right),
        lambda k: F.struct((at + k).alias(axis), F.least(near(d + k, label), F.when(F.col("_next").isNotNull(), near(F.col("_next.near.d") + F.col(f"_next.{axis}") - at - k, F.col("_next.near.label")))).alias("near")),
    )
    behind = F.transform(steps(left), lambda k: F.struct((at - k).alias(axis), near(d + k, label).alias("near")))
    every = F.concat(F.array(F.struct(at.alias(axis), F.col("near"))), ahead, behind)
    return rows.select(*line, "box", F.explode(every).alias("_e")).select(*line, "box", f"_e.{axis}", "_e.near")


def distances(seeds: DataFrame, boxes: DataFrame, by: Sequence[str], label: str = "label", bound: int = FAR, each: bool = True) -> DataFrame:
    """by, label, z, y, x, d: city-block distances up to ``bound`` from the seeds, within the box (by, z0, z1, y0, y1, x0, x1) of a group.

    With ``each`` label its own distances, a row for every voxel and label within reach; else a row per voxel, with the nearest
    seed's label (the smallest of equally near ones).  A voxel that holds several seeds counts for all; seeds may lie outside the
    box.  No seeds, no rows.
    """
    kinds, by = dict(seeds.dtypes), list(by)
    box = boxes.select(*by, F.struct(*[F.col(f"{a}{i}").cast("int").alias(f"{a}{i}") for a in AXES for i in (0, 1)]).alias("box"))
    keys = [*by, label] if each else by
    rows = seeds.groupBy(*keys, *[F.col(a).cast("int").alias(a) for a in AXES]).agg(F.min(label).alias("_label")).join(box, by)
    rows = rows.withColumn("near", F.struct(F.lit(0).alias("d"), F.col("_label").alias("label"))).drop("_label")
    for axis in AXES:
        rows = _pass(rows, [*keys, *[a for a in AXES if a != axis]], axis, bound)
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"box.{a}0"), F.col(f"box.{a}1"))
    rows = rows.where(inside & (F.col("near.d") <= bound))
    return rows.select(*by, F.col("near.label").alias(label), *[F.col(a).cast(kinds[a]).alias(a) for a in AXES], F.col("near.d").alias("d"))


def _rim(own: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The voxels next to a label that are not its own, absent and outside ones too."""
    keys = [*by, label, *AXES]
    return shifted(own, [*by, label]).select(*keys).distinct().join(own, keys, "left_anti")


def depths(own: DataFrame, boxes: DataFrame, by: Sequence[str], label: str = "label", bound: int = FAR) -> DataFrame:
    """by, label, z, y, x, depth: how far the voxels of a label are from the nearest that is not of it (1 at its rim; absent voxels and
    those outside are of no label), up to ``bound``."""
    keys = [*by, label, *AXES]
    own = own.select(*keys).distinct()
    return distances(_rim(own, by, label), boxes, by, label, bound).join(own, keys, "left_semi").withColumnRenamed("d", "depth")


def boxes_of(volumes: DataFrame, by: Sequence[str], sizes: dict[str, str]) -> DataFrame:
    """by, z0, z1, ... from the lengths of the axes."""
    return volumes.select(*by, *[c for a in AXES for c in (F.lit(0).alias(f"{a}0"), (F.col(sizes[a]) - 1).alias(f"{a}1"))])


def morph_labels(rows: DataFrame, boxes: DataFrame, by: Sequence[str], radius: Callable[[DataFrame], DataFrame], low: float, high: float, label: str = "label") -> DataFrame:
    """by, z, y, x, label of all voxels that have one when every label has grown, or shrunk, by its radius at each voxel.

    A voxel takes the label of the least signed city-block distance (negative inside, -1 at the rim) less the radius; the background
    competes with radius 0 and wins ties, then the smaller label.  ``radius`` adds a column ``radius`` between ``low`` (0 or
    less) and ``high`` (0 or more) to rows of by, label, z, y, x.  Labels further away than ``high - low`` can't win, so the
    result is that of comparing every voxel with every label.  Rows of label 0 or null are background.
    """
    by, keys = list(by), [*by, *AXES]
    bound = max(1, math.ceil(high - low))
    own = rows.where(F.col(label) > 0).select(*keys, label).distinct()
    near = distances(own, boxes, by, label, bound)
    inner = depths(own, boxes, by, label, bound)
    whole = own.select(*keys, F.lit(0).alias(label)).distinct()
    ground = depths(whole, boxes, by, label, bound).select(*keys, F.col("depth").alias("_ground"))
    signed = near.join(inner, [*keys, label], "left").withColumn("_s", F.when(F.col("d") == 0, -F.coalesce("depth", F.lit(bound))).otherwise(F.col("d")))
    scored = radius(signed.select(*keys, label, "_s", "d")).withColumn("_score", F.col("_s") - F.col("radius"))
    best = scored.groupBy(*keys).agg(F.min(F.struct("_score", label)).alias("_best"), F.min("d").alias("_near"))
    best = best.join(ground, keys, "left")
    back = F.when(F.col("_near") > 0, -F.col("_near")).otherwise(F.coalesce("_ground", F.lit(bound)))
    return best.where(F.col("_best._score") < back).select(*keys, F.col(f"_best.{label}").alias(label))


def smooth_radius(by: Sequence[str], low: float, high: float, nodes: int, sizes: dict[str, int | str], seed: int, part: float = 0.5, label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """For ``morph_labels``: a part of the labels have a smooth random radius between drawn bounds, the others 0.

    The draws are hashes of label and seed.  A size is a number or the name of a column that ``by`` determines.
    """

    def add(rows: DataFrame) -> DataFrame:
        key = F.col(label).cast("long")
        bottom, top = hashed_uniform(key, seed + 1) * low, hashed_uniform(key, seed + 2) * high
        out = random_field(rows, key, nodes, sizes, seed)
        drawn = bottom + (F.greatest(top, bottom) - bottom) * F.col("field")
        return out.withColumn("radius", F.when(hashed_uniform(key, seed + 3) < part, drawn).otherwise(0.0)).drop("field")

    return add


def hollow_and_refill(rows: DataFrame, boxes: DataFrame, by: Sequence[str], width: Callable[[DataFrame], DataFrame], chosen: Column, label: str = "label") -> DataFrame:
    """rows whose chosen labels keep a shell only: voxels not less than ``width`` deep take the nearest label that is not chosen.

    A voxel of depth d (1 at the rim) stays if d < width.  The nearest is by city-block distance, of equals the smaller label; the
    background (0, absent voxels and those outside) is a label like others.  ``width`` adds a column ``width`` to rows of by,
    label, z, y, x.  Rows of other labels, null and 0 are unchanged.
    """
    by, keys = list(by), [*by, *AXES]
    kind = dict(rows.dtypes)[label]
    own = rows.where(F.col(label) > 0).select(*keys, label).distinct()
    picked = own.where(chosen)
    core = width(depths(picked, boxes, by, label)).where(F.col("depth") >= F.col("width")).select(*keys)
    places = picked.select(*keys).distinct()
    rim = shifted(places, by).select(*keys).distinct().join(places, keys, "left_anti")
    seeds = rim.join(own, keys, "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)).cast(kind))
    fill = distances(seeds, boxes, by, label, each=False).join(core, keys, "left_semi").select(*keys, F.col(label).alias("_fill"))
    return rows.join(fill, keys, "left").withColumn(label, F.coalesce("_fill", F.col(label))).drop("_fill")
