"""Curves to voxels: tessellation, segment rasterisation, scatter reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import binary_falloff, clipped, cosine_falloff, segment_distance
from .grid import AXES

#: Labels are below this: 43 bits beside the 20 bits of a probability in steps of 1e-6.
LABELS = 1 << 43

def tessellate(points: DataFrame, curve: str, order: str, radius: str, step: float) -> DataFrame:
    """curve, leg, seg, z0, y0, x0, z1, y1, x1, r: poly-line legs cut into max(1, ceil(length / step)) equal segments.

    The radius of a segment is that of its middle, between the leg's ends.
    """
    w = Window.partitionBy(curve).orderBy(order)
    ends = points.select(curve, *AXES, radius, F.row_number().over(w).alias("leg"), *[F.lead(c).over(w).alias(f"_{c}") for c in (*AXES, radius)]).where(f"_{radius} is not null")
    length = F.sqrt(sum((F.col(f"_{a}") - F.col(a)) * (F.col(f"_{a}") - F.col(a)) for a in AXES))
    pieces = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    cut = ends.withColumn("length", length).withColumn("n", pieces)
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seg"))
    at = {0: F.col("seg") / F.col("n"), 1: (F.col("seg") + 1) / F.col("n")}
    coords = [(F.col(a) + (F.col(f"_{a}") - F.col(a)) * t).cast("double").alias(f"{a}{i}") for i, t in at.items() for a in AXES]
    middle = F.col(radius) + (F.col(f"_{radius}") - F.col(radius)) * (at[0] + at[1]) / 2
    return cut.select(curve, "leg", "seg", *coords, middle.cast("double").alias("r"), "length")


def arc_points(points: DataFrame, curve: str, order: str, radius: str, step: float) -> DataFrame:
    """curve, point (from 0), z, y, x, radius: max(2, ceil(length / step) + 1) points of each poly-line, equally spaced along it.

    A leg holds the steps between the curve lengths at its ends, which are a running sum, so no step is sought.  Points that
    repeat add no length; a curve without length is two equal points, one of a single point is left out.  The last point is the
    last leg's alone: where that has no length, rounding may put it on the legs before as well.
    """
    w = Window.partitionBy(curve).orderBy(order)
    ends = points.select(curve, *AXES, radius, F.row_number().over(w).alias("_leg"), *[F.lead(c).over(w).alias(f"_{c}") for c in (*AXES, radius)])
    ends = ends.where(F.col(f"_{radius}").isNotNull())
    length = F.sqrt(sum((F.col(f"_{a}") - F.col(a)) * (F.col(f"_{a}") - F.col(a)) for a in AXES))
    legs = Window.partitionBy(curve).orderBy("_leg")
    cut = ends.withColumn("_to", F.sum(length).over(legs.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumns({"_from": F.coalesce(F.lag("_to").over(legs), F.lit(0.0)), "_all": F.last("_to").over(legs.rowsBetween(0, Window.unboundedFollowing)), "_more": F.lead("_leg").over(legs)})
    n = F.greatest(F.lit(2), F.ceil(F.col("_all") / step) + 1).cast("int")
    gap = F.when(F.col("_all") > 0, F.col("_all") / (n - 1)).otherwise(1.0)
    first, last = F.ceil(F.col("_from") / gap).cast("int"), F.when(F.col("_more").isNull(), n - 1).otherwise(F.least(F.ceil(F.col("_to") / gap).cast("int") - 1, n - 2))
    first = F.when(F.col("_leg") == 1, 0).otherwise(F.least(first, n - 1))
    cut = cut.withColumn("_gap", gap).withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last))))
    along = F.when(F.col("_to") > F.col("_from"), (F.col("point") * F.col("_gap") - F.col("_from")) / (F.col("_to") - F.col("_from"))).otherwise(0.0)
    cut = cut.withColumn("_t", clipped(along, 0.0, 1.0))
    return cut.select(curve, "point", *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_t")).cast("double").alias(c) for c in (*AXES, radius)])


def tessellate_arcs(points: DataFrame, curve: str, order: str, radius: str, step: float) -> DataFrame:
    """curve, seg, z0, y0, x0, z1, y1, x1, r: the segments between neighbouring ``arc_points``; r is the mean of their radii."""
    w = Window.partitionBy(curve).orderBy("point")
    at = arc_points(points, curve, order, radius, step)
    ends = at.select(curve, F.col("point").alias("seg"), *[F.col(a).alias(f"{a}0") for a in AXES], *[F.lead(a).over(w).alias(f"{a}1") for a in AXES], ((F.col(radius) + F.lead(radius).over(w)) / 2).alias("r"))
    return ends.where("r is not null")


def segment_voxels(segments: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Every segment once for each voxel of the cube around its middle (half width ceil(r) + 2) within the grid."""
    out = segments
    half = F.ceil(F.col("r")).cast("int") + 2
    for a, n in zip(AXES, shape):
        middle = F.rint((F.col(f"{a}0") + F.col(f"{a}1")) / 2).cast("int")
        low, high = F.greatest(middle - half, F.lit(0)), F.least(middle + half, F.lit(n - 1))
        out = out.withColumn(a, F.explode(F.when(low <= high, F.sequence(low, high))))
    return out


def scatter(rows: DataFrame, by: Sequence[str], distance: Column, prob: Column, label: Column) -> DataFrame:
    """by, z, y, x, dist (least), label (of the largest quantised probability, ties to the larger label), prob (union).

    Probability and label share one long, so that the aggregation needs no sort; a label below 0 or not below LABELS is an error.
    """
    label = label.cast("long")
    label = F.when((label >= 0) & (label < LABELS), label).when(label.isNotNull(), F.raise_error(F.lit(f"a label must be 0 or more and below {LABELS}")).cast("long"))
    encoded = F.floor(prob * 1e6).cast("long") * LABELS + label
    rows = rows.select(*by, *AXES, distance.alias("_d"), encoded.alias("_e"), F.log(F.greatest(1 - prob, F.lit(1e-7))).alias("_l"))
    out = rows.groupBy(*by, *AXES).agg(F.min("_d").alias("dist"), F.max("_e").alias("_e"), F.sum("_l").alias("_l"))
    return out.select(*by, *AXES, "dist", (F.col("_e") % LABELS).alias("label"), (1 - F.exp("_l")).alias("prob"))


def rasterise(segments: DataFrame, shape: Sequence[int], curve: str, by: Sequence[str] = (), soft: bool = True) -> DataFrame:
    """by, z, y, x, prob, label, dist of the voxels near segments; label is 0 where prob is.

    A segment covers a cube by its own radius, so the result doesn't depend on how segments are batched; voxels that no cube
    covers are absent (prob 0, label 0, dist infinite).
    """
    cells = segment_voxels(segments, shape)
    d = segment_distance(AXES, [f"{a}0" for a in AXES], [f"{a}1" for a in AXES])
    cells = cells.withColumn("_dist", d)
    p = clipped((cosine_falloff if soft else binary_falloff)("_dist", "r"), 0.0, 1.0)
    out = scatter(cells, by, F.col("_dist"), p, F.col(curve).cast("long"))
    return out.withColumn("label", F.when(F.col("prob") > 0, F.col("label")).otherwise(0))


def dense(volumes: DataFrame, voxels: DataFrame, by: Sequence[str], fill: dict[str, float]) -> DataFrame:
    """All voxels of the volumes (by, nz, ny, nx), with the given values where ``voxels`` has none."""
    full = volumes.select(*by, "ny", "nx", F.explode(F.sequence(F.lit(0), F.col("nz").cast("int") - 1)).alias("z"))
    full = full.select(*by, "z", "nx", F.explode(F.sequence(F.lit(0), F.col("ny").cast("int") - 1)).alias("y"))
    full = full.select(*by, "z", "y", F.explode(F.sequence(F.lit(0), F.col("nx").cast("int") - 1)).alias("x"))
    out = full.join(voxels, [*by, *AXES], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
