"""Intensities: normalisation, summaries, thresholds, overlays, smoothing, resampling and ridge scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import antialias_sigma, at_least, clipped, rescaled, resampled_size
from .grid import AXES, saved


def percentile_normalise(rows: DataFrame, by: Sequence[str], value: str = "value", low: float = 0.005, high: float = 0.995, into: str = "score", single: bool = True, by_range: bool = False) -> DataFrame:
    """Clip to exact percentiles (linear between ranks) per group and scale to [0, 1]; 0 where they coincide.

    With ``by_range`` groups may be of any size (see ``percentiles_by_range``); without it the distinct values of a group must
    fit one task, which takes one pass instead of five.
    """
    v = F.col(value).cast("float").cast("double") if single else F.col(value).cast("double")
    if by_range:
        limits = percentiles_by_range(rows.withColumn("_v", v), by, "_v", (low, high)).withColumnRenamed("p", "_p")
    else:
        limits = rows.groupBy(*by).agg(F.percentile(v, F.array(F.lit(low), F.lit(high))).alias("_p"))
    joined = rows.join(F.broadcast(limits), list(by))  # a row per group; left to itself Spark may take the voxels
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    score = F.when(hi <= lo, F.lit(0.0)).otherwise((clipped(v, lo, hi) - lo) / (hi - lo))
    return joined.withColumn(into, score).drop("_p")


def checked(rows: DataFrame, value: str = "value") -> DataFrame:
    """``rows``; a value that is null, NaN or infinite is an error when it is read."""
    v = F.col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.withColumn(value, F.when(bad, F.raise_error(F.lit(f"{value} must be finite"))).otherwise(F.col(value)))


def minmax_rescale(rows: DataFrame, by: Sequence[str], value: str = "value", vmin: float = 0.0, vmax: float = 1.0, into: str = "rescaled") -> DataFrame:
    limits = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return rows.join(limits, list(by)).withColumn(into, rescaled(value, "_lo", "_hi", vmin, vmax)).drop("_lo", "_hi")


def intensity_summary(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """by, minimum, p0_5, p50, p99_5, maximum."""
    v = F.col(value).cast("double")
    out = rows.groupBy(*by).agg(F.min(v).alias("minimum"), F.percentile(v, F.array(F.lit(0.005), F.lit(0.5), F.lit(0.995))).alias("p"), F.max(v).alias("maximum"))
    return out.select(*by, "minimum", F.col("p")[0].alias("p0_5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p99_5"), "maximum")


def multi_threshold(rows: DataFrame, thresholds: dict[str, float], score: str = "score") -> DataFrame:
    """Every row once per labelled threshold: label, threshold, mask."""
    labels = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    return rows.select("*", F.explode(labels).alias("label", "threshold")).withColumn("mask", at_least(score, F.col("threshold")))


def error_histogram(rows: DataFrame, by: Sequence[str], code: Column) -> DataFrame:
    """by and the voxels of each error code, zeros too."""
    names = ["true_negative", "true_positive", "false_positive", "false_negative"]
    return rows.groupBy(*by).agg(*[F.count_if(code == i).alias(n) for i, n in enumerate(names)])


def mid_slices(rows: DataFrame, sizes: dict[str, str]) -> DataFrame:
    """The middle plane of each axis: axis, row, column and the other columns. ``sizes``: axis -> column of its length."""
    parts = []
    for axis in AXES:
        a, b = (x for x in AXES if x != axis)
        plane = rows.where(F.col(axis) == F.floor(F.col(sizes[axis]) / 2))
        parts.append(plane.withColumns({"axis": F.lit(axis), "row": F.col(a), "column": F.col(b)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlay_rgb(rows: DataFrame, by: Sequence[str], value: str = "value", code: str = "code") -> DataFrame:
    """r, g, b of a slice: grey by its own range, true positives green, false positives yellow, false negatives pink."""
    grey = minmax_rescale(rows, by, value, 0, 255, "_grey").withColumn("_grey", F.floor("_grey").cast("int"))
    colours = {1: (0, 200, 0), 2: (230, 210, 0), 3: (255, 105, 180)}  # fixed values
    for i, c in enumerate("rgb"):
        shade = F.col("_grey")
        for k, rgb in colours.items():
            shade = F.when(F.col(code) == k, F.lit(rgb[i])).otherwise(shade)
        grey = grey.withColumn(c, shade)
    return grey.drop("_grey")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)] if sigma > 0 else [1.0]
    return [x / sum(w) for x in w]


def gaussian_smooth(rows: DataFrame, by: Sequence[str], axis: str, sigma: float, size: str, value: str = "value") -> DataFrame:
    """1-D Gaussian along an axis of a dense table; beyond its ends the edge value holds.

    Each voxel sends its weighted value to the voxels within reach, those at the ends also on behalf of the voxels beyond.
    """
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    keys = [*by, *AXES]
    sent = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights)])
    at, last = F.col(axis), F.col(size) - 1
    own = rows.select(*keys, size, F.col(value).cast("double").alias("_v"), F.explode(sent).alias("_o"))
    own = own.select(*keys, size, "_v", (at + F.col("_o.d")).alias("_to"), F.col("_o.w").alias("_w")).where((F.col("_to") >= 0) & (F.col("_to") <= last))
    parts = [own]
    for end, side in ((F.lit(0), -1), (last, 1)):
        beyond = rows.where(at == end).select(*keys, size, F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(max(reach, 1)))).alias("_k"))
        beyond = beyond.select(*keys, size, "_v", "_k", F.explode(sent).alias("_o")).withColumn("_to", end + side * F.col("_k") + F.col("_o.d"))
        parts.append(beyond.where((F.col("_to") >= 0) & (F.col("_to") <= last)).select(*keys, size, "_v", "_to", F.col("_o.w").alias("_w")))
    every = parts[0].union(parts[1]).union(parts[2])
    others = [k for k in keys if k != axis]
    return every.groupBy(*others, F.col("_to").cast(dict(rows.dtypes)[axis]).alias(axis)).agg(F.sum(F.col("_v") * F.col("_w")).alias(value)).select(*keys, value)


def _size(size: int | str) -> Column:
    """The length of an axis: a number or the name of its column."""
    return (F.col(size) if isinstance(size, str) else F.lit(size)).cast("int")


def trilinear_resample(rows: DataFrame, by: Sequence[str], sizes: dict[str, int | str], spacing: dict[str, float], target: float, value: str = "value") -> DataFrame:
    """Values on a grid of ``target`` spacing that is centred on the old one; outside, the edge holds.

    A size is a number or the name of its column, which is the same for all voxels of a volume.  Along each axis every old
    plane sends its weight to the new planes on both sides, so no volume is gathered anywhere.
    """
    lengths = [f"_n{a}" for a in AXES]
    out = rows.select(*by, *AXES, *[_size(sizes[a]).alias(c) for a, c in zip(AXES, lengths)], F.col(value).cast("double").alias("_v"))
    for axis in AXES:
        at, n, s = F.col(axis), F.col(f"_n{axis}"), float(spacing[axis])
        m = (F.rint((n - 1) * s / target) + 1).cast("int")
        # The new planes between the old ones on both sides; those beyond the ends belong to the end planes.
        first = F.when(at == 0, 0).otherwise(F.floor((at - 1 - (n - 1) / 2) * s / target + (m - 1) / 2))
        last = F.when(at == n - 1, m - 1).otherwise(F.ceil((at + 1 - (n - 1) / 2) * s / target + (m - 1) / 2))
        first, last = F.greatest(first.cast("int"), F.lit(0)), F.least(last.cast("int"), m - 1)
        sent = out.withColumn("_j", F.explode(F.when(first <= last, F.sequence(first, last))))
        place = F.least(F.greatest((n - 1) / 2 + (F.col("_j") - (m - 1) / 2) * target / s, F.lit(0.0)), (n - 1).cast("double"))
        sent = sent.withColumn("_p", place).withColumn("_low", F.least(F.floor("_p"), F.greatest(n - 2, F.lit(0))))
        part = F.col("_p") - F.col("_low")
        sent = sent.withColumn("_w", F.when(at == F.col("_low"), 1 - part).when(at == F.col("_low") + 1, part)).where("_w <> 0")
        others = [*by, *[a for a in AXES if a != axis], *lengths]
        out = sent.groupBy(*others, F.col("_j").alias(axis)).agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))
    return out.select(*by, *AXES, F.col("_v").alias(value))


def resample_plan(volumes: DataFrame, target: float) -> DataFrame:
    """volumes (nz, ny, nx, zooms) with the new sizes and the anti-alias sigma of each axis."""
    out = volumes
    for i, axis in enumerate(AXES):
        out = out.withColumn(f"new_n{axis}", resampled_size(f"n{axis}", F.col("zooms")[i], target)).withColumn(f"sigma_{axis}", antialias_sigma(F.col("zooms")[i], target))
    return out


def tiles_of(rows: DataFrame, sizes: dict[str, int | str], tile: int, overlap: float = 0.5) -> DataFrame:
    """Every voxel once for each sliding window that covers it: tz, ty, tx (the window's lowest corner).

    A size is a number or the name of its column.
    """
    step = max(1, int(tile * (1 - overlap)))
    out = rows
    for axis in AXES:
        at, last = F.col(axis), F.greatest(_size(sizes[axis]) - tile, F.lit(0))
        near = F.sequence(F.greatest(F.ceil((at - tile + 1) / step), F.lit(0)).cast("int"), F.floor(at / step).cast("int"))
        starts = F.array_distinct(F.array_append(F.transform(near, lambda k: F.least(k * step, last)), last))  # noqa: B023
        inside = F.filter(starts, lambda s: (at >= s) & (at < s + tile))  # noqa: B023
        out = out.withColumn(f"t{axis}", F.explode(inside))
    return out


def blend_tiles(rows: DataFrame, by: Sequence[str], tile: int, value: Column) -> DataFrame:
    """by, z, y, x, blended, tiles: the average of what each window (tz, ty, tx) says of a voxel, weighted by a Gaussian of its
    place in the window."""
    sigma, centre = 0.125 * tile, (tile - 1) / 2
    d2 = sum((F.col(a) - F.col(f"t{a}") - centre) * (F.col(a) - F.col(f"t{a}") - centre) for a in AXES)
    weighed = rows.withColumn("_w", F.exp(-d2 / (2 * sigma * sigma)))
    return weighed.groupBy(*by, *AXES).agg((F.sum(F.col("_w") * value) / F.sum("_w")).alias("blended"), F.count("*").alias("tiles"))


#: Bits of a value's key that one pass counts by, and the bits of a key.
DIGIT, KEY = 16, 64


def double_bits(value: Column) -> Column:
    """The 64 bits of a double as a long (Spark has no function of its own for it; a column of its own, as Spark takes calls of Java
    methods for non-deterministic)."""
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")


def bits_double(bits: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


SIGN = -(1 << 63)


def percentiles_by_range(rows: DataFrame, by: Sequence[str], value: str, parts: Sequence[float]) -> DataFrame:
    """by, p: exact percentiles (linear between ranks), like ``percentile`` but without a group's values in one buffer.

    Radix selection: four passes count the values by 16 more bits of their keys, each among those that agree with a wanted rank so
    far, so what is gathered is at most 65,536 counts a group and rank whatever the values are.  Nulls and NaN don't count; a
    group without values has no row.
    """
    by = list(by)
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    bits = v.select(*by, double_bits(F.col("_v")).alias("_bits"))
    ordered = F.when(F.col("_bits") < 0, F.bitwise_not("_bits")).otherwise(F.col("_bits").bitwiseXOR(F.lit(SIGN)))  # unsigned order is the values'
    keys = saved(bits.select(*by, ordered.alias("_key")), "keys")
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(parts)])).alias("_q")
    wanted = keys.groupBy(*by).agg(F.count("*").alias("_all")).select(*by, "_all", asked).withColumn("_at", F.col("_q.q") * (F.col("_all") - 1))
    wanted = wanted.select(*by, F.col("_q.i").alias("_i"), "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    wanted = wanted.withColumns({"_prefix": F.lit(0).cast("long"), "_left": F.col("_rank")})
    for shift in range(KEY - DIGIT, -1, -DIGIT):
        mine = F.shiftrightunsigned("_key", shift + DIGIT) if shift + DIGIT < KEY else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        found = keys.select(*by, mine.alias("_prefix"), digit.alias("_digit"))
        if shift + DIGIT < KEY:
            found = found.join(wanted.select(*by, "_prefix").distinct(), [*by, "_prefix"])
        counts = found.groupBy(*by, "_prefix", "_digit").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "_prefix").orderBy("_digit"))
        counts = counts.withColumn("_end", upto).withColumn("_begin", F.col("_end") - F.col("_n"))
        hit = wanted.join(counts, [*by, "_prefix"]).where("_left >= _begin and _left < _end")
        prefix = F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit"))
        wanted = saved(hit.select(*by, "_i", "_at", "_rank", prefix.alias("_prefix"), (F.col("_left") - F.col("_begin")).alias("_left")), "ranks")
    weight = F.when(F.col("_rank") == F.col("_at"), 1.0).otherwise(1 - F.abs(F.col("_rank") - F.col("_at")))
    back = F.when(F.col("_prefix") < 0, F.col("_prefix").bitwiseXOR(F.lit(SIGN))).otherwise(F.bitwise_not("_prefix"))
    values = wanted.select(*by, "_i", "_at", "_rank", bits_double(back).alias("_v"))
    each = values.groupBy(*by, "_i").agg(F.sum(F.col("_v") * weight).alias("_p"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_p"))).alias("p")).select(*by, F.transform("p", lambda e: e["_p"]).alias("p"))
