"""Synthetic images from labels: mixtures of normals, partial volumes, bias fields, gamma and noise, and bounded retries.

Every draw is a hash of a seed, the draw's name and the keys of what it is for (volume, label, voxel), so an image is the same
for any partitioning, order and retry of tasks, and any engine with MD5 repeats it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import rescaled
from .grid import AXES, saved
from .intensity import percentile_normalise


def uniform(seed: int, draw: str, *keys: Column | str) -> Column:
    """A number in (0, 1): the first 52 bits of the MD5 of seed, draw and keys, joined by colons, in the middle of its step."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(draw), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(seed: int, draw: str, *keys: Column | str) -> Column:
    """A standard normal number, by Box and Muller from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, f"{draw}.r", *keys))) * F.cos(2 * F.pi() * uniform(seed, f"{draw}.t", *keys))


def gamma(seed: int, draw: str, shape: int, *keys: Column | str) -> Column:
    """A gamma number of mean 1 and variance 1 / shape (a whole number): the mean of so many exponential ones."""
    total = F.lit(0.0)
    for i in range(shape):
        total = total - F.log(uniform(seed, f"{draw}.{i}", *keys))
    return total / shape


def between(value: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + (high - low) * value


def smooth_field(seed: int, draw: str, key: Column | str, nodes: int, sizes: dict[str, int | str]) -> Column:
    """A tri-linear field in (0, 1) between uniform numbers at ``nodes`` points along each axis; a size is a number or a column's name."""
    low, part = {}, {}
    for a in AXES:
        size = F.col(sizes[a]) if isinstance(sizes[a], str) else F.lit(sizes[a])
        p = F.col(a) * (F.lit(float(nodes - 1)) / F.greatest(size - 1, F.lit(1)))
        low[a] = F.least(F.floor(p), F.lit(max(nodes - 2, 0))).cast("int")
        part[a] = p - low[a]
    total = F.lit(0.0)
    for corner in [(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)]:
        w = F.lit(1.0)
        for a, d in zip(AXES, corner):
            w = w * (part[a] if d else 1 - part[a])
        total = total + w * uniform(seed, draw, key, *[low[a] + d for a, d in zip(AXES, corner)])
    return total


def first_that_holds(rows: DataFrame, by: Sequence[str], step: Callable[[DataFrame, int], DataFrame], holds: Callable[[DataFrame], DataFrame], attempts: int = 10) -> tuple[DataFrame, DataFrame]:
    """The result of ``step`` (rows, attempt) for each group at its first attempt whose result holds, else the group's own rows; and
    by, attempt (null: none held).

    ``holds`` gives the groups (by) of a result that hold.  Only groups that don't hold yet go into the next attempt; the table
    of attempts has a row per group.
    """
    by = list(by)
    left, parts, done = saved(rows, "attempts"), [], []
    groups = left.select(*by).distinct()
    for i in range(attempts):
        tried = saved(step(left, i), "attempt")
        good = saved(holds(tried).select(*by).distinct(), "held")
        parts.append(tried.join(good, by, "left_semi"))
        done.append(good.withColumn("attempt", F.lit(i)))
        groups = saved(groups.join(good, by, "left_anti"), "groups_left")
        if groups.isEmpty():
            break
        left = left.join(groups, by, "left_semi")
    parts.append(left.join(groups, by, "left_semi"))
    done.append(groups.withColumn("attempt", F.lit(None).cast("int")))
    out, table = parts[0], done[0]
    for p, d in zip(parts[1:], done[1:]):
        out, table = out.unionByName(p), table.unionByName(d)
    return out, table


def any_label(rows: DataFrame, label: str = "label") -> DataFrame:
    """For ``first_that_holds``: a group holds if a label is left."""
    return rows.where(F.col(label) > 0)


def dropped_labels(rows: DataFrame, by: Sequence[str], seed: int, most: float = 0.2, label: str = "label") -> DataFrame:
    """rows whose labels are 0 with a probability that is drawn below ``most`` for each group."""
    p = between(uniform(seed, "drop", *by), 0.0, most)
    return rows.withColumn(label, F.when(uniform(seed, "dropped", *by, label) < p, 0).otherwise(F.col(label)))


def intensity_groups(rows: DataFrame, by: Sequence[str], seed: int, most: int = 5, label: str = "label") -> DataFrame:
    """rows with group: the labels of each volume in random order, dealt to 1 to ``most`` groups of equal size; 0 for label 0."""
    by = list(by)
    own = rows.where(F.col(label) > 0).select(*by, label).distinct()
    order = Window.partitionBy(*by).orderBy(uniform(seed, "order", *by, label), label)
    groups = 1 + F.floor(uniform(seed, "groups", *by) * most).cast("int")
    dealt = own.withColumns({"_rank": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    dealt = dealt.select(*by, label, (1 + F.floor(F.col("_rank") / F.ceil(F.col("_n") / groups))).cast("int").alias("group"))
    return rows.join(dealt, [*by, label], "left").fillna(0, ["group"])


def mixture(by: Sequence[str], group: Column | str, seed: int, draw: str, spread: float = 0.25) -> Column:
    """An intensity per voxel: normal around the mean of its group in (0, 1), with the group's deviation, below ``spread``."""
    mean, deviation = uniform(seed, f"{draw}.mean", *by, group), between(uniform(seed, f"{draw}.deviation", *by, group), 0.0, spread)
    return mean + deviation * normal(seed, draw, *by, *AXES)


def synthesised(rows: DataFrame, by: Sequence[str], sizes: dict[str, int | str], seed: int, nodes: int = 4, shape: int = 16, label: str = "label", prob: str = "prob") -> DataFrame:
    """rows (dense: by, z, y, x, label, prob) with image, in [0, 1].

    Labels are dealt to groups of one normal intensity each, rescaled to [0.3 to 0.5, 1] and blended in by ``prob``; half of the
    volumes have a background of smooth patches, rescaled to [0, 0.2 to 0.4]; then come an additive and a multiplicative bias
    field (within 0.25 of 0, and of 1), a gamma exponent (0.5 to 2), gamma noise (multiplied) and normal noise, and
    the percentiles 0.5 and 99.5 become 0 and 1.
    """
    by = list(by)
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in by])
    out = intensity_groups(rows, by, seed, label=label)
    out = out.withColumn("_f", mixture(by, "group", seed, "foreground"))
    out = out.withColumn("_patch", F.floor(smooth_field(seed, "patches", key, 2 * nodes, sizes) * 16).cast("int"))
    out = out.withColumn("_b", mixture(by, "_patch", seed, "background"))
    ranges = out.groupBy(*by).agg(*[f(c).alias(f"{c}{k}") for c in ("_f", "_b") for k, f in (("0", F.min), ("1", F.max))])  # a row per volume
    out = out.join(ranges, by)
    front = rescaled("_f", "_f0", "_f1", 0.0, 1.0)
    lower = between(uniform(seed, "lower", *by), 0.3, 0.5)
    upper = F.when(uniform(seed, "has_background", *by) < 0.5, between(uniform(seed, "upper", *by), 0.2, 0.4)).otherwise(0.0)
    image = (lower + (1 - lower) * front) * F.col(prob) + upper * rescaled("_b", "_b0", "_b1", 0.0, 1.0) * (1 - F.col(prob))
    out = out.withColumn("_i", image + between(smooth_field(seed, "add", key, nodes, sizes), -0.25, 0.25))
    out = out.withColumn("_i", F.greatest(F.col("_i"), F.lit(0.0)) * between(smooth_field(seed, "multiply", key, nodes, sizes), 0.75, 1.25))
    out = out.withColumn("_i", F.pow(F.col("_i"), F.pow(F.lit(2.0), between(uniform(seed, "gamma", *by), -1.0, 1.0))))
    out = out.withColumn("_i", F.col("_i") * gamma(seed, "noise", shape, *by, *AXES) + 0.02 * normal(seed, "noise.add", *by, *AXES))
    out = percentile_normalise(out, by, "_i", into="image", single=False)
    return out.select(*rows.columns, "group", F.least(F.greatest("image", F.lit(0.0)), F.lit(1.0)).alias("image"))
