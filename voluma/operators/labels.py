"""Instance labels: field means, subsets, groups, shell and interior, random morphology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import hashed_uniform
from .grid import AXES, shifted


def masked_labels(rows: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Labels are 0 where the probability is not positive."""
    return rows.withColumn(label, F.when(F.col(prob) > 0, F.col(label)).otherwise(0))


def label_field_mean(rows: DataFrame, by: Sequence[str], field: Column, label: str = "label") -> DataFrame:
    """by, label, n_voxels, field_mean of every label above 0."""
    return rows.where(F.col(label) > 0).groupBy(*by, label).agg(F.count("*").alias("n_voxels"), F.avg(field).alias("field_mean"))


def _rewritten(rows: DataFrame, table: DataFrame, by: Sequence[str], label: str, new: Column) -> DataFrame:
    """Labels rewritten through a table of (by, label); the table has a row per label, not per voxel."""
    return rows.join(table, [*by, label], "left").withColumn(label, new)


def subset_bernoulli(rows: DataFrame, by: Sequence[str], field: Column, seed: int = 0, label: str = "label") -> DataFrame:
    """Keeps a label with the probability of its field mean; others become 0. The draw is a hash of label and seed."""
    means = label_field_mean(rows, by, field, label)
    kept = means.withColumn("_keep", hashed_uniform(label, seed) < F.col("field_mean")).select(*by, label, "_keep")
    return _rewritten(rows, kept, by, label, F.when(F.col("_keep"), F.col(label)).otherwise(0)).drop("_keep")


def subset_fixed_fraction(rows: DataFrame, by: Sequence[str], fraction: float, seed: int = 0, label: str = "label") -> DataFrame:
    """Keeps max(1, floor(n * fraction)) labels of each group, in the order of a hash; others become 0."""
    own = rows.where(F.col(label) > 0).select(*by, label).distinct()
    order = Window.partitionBy(*by).orderBy(hashed_uniform(label, seed), label)
    total = own.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("_n"))
    kept = own.withColumn("_rank", F.row_number().over(order)).join(total, list(by)).where("_rank <= _n").select(*by, label, F.lit(True).alias("_keep"))
    return _rewritten(rows, kept, by, label, F.when(F.col("_keep"), F.col(label)).otherwise(0)).drop("_keep")


def subset_info(before: DataFrame, after: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """by, n_total, n_kept, fraction of labels."""
    n = before.where(F.col(label) > 0).groupBy(*by).agg(F.countDistinct(label).alias("n_total"))
    k = after.where(F.col(label) > 0).groupBy(*by).agg(F.countDistinct(label).alias("n_kept"))
    return n.join(k, list(by), "left").fillna(0, ["n_kept"]).withColumn("fraction", F.col("n_kept") / F.col("n_total"))


def collapse_labels(rows: DataFrame, groups: int, seed: int = 0, label: str = "label") -> DataFrame:
    """Labels above 0 become one of ``groups`` numbers from 1; 0 stays."""
    return rows.withColumn("group", F.when(F.col(label) > 0, 1 + F.floor(hashed_uniform(label, seed) * groups).cast("int")).otherwise(0))


def mapped(rows: DataFrame, table: DataFrame, key: str, value: str, missing: Column | None = None) -> DataFrame:
    """A look-up of ``value`` by ``key``; rows without an entry get ``missing``."""
    out = rows.join(table.select(key, value), key, "left")
    return out if missing is None else out.withColumn(value, F.coalesce(F.col(value), missing))


def shell_interior(rows: DataFrame, by: Sequence[str], label: str = "label", prob: str | None = None) -> DataFrame:
    """rows with class: 0 background, 2 interior (all six face neighbours have the same label; outside is 0), 1 shell."""
    if prob:
        rows = masked_labels(rows, label, prob)
    keys = [*by, *AXES]
    own = rows.where(F.col(label) > 0).select(*keys, label)
    same = shifted(own, [*by, label]).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    out = rows.join(same, [*keys, label], "left")
    return out.withColumn("class", F.when(F.col(label) == 0, 0).when(F.coalesce("_n", F.lit(0)) == 6, 2).otherwise(1)).drop("_n")


def class_totals(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col("class") == 1).alias("shell"), F.count_if(F.col("class") == 2).alias("interior"))


def redraw(rows: DataFrame, by: Sequence[str], draws: int, least: int, seed: int, keep: float, label: str = "label") -> DataFrame:
    """by, draw, foreground: of ``draws`` random subsets the first with ``least`` foreground voxels, else the last."""
    sizes = rows.where(F.col(label) > 0).groupBy(*by, label).agg(F.count("*").alias("n"))
    tried = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    kept = hashed_uniform(F.col(label).cast("long") * 31 + F.col("draw"), seed) < keep
    found = tried.groupBy(*by, "draw").agg(F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("foreground"))
    order = F.when(F.col("foreground") >= least, F.col("draw")).otherwise(F.lit(draws * 2) - F.col("draw"))
    best = found.groupBy(*by).agg(F.min_by(F.struct("draw", "foreground"), order).alias("b"))
    return best.select(*by, "b.draw", "b.foreground")


def grow_labels(rows: DataFrame, by: Sequence[str], radius: Column, steps: int, label: str = "label") -> DataFrame:
    """Every voxel within ``steps`` city-block steps takes the label with the least distance less ``radius`` (by label), the
    background competing with 0; ties go to the smaller label. Distances are counted from the labels' own voxels."""
    keys = [*by, *AXES]
    seen = rows.where(F.col(label) > 0).select(*keys, label, F.lit(0).alias("d"))
    front = seen
    for i in range(1, steps + 1):
        near = shifted(front.select(*by, label, *AXES), [*by, label]).select(*keys, label).distinct()
        front = near.join(seen, [*keys, label], "left_anti").withColumn("d", F.lit(i))
        seen = seen.union(front)
    scored = seen.withColumn("score", F.col("d") - radius)
    best = scored.groupBy(*keys).agg(F.min(F.struct("score", label)).alias("b"))
    return best.where(F.col("b.score") <= 0).select(*keys, F.col(f"b.{label}").alias(label))


def hollow_labels(rows: DataFrame, by: Sequence[str], width: int, chosen: Column, label: str = "label") -> DataFrame:
    """Chosen labels keep only their voxels within ``width`` steps of another label or the outside; the rest become 0."""
    keys = [*by, *AXES]
    left = rows.where((F.col(label) > 0) & chosen).select(*keys, label)
    for _ in range(width):
        same = shifted(left, [*by, label]).groupBy(*keys, label).agg(F.count("*").alias("_n")).where("_n = 6")
        left = left.join(same.select(*keys, label), [*keys, label], "left_semi")
    core = left.select(*keys, F.lit(True).alias("_core"))
    return rows.join(core, keys, "left").withColumn(label, F.when(F.col("_core"), 0).otherwise(F.col(label))).drop("_core")


def random_field(grid: DataFrame, key: Column, nodes: int, sizes: dict[str, int | str], seed: int = 0) -> DataFrame:
    """grid with field: tri-linear between hashed values at ``nodes`` points along each axis, corners at the ends.

    A size is a number or the name of its column.
    """
    out, corner = grid, F.lit(0.0)
    for a in AXES:
        size = F.col(sizes[a]) if isinstance(sizes[a], str) else F.lit(sizes[a])
        p = F.col(a) * (F.lit(float(nodes - 1)) / F.greatest(size - 1, F.lit(1)))
        low = F.least(F.floor(p), F.lit(max(nodes - 2, 0)))
        out = out.withColumn(f"_i{a}", low.cast("long")).withColumn(f"_f{a}", p - low)
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                node = ((key * nodes + F.col("_iz") + dz) * nodes + F.col("_iy") + dy) * nodes + F.col("_ix") + dx
                w = F.lit(1.0)
                for a, d in zip(AXES, (dz, dy, dx)):
                    w = w * (F.col(f"_f{a}") if d else 1 - F.col(f"_f{a}"))
                corner = corner + w * hashed_uniform(node, seed)
    return out.withColumn("field", corner).drop(*[f"_{k}{a}" for k in "if" for a in AXES])


def intensity_classes(rows: DataFrame, by: Sequence[str], classes: int, seed: int = 0, label: str = "label") -> DataFrame:
    """rows with class and intensity: labels dealt evenly to classes in hash order, one hashed intensity per class."""
    own = rows.where(F.col(label) > 0).select(*by, label).distinct()
    dealt = own.withColumn("class", F.row_number().over(Window.partitionBy(*by).orderBy(hashed_uniform(label, seed), label)) % classes)
    dealt = dealt.withColumn("intensity", hashed_uniform(F.col("class") + 1, seed + 1))
    return rows.join(dealt, [*by, label], "left").fillna(0, ["class", "intensity"])


def blended(rows: DataFrame, foreground: Column, background: Column, prob: str = "prob") -> Column:
    """Partial volumes: the foreground in proportion to its probability, the background for the rest."""
    return foreground * F.col(prob) + background * (1 - F.col(prob))


def flipped(rows: DataFrame, axis: str, size: str) -> DataFrame:
    return rows.withColumn(axis, F.col(size) - 1 - F.col(axis))


def reordered(rows: DataFrame, order: Sequence[int]) -> DataFrame:
    """Axis permutation: new axis i is old axis order[i]."""
    if sorted(order) != [0, 1, 2]:
        raise ValueError("order must hold 0, 1 and 2")
    return rows.withColumns({a: F.col(AXES[o]) for a, o in zip(AXES, order)})


def prefix_split(volumes: DataFrame, name: str, fraction: float) -> DataFrame:
    """split: the first max(1, floor(n * fraction)) volumes by name are val, the others train; no train volume is an error."""
    n = volumes.agg(F.count("*").alias("_n"))
    ranked = volumes.withColumn("position", F.row_number().over(Window.orderBy(name)) - 1).crossJoin(F.broadcast(n))  # volumes, not voxels
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))
    split = F.when(F.col("position") < cut, "val").otherwise("train")
    empty = F.raise_error(F.lit("a split is empty"))
    return ranked.withColumn("split", F.when(cut >= F.col("_n"), empty).otherwise(split)).drop("_n")
