"""Tables of files and jobs: pairs of files, jobs by number, plans of generated volumes, rows of different columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import hashed_uniform


def paired_files(files: DataFrame, path: str = "path", left: str = "_label", right: str = "_prob", ending: str = ".nii.gz") -> DataFrame:
    """stem, left_path, right_path, problem: the files of both kinds side by side by what stands before the kind's mark.

    problem is null, or says which side is missing.  Files of other names are left out; a file that stands twice counts once.
    """
    name = F.substring_index(F.col(path), "/", -1)
    ends = {kind: name.endswith(f"{kind}{ending}") for kind in (left, right)}
    stem = F.when(ends[left], F.expr(f"left(name, length(name) - {len(left + ending)})")).when(ends[right], F.expr(f"left(name, length(name) - {len(right + ending)})"))
    rows = files.select(F.col(path).alias("path"), name.alias("name")).withColumn("stem", stem).where("stem is not null")
    is_left = F.col("name").endswith(f"{left}{ending}")
    out = rows.groupBy("stem").agg(F.min(F.when(is_left, F.col("path"))).alias("left_path"), F.min(F.when(~is_left, F.col("path"))).alias("right_path"))
    return out.withColumn("problem", F.when(F.col("left_path").isNull(), f"no {left}").when(F.col("right_path").isNull(), f"no {right}"))


def checked_pairs(files: DataFrame, **options: str) -> DataFrame:
    """stem, left_path, right_path; a file without its partner is an error when it is read."""
    rows = paired_files(files, **options)
    wrong = F.raise_error(F.concat(F.lit("a pair is not complete: "), F.col("stem"), F.lit(" has "), F.col("problem"))).cast("string")
    return rows.withColumn("stem", F.when(F.col("problem").isNotNull(), wrong).otherwise(F.col("stem"))).drop("problem")


def first_by_name(rows: DataFrame, name: str, n: int) -> DataFrame:
    """The first ``n`` rows by name."""
    return rows.orderBy(name).limit(n)


def numbered_jobs(jobs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Jobs with index (from 0) in the given order; a job table has a row per volume and method, not per voxel."""
    return jobs.withColumn("index", F.row_number().over(Window.orderBy(*order)) - 1)


def job_at(jobs: DataFrame, order: Sequence[str], index: int) -> DataFrame:
    """The job of an index; none beyond the last."""
    return numbered_jobs(jobs, order).where(F.col("index") == index)


def generation_plan(volumes: DataFrame, volume: str, shape: Sequence[int], voxel: float, seed: int = 42_000, exponents: tuple[float, float] = (6.1, 6.6)) -> DataFrame:
    """volume, seed, exponent, trees: the trees of a generated volume, by a density of 10 to a drawn exponent; one at least."""
    drawn = exponents[0] + (exponents[1] - exponents[0]) * hashed_uniform(volume, seed)
    size = float(shape[0] * shape[1] * shape[2]) * voxel**3
    trees = F.greatest(F.lit(1).cast("long"), F.floor(F.pow(F.lit(10.0), F.col("exponent")) * size))
    return volumes.select(F.col(volume), (F.col(volume) + seed).alias("seed"), drawn.alias("exponent")).withColumn("trees", trees)


def merged_rows(*tables: DataFrame) -> DataFrame:
    """All rows of tables of different columns; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def templated_path(template: str, root: str, names: Sequence[str] = ("dataset", "patch", "patch_id", "domain", "split", "method")) -> Column:
    """The path of each row by a template: ``{name}`` stands for the column of that name, and what comes out lies below ``root``.

    A name that is not one of ``names`` is an error at once; a null, and a value that would leave its part of the path (one with a
    slash, or of dots only), are errors when they are read.
    """
    used = re.findall(r"\{([^{}]*)\}", template)
    unknown = sorted(set(used) - set(names))
    if unknown or re.search(r"[{}]", re.sub(r"\{[^{}]*\}", "", template)):
        raise ValueError(f"the template {template!r} asks for {unknown or 'an unclosed name'}")
    if template.startswith("/") or any(p in ("", ".", "..") for p in template.split("/")):
        raise ValueError(f"the template {template!r} leaves its root")
    parts = [F.lit(root.rstrip("/") + "/")]
    for i, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
            continue
        value = F.col(piece).cast("string")
        good = F.coalesce(value.rlike(r"^[A-Za-z0-9_.-]+$") & ~value.rlike(r"^\.+$"), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit(f"{piece} is no part of a path: "), F.coalesce(value, F.lit("null")))).cast("string")
        parts.append(F.when(good, value).otherwise(wrong))
    return F.concat(*parts)
