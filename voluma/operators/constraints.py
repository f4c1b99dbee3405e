"""Checks of tables as queries: each returns the rows, or the counts, that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at_least
from .grid import AXES

EPSILON = 2.0**-23


def not_binary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, bad: values other than 0 and 1."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count_if(v.isNull() | F.isnan(v) | ~v.isin(0.0, 1.0)).alias("bad"))


def unpaired(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, only_left, only_right: voxels that one of two dense tables lacks."""
    keys = [*by, *AXES]
    both = a.select(*keys, F.lit(1).alias("l")).join(b.select(*keys, F.lit(1).alias("r")), keys, "full")
    return both.groupBy(*by).agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def affine_differs(a: str, b: str, tolerance: float = 1e-5) -> Column:
    """Whether two flattened affines differ by more than an absolute tolerance anywhere."""
    return ~F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda ok: ok)


def score_range(rows: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """by, not_finite, out_of_range: scores beyond [0, 1] by more than one single-precision step."""
    s = F.col(score).cast("double")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return rows.groupBy(*by).agg(F.count_if(bad).alias("not_finite"), F.count_if(~bad & ((s < -EPSILON) | (s > 1 + EPSILON))).alias("out_of_range"))


def mask_agreement(rows: DataFrame, by: Sequence[str], mask: str, score: str, threshold: Column | float) -> DataFrame:
    """by, n_voxels, n_different: voxels whose saved mask is not the score at the threshold."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_voxels"), F.count_if(F.col(mask) != at_least(score, threshold)).alias("n_different"))


def missing_extra(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, problem: expected rows that are missing, and rows that nobody expected."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, list(keys), "left_anti").withColumn("problem", F.lit("missing")).union(a.join(e, list(keys), "left_anti").withColumn("problem", F.lit("extra")))


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n of the keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def wrong_counts(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") != n)


def short_depths(volumes: DataFrame, slabs: int) -> DataFrame:
    """Volumes with fewer planes than slabs."""
    return volumes.where(F.col("nz") < slabs)


def settings_differ(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, field, recorded, expected of every setting that differs; null equals null."""
    left = a.select(*keys, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    right = b.select(*keys, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("recorded"), F.col(f"b_{f}").alias("expected")) for f in fields])
    rows = left.join(right, list(keys)).select(*keys, F.explode(each).alias("s")).select(*keys, "s.*")
    return rows.where(~F.col("recorded").eqNullSafe(F.col("expected")))


def outdated(jobs: DataFrame, records: DataFrame, keys: Sequence[str], settings: Sequence[str]) -> DataFrame:
    """Jobs without a record of the same settings: what an incremental run has to do."""
    marked = records.select(*keys, *settings).distinct()
    same = None
    for c in [*keys, *settings]:
        one = jobs[c].eqNullSafe(marked[c])
        same = one if same is None else same & one
    return jobs.join(marked, same, "left_anti")


def bad_names(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(name).rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*$"), F.lit(False)))
