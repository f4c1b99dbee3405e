"""Evaluation cases from files: target, score and saved mask of each case side by side, checked before anything is measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import at_least, clipped
from ..sources.planes import Bounds, scan_headers, scan_voxels
from .constraints import EPSILON, affine_differs
from .grid import AXES

ROLES = ("target", "score", "mask")


def _fails(case: str, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what} in case "), F.col(case).cast("string")))


def _flag(ok: Column, case: str, what: str) -> Column:
    """0 where ``ok``, else an error that names the case."""
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(0)).otherwise(_fails(case, what).cast("int"))


def case_headers(cases: DataFrame, headers: DataFrame, case: str = "case") -> DataFrame:
    """cases with nz, ny, nx and affine of the target; a file that is missing, sizes or affines (by 1e-5) that differ are errors."""
    out = cases
    for role in ROLES:
        own = headers.select(F.col("path").alias(f"{role}_path"), F.struct("nz", "ny", "nx").alias(f"_{role}_size"), F.col("affine").alias(f"_{role}_affine"))
        out = out.join(own, f"{role}_path", "left")
    checks = [_flag(F.col(f"_{r}_size").isNotNull(), case, f"no {r} file") for r in ROLES]
    checks += [_flag(F.col(f"_{r}_size") == F.col("_target_size"), case, f"the {r}'s size is not the target's") for r in ROLES[1:]]
    checks += [_flag(~affine_differs(f"_{r}_affine", "_target_affine"), case, f"the {r}'s affine is not the target's") for r in ROLES[1:]]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok + c
    size = [(F.col(f"_target_size.{n}") + ok).alias(n) for n in ("nz", "ny", "nx")]
    return out.select(*cases.columns, *size, F.col("_target_affine").alias("affine"))


def load_cases(spark: SparkSession, cases: DataFrame, path: str | list[str], case: str = "case", threshold: str = "threshold", within: Bounds | None = None) -> DataFrame:
    """case, threshold, nz, ny, nx, z, y, x, target, score, prediction of every voxel of the cases.

    ``cases`` has a row per case: its name, target_path, score_path, mask_path (as files below ``path`` are called there) and its
    threshold.  Errors, when the rows are read: a missing file, sizes or affines that differ from the target's, a target or mask that
    is not 0 and 1, a score that is not finite or beyond [0, 1] by more than one single-precision step, and a saved mask that is not
    the score at the threshold.  Scores are clipped to [0, 1]; prediction is the score at the threshold.  Files that several cases
    share are read once; ``within`` limits the planes that are read (see ``scan_voxels``).
    """
    heads = case_headers(cases, scan_headers(spark, path), case).select(case, threshold, *[f"{r}_path" for r in ROLES], "nz", "ny", "nx")
    voxels = scan_voxels(spark, path, within)
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_path").alias("path")) for r in ROLES]))
    wanted = heads.select(case, threshold, "nz", "ny", "nx", roles.alias("r")).select(case, threshold, "nz", "ny", "nx", "r.role", "r.path")
    rows = voxels.drop("volume_id").join(wanted, "path")
    one = rows.groupBy(case, threshold, "nz", "ny", "nx", *AXES).agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(f"_{r}") for r in ROLES])
    binary = {r: F.col(f"_{r}").isin(0.0, 1.0) for r in ("target", "mask")}
    score = F.col("_score")
    good = ~F.isnan(score) & (score >= F.lit(-EPSILON).cast("float")) & (score <= F.lit(1 + EPSILON).cast("float"))
    held = clipped(score, F.lit(0.0).cast("float"), F.lit(1.0).cast("float"))
    prediction = at_least(held, F.col(threshold))
    checks = _flag(binary["target"], case, "a target that is not 0 and 1") + _flag(good, case, "a score that is not in [0, 1]")
    checks = checks + _flag(binary["mask"], case, "a mask that is not 0 and 1") + _flag((F.col("_mask") == 1) == prediction, case, "a mask that is not the score at the threshold")
    return one.select(case, threshold, "nz", "ny", "nx", *AXES, ((F.col("_target") + checks) == 1).alias("target"), held.alias("score"), prediction.alias("prediction"))


def checked_records(cases: DataFrame, records: DataFrame, fields: Sequence[str], case: str = "case") -> DataFrame:
    """cases; a case without a record, or whose record differs from it in one of ``fields`` (null equals null), is an error."""
    there = records.select(case, F.struct(*[F.col(f) for f in fields]).alias("_record"))
    out = cases.join(there, case, "left")
    ok = _flag(F.col("_record").isNotNull(), case, "no record")
    for f in fields:
        ok = ok + _flag(F.col(f).eqNullSafe(F.col(f"_record.{f}")), case, f"another {f} recorded")
    return out.withColumn(case, F.when(ok == 0, F.col(case))).drop("_record")
