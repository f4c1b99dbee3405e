"""Pairs of files, jobs by number, generated volumes and random fields."""

import pytest
from pyspark.sql import functions as F

from voluma.functions import density
from voluma.operators import cohort as K


def files(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_pairs_by_stem(spark):
    rows = files(spark, ["a/x_label.nii.gz", "b/x_prob.nii.gz", "a/y_label.nii.gz", "a/z_prob.nii.gz", "a/x_meta.txt", "a/x_label.nii.gz"])
    out = {r.stem: (r.left_path, r.right_path, r.problem) for r in K.paired_files(rows).collect()}
    assert out == {"x": ("a/x_label.nii.gz", "b/x_prob.nii.gz", None), "y": ("a/y_label.nii.gz", None, "no _prob"), "z": (None, "a/z_prob.nii.gz", "no _label")}
    assert K.checked_pairs(files(spark, ["x_label.nii.gz", "x_prob.nii.gz"])).count() == 1
    with pytest.raises(Exception, match="y has no _prob"):
        K.checked_pairs(rows.where("path like '%/y_%'")).collect()


def test_jobs_and_plans(spark):
    jobs = spark.createDataFrame([("m1", "p2"), ("m0", "p2"), ("m0", "p1")], "method string, patch string")
    assert [K.job_at(jobs, ["method", "patch"], i).collect() for i in (1, 3)] == [[("m0", "p2", 1)], []]
    plan = K.generation_plan(spark.range(50).withColumnRenamed("id", "volume"), "volume", (128, 128, 128), 0.001).collect()
    assert all(6.1 <= r.exponent < 6.6 and r.seed == 42_000 + r.volume and r.trees == max(1, int(10**r.exponent * 128**3 * 1e-9)) for r in plan)
    assert K.generation_plan(spark.range(1).withColumnRenamed("id", "volume"), "volume", (2, 2, 2), 0.001).first().trees == 1
    merged = K.merged_rows(jobs, spark.createDataFrame([("m9", 3)], "method string, n int"))
    assert merged.columns == ["method", "patch", "n"] and merged.where("patch is null and n = 3").count() == 1


def test_random_fields_stay_in_their_range(spark):
    grid = spark.range(40).select(F.col("id").alias("v")).crossJoin(spark.range(6).select(F.col("id").cast("int").alias("z")))
    grid = grid.withColumns({"y": F.col("z"), "x": F.lit(0), "choice": density.random_choice(F.col("v"), 1)})
    rows = grid.withColumn("d", density.chosen("choice", ["z", "y", "x"], [F.lit(6), F.lit(6), F.lit(1)])).collect()
    assert {r.choice.kind for r in rows} == {0, 1, 2, 3, 4} and {r.choice.axis for r in rows} == {0, 1, 2}
    for r in rows:
        low, high = (r.choice.a, r.choice.a) if r.choice.kind == 4 else (r.choice.low, r.choice.high)
        assert low - 1e-9 <= r.d <= high + 1e-9
