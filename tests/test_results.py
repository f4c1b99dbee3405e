"""Result files: column order, refusals, round trips, report lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voluma.sources import results as R

SCHEMA = "patch string, dice double, iou double, method string"
ROWS = [("p1", 0.5, None, "a"), ("p2", 0.03125, 1.0, "b")]


def test_metrics_round_trip(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/m.csv"
    R.write_metrics(df, path, ["patch", "method"])
    back = R.read_metrics(spark, path, "patch string, method string, dice double, iou double")
    assert sorted(map(tuple, back.collect())) == [("p1", "a", 0.5, None), ("p2", "b", 0.03125, 1.0)]
    assert [f.name for f in tmp_path.iterdir() if f.name.endswith(".part")] == []


def test_metrics_refusals(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/m.csv"
    with pytest.raises(ValueError):
        R.write_metrics(df.where("dice > 9"), path, ["patch"])
    R.write_metrics(df, path, ["patch"])
    with pytest.raises(FileExistsError):
        R.write_metrics(df, path, ["patch"])
    R.write_metrics(df.limit(1), path, ["patch"], overwrite=True)
    assert spark.read.csv(path, header=True).count() == 1


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("dice", F.lit(float("nan")))
    with pytest.raises(Exception, match="not finite"):
        R.write_records(df, f"file://{tmp_path}/r.json")
    assert list(tmp_path.iterdir()) == []


def test_records_keys_by_name(spark, tmp_path):
    R.write_records(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/r.json")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/r.json").collect()]
    assert '{"dice":0.5,"iou":null,"method":"a","patch":"p1"}' in lines


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "threshold": 0.5,\n "method": "x"\n}')
    row = R.read_sidecars(spark, f"file://{tmp_path}/*.json", "method string, threshold double").first()
    assert tuple(row) == ("x", 0.5, "a.json")


def test_lines(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r.line for r in R.markdown_rows(df, ["patch"], ["dice", "iou"]).orderBy("patch").collect()] == ["| p1 | 0.5000 |  |", "| p2 | 0.0313 | 1.0000 |"]
    lines = [r.line for r in R.summary_lines(df, ["patch"], ["dice", "iou"], width=6).orderBy("patch", "place").collect()]
    assert lines == ["dice          0.5000", "iou                -", "dice          0.0313", "iou           1.0000"]
    assert [r.line for r in R.meta_lines(df, ["patch"], ["method", "iou"]).orderBy("patch", "place").collect()] == ["method: a", "method: b", "iou: 1.0"]
