"""JSON trees path by path, templates, hashed draws and retries."""

import json
import math

import pytest
from pyspark.sql import functions as F

from voluma.operators import cohort, documents, synthesis


def walk(node, path="$"):
    if isinstance(node, dict) and node:
        for k, v in node.items():
            yield from walk(v, f"{path}.{k}")
    elif isinstance(node, list) and node:
        for i, v in enumerate(node):
            yield from walk(v, f"{path}[{i}]")
    else:
        yield path, node


TREES = [
    {"a": 1, "b": {"c": [1, 2.5, {"d": None}], "e": {}, "f": []}, "g": "x", "h": True},
    {"a": 1.0, "b": {"c": [1, 2.5], "e": {}, "f": [[]]}, "g": "y", "h": 1, "i": None},
    [],
    7,
]


def rows(spark, trees):
    return spark.createDataFrame([(i, None if t is ... else json.dumps(t)) for i, t in enumerate(trees)], "id int, doc string")


def test_paths_and_differences(spark):
    got = {(r.id, r.path): r for r in documents.tree_paths(rows(spark, [*TREES, ...]), ["id"], "doc").collect()}
    assert got.keys() == {(i, p) for i, t in enumerate(TREES) for p, _ in walk(t)}
    for i, t in enumerate(TREES):
        for p, v in walk(t):
            assert json.loads(got[i, p].value) == v and (got[i, p].kind == "BOOLEAN") == isinstance(v, bool)
    a, b = rows(spark, TREES[:1]), rows(spark, TREES[1:2])
    found = {r.path: (r.problem, r.recorded, r.expected) for r in documents.tree_differences(a, b, ["id"], "doc").collect()}
    assert found == {
        "$.b.c[2].d": ("extra", "null", None), "$.b.f": ("extra", "[]", None), "$.b.f[0]": ("missing", None, "[]"),
        "$.g": ("value", '"x"', '"y"'), "$.h": ("value", "true", "1.0"), "$.i": ("missing", None, "null"),
    }
    left = documents.tree_differences(a, b, ["id"], "doc", ignored=["$.b", "$.h"])
    assert {r.path for r in left.collect()} == {"$.g", "$.i"}
    assert documents.checked_documents(a, a, ["id"], "doc").count() == 1
    with pytest.raises(Exception, match=r"differs at \$.b.c\[2\].d"):
        documents.checked_documents(a, b, ["id"], "doc").collect()
    flat = {r.name: r.value for r in documents.flattened(a, ["id"], "doc").collect()}
    assert flat == {"a": "1.0", "b_c": "[0]=1.0,[1]=2.5,[2].d=null", "b_e": "{}", "b_f": "[]", "g": '"x"', "h": "true"}


def test_templates(spark):
    df = spark.createDataFrame([("m", "p1"), ("..", "p2"), ("a/b", "p3"), (None, "p4")], "method string, patch_id string")
    path = cohort.templated_path("{method}/{patch_id}_mask.nii.gz", "/root/")
    assert df.limit(1).select(path).first()[0] == "/root/m/p1_mask.nii.gz"
    for p in ("p2", "p3", "p4"):
        with pytest.raises(Exception, match="method is no part of a path"):
            df.where(F.col("patch_id") == p).select(path).collect()
    for bad in ("{what}/x", "../{method}", "/x", "a//b", "{method", "x}"):
        with pytest.raises(ValueError):
            cohort.templated_path(bad, "/root")


def test_draws(spark):
    df = spark.range(20_000).select("id", synthesis.uniform(1, "u", "id").alias("u"), synthesis.normal(1, "n", "id").alias("n"), synthesis.gamma(1, "g", 4, "id").alias("g"))
    r = df.agg(*[f(c) for c in "ung" for f in (F.avg, F.var_samp)], F.corr("u", "n"), F.avg(F.col("n") ** 4), F.min("u"), F.max("u")).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and r[1] == pytest.approx(1 / 12, abs=0.003)
    assert r[2] == pytest.approx(0, abs=0.03) and r[3] == pytest.approx(1, abs=0.04) and r[7] == pytest.approx(3, abs=0.25)
    assert r[4] == pytest.approx(1, abs=0.02) and r[5] == pytest.approx(0.25, abs=0.02) and abs(r[6]) < 0.03 and 0 < r[8] < r[9] < 1
    again = spark.range(19_999, -1, -1, numPartitions=7).select("id", synthesis.normal(1, "n", "id").alias("n"))
    assert again.join(df, "id").where(again["n"] != df["n"]).count() == 0


def test_images_do_not_depend_on_partitions(spark):
    rows = [(v, z, y, x, (z // 2) * 2 + y // 3 if x else 0, 0.5 if x == 1 else 1.0 * (x > 1)) for v in range(3) for z in range(4) for y in range(6) for x in range(5)]
    df = spark.createDataFrame(rows, "v int, z int, y int, x int, label int, prob double")
    one, many = ({(r.v, r.z, r.y, r.x): r.image for r in synthesis.synthesised(d, ["v"], {"z": 4, "y": 6, "x": 5}, 3).collect()} for d in (df.coalesce(1), df.repartition(9)))
    assert one.keys() == many.keys() and len(one) == len(rows) and all(math.isclose(one[k], many[k], abs_tol=1e-9) for k in one)
    assert min(one.values()) == 0 and max(one.values()) == 1


def test_retries(spark):
    df = spark.createDataFrame([(v, 0, 0, x, 1 + x) for v in range(4) for x in range(3)], "v int, z int, y int, x int, label int")

    def step(left, attempt):  # volume v keeps a label from attempt v on, volume 3 never does
        return left.withColumn("label", F.when((F.col("v") <= attempt) & (F.col("v") < 3) & (F.col("x") == 0), F.col("label")).otherwise(0))

    out, table = synthesis.first_that_holds(df, ["v"], step, synthesis.any_label, attempts=4)
    assert {r.v: r.attempt for r in table.collect()} == {0: 0, 1: 1, 2: 2, 3: None}
    labels = {v: sorted(r.label for r in out.where(F.col("v") == v).collect()) for v in range(4)}
    assert labels == {0: [0, 0, 1], 1: [0, 0, 1], 2: [0, 0, 1], 3: [1, 2, 3]}
    groups = synthesis.intensity_groups(df, ["v"], 5).select("v", "label", "group").distinct().collect()
    assert all(1 <= r.group <= 5 for r in groups)
    assert synthesis.dropped_labels(df, ["v"], 1, most=0.0).where("label = 0").count() == 0
