import math

import numpy as np
from pyspark.sql import functions as F

from voluma.llm import neighbours


def exact(rows, asked, top):
    """(query, rank, id, score) by comparing each query with every row."""
    good = [(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = sorted(set(good))
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = []
    for k, (i, v) in enumerate(good):
        if asked(i):
            s = x @ np.array(v)
            order = [j for j in np.lexsort((ids, -s)) if j != k][:top]
            out += [(i, r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out


def found(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"id long, e array<{kind}>").withColumns({"vector": F.lit(1), "at": F.lit("x"), "Block": F.lit(0)}).repartition(3)
    return sorted(map(tuple, neighbours.nearest(df, "id", "e", F.col("id") % 5 == 0, **options).collect()))


def recall(got, want):
    have, n = {(q, v) for q, _, v, _ in got}, len(want)
    return sum((q, v) in have for q, _, v, _ in want) / n


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def test_many_blocks_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    spread = rng.standard_normal((700, 12))
    near = rng.standard_normal(12) + 0.05 * rng.standard_normal((300, 12))
    rows = list(enumerate(unit(np.concatenate([spread, near]))))
    want = exact(rows, lambda i: i % 5 == 0, 10)
    got = found(spark, rows, top=10, degree=16, beam=40, block=90)
    assert recall(got, want) >= 0.95
    score = {(q, v): s for q, _, v, s in exact(rows, lambda i: i % 5 == 0, 999)}
    assert all(abs(score[q, v] - s) < 1e-12 for q, _, v, s in got)
    by = {}
    for q, r, v, s in got:
        by.setdefault(q, []).append((r, -s, v))
    assert all([r for r, _, _ in x] == list(range(1, 11)) and [y[1:] for y in x] == sorted(y[1:] for y in x) for x in by.values())


def test_inner_products_of_different_norms(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate((rng.standard_normal((400, 8)) * rng.uniform(0.2, 3, (400, 1))).tolist()))
    got = found(spark, rows, top=10, degree=24, beam=80, block=100)
    assert recall(got, exact(rows, lambda i: i % 5 == 0, 10)) >= 0.9


def test_nulls_equal_vectors_repeats_and_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [0.0, 1.0 + i]) for i in range(3)] + [(5, [1.0, 0.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0])]
    rows += [(200, None), (205, []), (210, [0.0, -0.0]), (215, [1.0, None]), (220, [float("nan"), 1.0]), (225, [float("inf"), 1.0]), (230, [1.0, 2.0, 3.0])]
    want = exact(rows, lambda i: i % 5 == 0, 6)
    assert found(spark, rows, top=6, degree=4, beam=16) == sorted(want)
    few = [(0, [1.0, 2.0]), (5, [2.0, 1.0]), (7, [-1.0, 0.5])]
    assert found(spark, few, "float") == sorted(exact(few, lambda i: i % 5 == 0, 20))
    assert found(spark, [(5, [1.0])]) == [] and found(spark, [(1, [1.0]), (2, [2.0])]) == [] and found(spark, []) == []
