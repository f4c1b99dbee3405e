import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.llm import runs


def brute(words, least=24, times=3):
    """(start, length, period) of all runs, by comparing the words at every period."""
    w, n, out = np.array([hash(x) for x in words]), len(words), []
    for p in range(1, n // times + 1):
        equal = np.concatenate([[0], (w[:-p] == w[p:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(equal))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = b - a + p
            if length >= max(least, times * p):
                part = w[a : a + length]
                if not any(np.array_equal(part[q:], part[:-q]) for q in range(1, p)):
                    out.append((a, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for a, length, p in found for i in range(a + p, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def texts():
    rng = random.Random(5)
    out = ["", None, " \t\n", "one", "a " * 23, "a " * 24, "a b " * 12, "x " + "a b c " * 8 + "y", "b " * 5000, "a b\x0bc\x0cd\re\nf " * 40, "é ü " * 30, "a b " * 30]
    for _ in range(60):  # few words: runs of many periods, nested and side by side
        parts = []
        for _ in range(rng.randint(1, 6)):
            base = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40, 90, 200]))]
            cut = rng.randint(0, len(base))
            parts += base * rng.randint(1, 7) + base[:cut] + [rng.choice("abcdxyz") for _ in range(rng.randint(0, 30))]
        out.append(rng.choice([" ", "  ", "\n"]).join(parts))
    for n in (1500, 5000, 9000):  # periods beyond a tile, and a fault in the middle
        base = [str(rng.randint(0, 999)) for _ in range(n // 4)]
        words = (base * 4)[:n]
        out.append(" ".join(words))
        words[n // 2] = "fault"
        out.append(" ".join(words))
    thue = [0]
    while len(thue) < 4096:
        thue += [1 - x for x in thue]
    return [*out, " ".join(map(str, thue))]


@pytest.mark.parametrize("least,times", [(24, 3), (5, 2), (40, 4)])
def test_runs_against_all_periods(spark, least, times):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in runs.periodic_runs(docs, least=least, times=times, texts=True).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        found = brute(words, least, times)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == found, i
        assert got[i].n_words == len(words) and got[i].collapsed == collapsed(words, found)
        assert got[i].collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


def test_query_against_all_periods(spark, tmp_path):
    from voluma.llm.queries import op11_periodic_runs

    rng, rows = random.Random(9), []
    for i in range(400):
        n = rng.choice([0, 3, 30, 200, 700])
        rows.append((i * 7, " ".join(rng.choice(["mu", "ka", "lo", "ti", "re"]) + str(rng.randint(0, 40)) for _ in range(n)) if rng.random() > 0.05 else None))
    rows += rows[:5]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op11_periodic_runs(spark, str(tmp_path)).collect())
    want = []
    for i, text in rows:
        words = plant(i, (text or "").split(" ") if text else [])
        found = brute(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        milli = 1000 * best[1] // best[2] if found else None
        want.append((i, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 10


def test_nulls_repeats_names_and_empty(spark):
    docs = spark.createDataFrame([(None, None, "k"), (1, "a b " * 20, "k"), (1, "a b " * 20, "k"), (None, "a b " * 20, None)], "row long, text string, n string")
    got = runs.periodic_runs(docs).orderBy("row", "n").collect()
    assert [(r.row, r.n, r.n_words, len(r.runs)) for r in got] == [(None, None, 40, 1), (None, "k", 0, 0), (1, "k", 40, 1), (1, "k", 40, 1)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert "collapsed" not in runs.periodic_runs(docs).columns


def test_best_run_is_exact(spark):
    found = [(5, 3_000_001, 1_000_000), (2, 3_000_001, 1_000_000), (9, 3_000_000, 1_000_000), (1, 30, 10)]
    df = spark.createDataFrame([(found,), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [tuple(r.b) if r.b else None for r in df.select(runs.best_run(F.col("runs")).alias("b")).collect()] == [(2, 3_000_001, 1_000_000), None]


def test_z_functions():
    rng = np.random.default_rng(3)
    for _ in range(200):
        words = rng.integers(0, 2, rng.integers(8, 80)).astype(np.int32)
        c, most = int(rng.integers(0, len(words) - 4)), int(rng.integers(1, 12))
        periods = np.arange(1, len(words) - c)

        def reach(p, step):
            i, j = (c, c + p) if step > 0 else (c - 1, c + p - 1)
            k = 0
            while k < most and 0 <= i and j < len(words) and words[i] == words[j]:
                i, j, k = i + step, j + step, k + 1
            return k

        for step, back in ((1, False), (-1, True)):
            want = [reach(p, step) for p in periods]
            assert runs.z_values_of_one(words, c, periods, most, back).tolist() == want
            assert runs.z_values(words, np.full(len(periods), c), periods, most, back).tolist() == want
