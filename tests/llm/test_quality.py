"""The language model against a brute-force Kneser-Ney model, and exact quantiles."""

import math
from collections import Counter

from pyspark.sql import functions as F

from voluma.llm import quality


def brute_perplexity(training, text):
    """Interpolated modified Kneser-Ney of order 4 over characters, from the definitions."""
    def grams(t):
        t = "\x02" * 3 + t
        return [t[i : i + 4] for i in range(len(t) - 3)]

    counts = {4: Counter(g for t in training for g in grams(t))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    less = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        less[n] = [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]

    def p(gram):
        n = len(gram)
        lower = 1 / (len(counts[1]) + 1) if n == 1 else p(gram[1:])
        same = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return lower
        mass = sum(less[n][min(v, 3) - 1] for v in same.values())
        v = same.get(gram, 0)
        return ((v - less[n][min(v, 3) - 1]) if v else 0) / total + mass / total * lower

    logs = [math.log(p(g)) for g in grams(text)]
    return math.exp(-sum(logs) / len(logs))


def test_perplexity_is_that_of_the_definitions(spark):
    training = ["the cat sat on the mat", "the dog ran to the hill", "a cat and a dog", "on the hill the cat ran"]
    asked = ["the cat ran on the hill", "zzz qqq", "a", "the dog", None, "", "the dog"]
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate([*training, *asked])], "doc_id long, text string, lang string, n int")
    trusted = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    for shard_rows in (2_000_000, 20):
        out = {r.doc_id: r for r in quality.score_quality(docs, trusted, shard_rows=shard_rows).collect()}
        for i, t in enumerate([*training, *asked]):
            if t:
                assert abs(out[i].perplexity - brute_perplexity(training, t)) < 1e-4 and out[i].n_chars_scored == len(t)
            else:
                assert out[i].perplexity is None and out[i].n_chars_scored == 0 and out[i].kept
    same = quality.score_quality(docs.union(docs.where("doc_id = 5")), trusted).where("doc_id = 5").collect()
    assert len(same) == 2 and len({(r.perplexity, r.tempered) for r in same}) == 1 and same[0].perplexity == out[5].perplexity
    assert quality.score_quality(docs.limit(0), trusted).count() == 0


def test_exact_quantile(spark):
    rows = spark.createDataFrame([("a", float(1 + (i * 37) % 200)) for i in range(200)] + [("b", 2.5)] * 7 + [(None, 3.0), (None, 4.0)], "g string, v double")
    for q, expected in ((0.995, 199.0), (0.5, 100.0), (1.0, 200.0), (0.0, 1.0)):
        out = {r.g: r.quantile for r in quality.exact_quantile(rows, "g", "v", q).collect()}
        assert out["a"] == expected and out["b"] == 2.5 and out[None] == (3.0 if q <= 0.5 else 4.0)


def test_more_languages_than_any_bound(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 150).alias("lang"))
    out = quality.score_quality(docs, docs.select("doc_id"))
    assert out.where("kept and threshold is not null").count() == 300 and out.select("lang", "threshold").distinct().count() == 150


def test_all_trusted_rows_train_the_model(spark):
    words = F.when(F.col("id") % 3 == 0, "b").when(F.col("id") == 599_999, "cab").otherwise("a")
    docs = spark.range(600_003).select(F.when(F.col("id") < 600_000, F.col("id")).alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"))
    out = quality.score_quality(docs, docs.select("doc_id").where("doc_id is not null"))
    training = ["b"] * 200_000 + ["a"] * 399_999 + ["cab"]
    found = {r.doc_id: r.perplexity for r in out.where("doc_id in (0, 1)").collect()}
    assert abs(found[0] - brute_perplexity(training, "b")) < 2e-6 and abs(found[1] - brute_perplexity(training, "a")) < 2e-6
    assert out.where("trusted").count() == 600_000 and out.count() == 600_003


def test_trusted_ids_joined_by_a_shuffle(spark):
    training = ["the cat sat on the mat", "the dog ran to the hill", "a cat and a dog", "on the hill the cat ran"]
    rows = [(i, t, "en") for i, t in enumerate([*training, "the cat ran on the hill", None, ""])] + [(None, "the dog", "en"), (None, None, "en"), (2, training[2], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 3, None, 77)], "doc_id long")
    out = [sorted(map(str, quality.score_quality(docs, trusted, broadcast_ids=n).collect())) for n in (500_000, 2, 0)]
    assert out[0] == out[1] == out[2] and len(out[0]) == len(rows)
    found = {r.doc_id: r for r in quality.score_quality(docs, trusted, broadcast_ids=2).collect()}
    assert abs(found[4].perplexity - brute_perplexity([*training, training[2]], "the cat ran on the hill")) < 1e-4
